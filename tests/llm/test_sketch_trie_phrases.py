"""SetSketch near copies, the conversation trie and phrase mining against brute force and on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import phrases, setsketch, trie

# --- near copies


def _texts(seed, families=6, copies=12, size=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            out.append(" ".join(text))
    out += ["one two three", "ONE two\tthree", "one two", "a b c d", "a b c d e", "", "   ", None]
    rng.shuffle(out)
    return out


def _brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("small", [2, setsketch.SMALL])
def test_near_copies_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(setsketch, "SMALL", small)
    monkeypatch.setattr(setsketch, "BLOCK_SETS", 3 if small == 2 else 256)
    texts = _texts(small)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in setsketch.near_copies(docs).collect()}
    want = _brute_components(texts)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in out.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())
    sizes = Counter(c for _, c in want.values())
    assert all(r["component_size"] == sizes[r["component_id"]] for r in out.values())


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        both = rng.integers(0, 2**64, int(2000 * share), dtype=np.uint64)
        a = np.concatenate([both, rng.integers(0, 2**64, 2000 - len(both), dtype=np.uint64)])
        b = np.concatenate([both, rng.integers(0, 2**64, 1200, dtype=np.uint64)])
        x, y = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merged(x, y) == setsketch.registers(np.concatenate([a, b]))).all()
        k = setsketch.ESTIMATED
        got = setsketch.estimate([(x[:k] > y[:k]).sum()], [(x[:k] < y[:k]).sum()], [len(a)], [len(b)])[0]
        assert got == pytest.approx(len(both) / (len(a) + len(b) - len(both)), abs=0.1)


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 2**64, 160, dtype=np.uint64)
        x, y = (setsketch.registers(np.concatenate([both, rng.integers(0, 2**64, 20, dtype=np.uint64)])) for _ in range(2))
        missed += not (setsketch.band_keys(x) == setsketch.band_keys(y)).any()
    assert missed == 0


def test_near_copies_of_odd_rows(odd, empty):
    out = setsketch.near_copies(odd).collect()
    assert len(out) == odd.count()
    by_key = defaultdict(list)
    for r in out:
        by_key[r["doc_id"]].append(r)
    assert {r["component_id"] for r in by_key[1] + by_key[2]} == {1} and by_key[1][0]["component_size"] == 3
    assert [r["kept"] for r in by_key[2]] == [False, False]
    assert [(r["component_id"], r["n_shingles"], r["kept"]) for r in by_key[3] + by_key[4]] == [(3, 0, True), (4, 0, True)]
    assert by_key[9][0]["n_shingles"] == 1 and by_key[None][0]["component_id"] is None and by_key[None][0]["kept"]
    assert setsketch.near_copies(empty).count() == 0


# --- conversation trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def _rows(seed, convs, longest, copies=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["u", "a"]), rng.choice(["x", "yy", "zzz", None]) if t < 9 else "same"))
    for k in range(copies):  # copies of a conversation
        rows += [(10_000 + k, t, r, x) for c, t, r, x in rows if c == convs[0]]
    return rows


def _brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, role or "", key), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -((-c) % 100))
        full[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("band, block, longest", [(64, 1 << 16, 8), (2, 3, 8), (3, 1, 14), (64, 4, 5), (4, 7, 40)])
def test_trie_equals_brute_force(spark, band, block, longest):
    rows = _rows(band * 100 + block, [0, 1, 2, 7, 100, 101, 150, 199, 350, -5, -120, 205], longest)
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), band, block).select(NODE).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_trie(rows)


def test_union_find_makes_the_nodes_of_sorted_rows():
    # sequences a, ab, abc, abd, b: lengths 1, 2, 3, 3, 1
    chains = trie._merge(np.array([-1, 1, 2, 2, 0]), np.array([1, 2, 3, 3, 1]), np.array([9, 4, 7, 5, 8]))
    nodes = {(lo, hi, low, high): (least, kids) for lo, hi, least, low, high, kids, _ in chains}
    assert nodes == {(0, 5, 0, 0): (4, 2), (0, 4, 1, 1): (4, 1), (1, 4, 2, 2): (4, 2), (2, 3, 3, 3): (7, 0),
                     (3, 4, 3, 3): (5, 0), (4, 5, 1, 1): (8, 0)}


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""), (None, 0, "u", "lost"), (200, 1, "u", "x" * 50_000),
            (201, None, "u", "x" * 50_000), (202, 5, "a", None), (202, 5, "a", "tie"), (303, 0, "u", "only")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], TURNS + ", depth int, key string")
    got = trie.prefix_trie(df).select(NODE).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id is null")).count() == 0


def test_one_conversation_with_most_rows(spark):
    rows = [(500, t, "u", f"t{t}") for t in range(3000)] + [(501, t, "u", f"t{t}") for t in range(2900)] + [(1, 0, "u", "a")]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    turns = trie.turn_rows(df).where("c = 500").agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert tuple(turns) == (1, 3000, 3000)
    got = trie.prefix_trie(df, 16).select(NODE).collect()
    out = {(r["conv_id"], r["depth"]): r for r in got}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (500, 501)}
    assert out[(1, 0)]["n_leaves"] == 3 if zlib.crc32(b"1") % 6 == 0 else True
    # 501 begins like 500 and goes on behind its own first turns: the same sequence
    assert h and out[(500, 2900)]["n_convs"] == 2 and out[(500, 2901)]["n_convs"] == 1
    assert out[(500, 1)]["saved_tokens"] == sum(len(f"t{t}") for t in range(2900))


# --- phrases


def _brute_phrases(rows, least, top):
    import re

    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and f >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in found.items()):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], k))
        for rank, (s, a, p, l, r, k) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s, k))
    return sorted(out)


def _phrase_docs(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "new", "York", "ÄPFEL", "a", "in x", "city", "'s", "--"]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", None, "und", "fr"]), text))
    return docs


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_phrases_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = _phrase_docs(block, 250)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    got = phrases.collocations(docs, least=6, top=40, bits=12).collect()  # filters that let much through
    assert sorted(tuple(r) for r in got) == _brute_phrases(rows, 6, 40)


def test_phrases_with_equal_hashes_are_counted_apart(monkeypatch):
    ids = np.array([1, 2, 0, 3, 4, 0, 1, 2, 0, 3, 5], np.int32)
    places = np.array([0, 3, 6, 9])
    first, counts = phrases._exact(ids, places, np.zeros(4, np.uint64), 2)
    assert {tuple(ids[p:p + 2]): c for p, c in zip(first.tolist(), counts.tolist())} == {(1, 2): 2, (3, 4): 1, (3, 5): 1}


def test_phrases_of_odd_rows(spark, odd, empty):
    assert phrases.collocations(empty).count() == 0
    out = phrases.collocations(odd, least=2).collect()
    assert {r["lang"] for r in out} == {"en"}
    found = {r["phrase"]: r["a"] for r in out}
    assert "word word word word word" in found and found["word word word word word"] == 30_000 - 4
    assert phrases.collocations(odd.where("text is null")).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    rows = [("en", "a b " * 30_000)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=29_000).collect()
    assert sorted(tuple(r) for r in got) == _brute_phrases(rows, 29_000, 2000)
