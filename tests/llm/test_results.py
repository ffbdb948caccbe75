"""Operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from ticketlens.llm import (
    features, fuzzy, jaccard, langid, packing, pii, quality_rules, queries, suffixes, toxicity,
)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name])[1] == ""


def _removed(texts):
    """Masks by the definition: every string of 100 bytes that started before."""
    first, data = {}, [t.encode() for t in texts]
    for d, b in enumerate(data):
        for s in range(len(b) - 99):
            first.setdefault(b[s:s + 100], (d, s))
    masks = []
    for d, b in enumerate(data):
        m = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if first[b[s:s + 100]] < (d, s):
                m[s:s + 100] = True
        masks.append(m)
    return data, masks


def _copies(seed):
    """Texts that share passages, with edits and periodic parts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeäß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    out = []
    for k in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 20):])
        if k % 7 == 0:
            parts.append("ab" * 150)
        text = " ".join(parts)
        if k % 5 == 0 and out:
            text = out[-1][:40] + "#" + out[-1][41:]
        out.append(text)
    return out


@pytest.mark.parametrize("wide", [4_096, 2])
def test_suffix_dedup(spark, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE_CLASS", wide)
    texts = _copies(wide)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    data, masks = _removed(texts)
    for r in suffixes.dedup(rows).collect():
        kept = np.frombuffer(data[r["doc_id"]], np.uint8)[~masks[r["doc_id"]]].tobytes()
        assert (r["n_removed"], r["kept_sha256"]) == (
            int(masks[r["doc_id"]].sum()), hashlib.sha256(kept).hexdigest())


def test_family_levels_grow_geometrically():
    family = suffixes.Family()
    for b in range(32):
        rows = np.zeros(64, suffixes.Family.KIND)
        rows["anchor"] = rows["digest"] = np.arange(64) + 64 * b + 1
        rows["doc"] = b
        repeated, opened = family.add(rows)
        assert not len(repeated) and not len(opened)
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 2048 and len(sizes) <= 7


def test_shingle_join_on_frequent_tokens(spark, monkeypatch):
    """Components equal brute force where tokens are frequent and leaders are not linked."""
    monkeypatch.setattr(jaccard, "RARE", 2)
    rng = random.Random(3)
    base = [str(rng.randint(0, 999)) for _ in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = str(rng.randint(0, 9999))
        texts.append(" ".join(own))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    comp = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(rows).collect()} == dict(enumerate(comp))


def test_shingle_join_lists_no_pairs_of_a_dense_group(spark, monkeypatch):
    """Sets that are all close to each other but below the threshold meet in blocks, not as pairs."""
    rng = random.Random(6)
    base = [str(rng.randint(0, 999_999)) for _ in range(200)]
    texts = []
    for _ in range(50):
        own = list(base)
        for k in rng.sample(range(200), 8):
            own[k] = str(rng.randint(0, 999_999))
        texts.append(" ".join(own))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    assert sum(100 * len(x & y) >= 75 * len(x | y) for x in sets for y in sets) < 200
    seen, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, texts: seen.append(pairs.count()) or verify(pairs, texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    comp = list(range(50))
    for i in range(50):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(rows).collect()} == dict(enumerate(comp))
    assert sum(seen) < 100


@pytest.mark.parametrize("block", [1_024, 7])
def test_link_counts_inside_components(spark, monkeypatch, block):
    """Every row's links equal brute force, copies and links past the leader included."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(4)
    base = [str(rng.randint(0, 999)) for _ in range(60)]
    texts = ["", None, "a b", "A  b"]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = str(rng.randint(0, 9999))
        texts += [" ".join(own)] * rng.randint(1, 2)
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    want = {i: sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets))
            for i, s in enumerate(sets)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(rows).collect()} == want


def test_quality_counts_by_definition():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab #\n\x0b\x1c %é") for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.base_counts(text) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automata():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 11))) for _ in range(25)]
    matcher = fuzzy.Matcher(terms)
    tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    codes, starts = features.codes_of(tokens)
    found = set(matcher.candidates(codes, starts[:-1], starts[1:] - 1).tolist())
    for k, t in enumerate(tokens):
        near = [(d, x) for x in set(terms) if (d := _distance(t, x)) <= fuzzy.allowed(x)]
        want = (min(near)[1], min(near)[0]) if near else None
        assert (matcher.match(t) if k in found else None) == want


def test_pii_base_and_disguises():
    rng = random.Random(2)
    rules = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.split("."))),
             (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and pii.luhn(d)),
             (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    for alphabet in ("a.@1 2-9+%().0", "4 -1"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            want = sorted((m.start(), k, m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0]))
            assert pii.base_spans(text) == want
    for text, kind in (("jane (at) example (dot) com", 0), ("jane at mail dot example dot org", 0),
                       ("jаne@exаmple.com", 0), ("４１１１ １１１１ １１１１ １１１１", 2),
                       ("plus four nine one five one two three four five six seven eight", 3)):
        whole = f"so {text}, yes"
        assert pii.added_spans(whole, []) == [(3, kind, 3 + len(text))]
    for text in ("he is at home. dot com", "look at that.thing", "one two three", "we met at point five"):
        assert pii.added_spans(text, pii.base_spans(text)) == []


def test_pii_plain_at_with_disguised_dots():
    for text, kind in (("jane@example[.]com", 0), ("jane@example (dot) com", 0), ("jane@example dot com", 0),
                       ("jane@mail punkt example punkt org", 0), ("jane@example-dot-com", 0),
                       ("jane@example\tdot\ncom", 0), ("plus 49 170 1234567", 3)):
        whole = f"so {text}, yes"
        assert pii.added_spans(whole, pii.base_spans(whole)) == [(3, kind, 3 + len(text))]
        assert pii.redact(whole) == f"so [{pii.KINDS[kind]}], yes"
    for text in ("the dot @ home", "a plus 12 b", "mail jane@example now (dot)"):
        assert pii.added_spans(text, pii.base_spans(text)) == []


def test_pii_rest_behind_a_disguise():
    for text, kind in (("jоhn.doe@example.com", 0), ("john [dot] doe@example.com", 0), ("jane@example.cоm", 0),
                       ("jane@mail.example [dot] xyz", 0), ("jane@mail.example dot org", 0),
                       ("+49 170 1234567 eight", 3), ("4000 0000 0000 0０ 02", 2)):
        whole = f"so {text}, yes"
        base = pii.base_spans(whole)
        assert pii.added_spans(whole, base) == [(3, kind, 3 + len(text))]
        assert pii.redact(whole) == f"so [{pii.KINDS[kind]}], yes"
        kept = pii.joined(base + pii.added_spans(whole, base)).split(",")
        assert len(kept) == len(base) + 1
    # a base span that is whole already stays alone
    for text in ("jane@example.com—great", "jane@example.com。Please", "jane@example.com dot thanks",
                 "jane@my-point-of.com", "４ jane@example.com"):
        assert pii.base_spans(text) and pii.added_spans(text, pii.base_spans(text)) == []


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(10**6, "a b\x1c ć \U0001F600 𝟙 ٣  end", "", "", 0)], docs.schema)
    docs = docs.union(odd)
    rows = packing.pack(docs, keep_ids=True).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.token_files()[0])
    for doc in docs.collect():
        own = rows[rows.doc_id == doc["doc_id"]].sort_values("start")
        ids = tokenizer.encode(doc["text"], add_special_tokens=False).ids + [0]
        assert [i for x in own.ids for i in x] == ids
        for r in own.itertuples():
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and len(ids) == r.doc_tokens
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.WINDOW
    assert rows.sequence_id.nunique() * packing.WINDOW <= 1.05 * rows.length.sum() + packing.WINDOW


def test_best_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.best_fill(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    found = langid.op10_language_mixture(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    hate = toxicity.op5_toxicity(spark, sf).where("held_out").join(marks, "doc_id")
    assert hate.where("predicted = 1 and toxic = 0").count() <= 1
    assert hate.where("predicted = 1 and toxic = 1").count() >= hate.where("toxic = 1").count() / 2
    kept = quality_rules.op1_quality_rules(spark, sf).where("not base_failed").join(marks, "doc_id")
    assert kept.where("kept and quality = 0").count() <= kept.where("quality = 0").count() / 4
    assert kept.where("not kept and quality = 1").count() <= kept.where("quality = 1").count() / 20
