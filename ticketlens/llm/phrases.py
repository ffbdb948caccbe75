"""Phrase collocations by SON partitioning: mined shard by shard, counted exactly over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written
from ticketlens.llm.keyfilter import BITS, has, key_filter

LONGEST, LEAST, TOP = 5, 100, 2_000
SHARDS = 8  # the least count of a shard is LEAST times its share of the words
BLOCK = 1 << 21  # words that a task counts at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: marks that end a piece become line ends (fixed by the contract)
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)


def pieces(text: str | None) -> list[list[bytes]]:
    """Words of the pieces of a whole text, A-Z lower-cased; pieces without words are left out."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_ENDS) if text else b""
    # line ends are gone from a piece, so only spaces and tabs are left to cut at
    return [words for words in map(bytes.split, data.split(b"\n")) if words]


def _codes(text: str | None) -> np.ndarray:
    """A 32-bit hash of every word, never 0; 0 behind every piece."""
    digest = xxhash.xxh32_intdigest
    flat = [c for words in pieces(text) for c in (*[digest(w) or 1 for w in words], 0)]
    return np.array(flat, np.uint32)


def _keys(codes: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from every place on, and whether they are inside one piece."""
    m = max(0, len(codes) - n + 1)
    key, inside = np.full(m, seed, np.uint64), np.ones(m, bool)
    for j in range(n):
        part = codes[j:j + m]
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
        inside &= part != 0
    return key, inside


def _possible(codes: np.ndarray, n: int, seed: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the places where n words of one piece stand whose two shorter phrases the filter has."""
    key, inside = _keys(codes, n, seed)
    if below is not None:
        shorter = has(below, _keys(codes, n - 1, seed)[0])
        inside &= shorter[:-1] & shorter[1:]
    return key, inside


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def word_table(docs: DataFrame) -> DataFrame:
    """(lang, shard, n, codes) of every document, written once; a shard is a set of input splits."""
    def run(batches):
        for batch in batches:
            for lang, shard, text in zip(*[batch.column(c) for c in ("lang", "shard", "text")]):
                own = _codes(text.as_py())
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang.as_py()], "shard": [shard.as_py()], "n": [int(np.count_nonzero(own))],
                     "codes": [own.tobytes()]}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                       (F.spark_partition_id() % SHARDS).alias("shard"), "text")
    return written(rows.mapInArrow(_gathered(run, schema), "lang string, shard int, n bigint, codes binary"), "words")


def _gathered(run, schema, most: int = 8 << 20):
    """The same batches, gathered up to a size."""
    def gather(batches):
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > most or len(held) >= 10_000:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
    return gather


def _local_counts(words: DataFrame, n: int, filters: list) -> DataFrame:
    """(lang, shard, key, c) of the phrases of n words, added up in blocks before the shuffle."""
    below = filters[-1] if filters else None

    def run(batches):
        bits = below.value if below is not None else None
        held, size = {}, 0

        def flush():
            for (lang, shard), parts in held.items():
                key, inside = _possible(np.concatenate(parts), n, _seed(lang), bits)
                keys, counts = np.unique(key[inside], return_counts=True)
                for c in range(0, len(keys), 100_000):
                    part = keys[c:c + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int8))),
                         pa.array(np.full(len(part), shard, np.int32)), pa.array(part),
                         pa.array(counts[c:c + 100_000].astype(np.int64))], names=["lang", "shard", "key", "c"])
            held.clear()

        for batch in batches:
            for lang, shard, codes in zip(*[batch.column(c) for c in ("lang", "shard", "codes")]):
                own = np.frombuffer(codes.as_py(), np.uint32)
                held.setdefault((lang.as_py(), shard.as_py()), []).append(own)
                size += len(own)
                if size > BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return words.select("lang", "shard", "codes").mapInArrow(
        run, "lang string, shard int, key bigint, c bigint").groupBy("lang", "shard", "key").agg(F.sum("c").alias("c"))


def mine(words: DataFrame, longest: int, least: int, bits: int = BITS) -> list:
    """For 1 to `longest` words, a broadcast filter of the phrases that are frequent in some shard.

    A phrase with `least` occurrences has at least its share of them in some shard, so the union
    of what the shards find is complete.  Inside a shard a phrase is only counted where both of
    its shorter phrases passed.  Counts by hash are never too low.
    """
    shares = words.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    shares = shares.join(shares.groupBy("lang").agg(F.sum("own").alias("total")), "lang").where("own > 0").select(
        "lang", "shard", F.expr(f"({least} * own + total - 1) div total").alias("support"))
    shares = written(shares, "supports")
    context, filters = words.sparkSession.sparkContext, []
    for n in range(1, longest + 1):
        counts = _local_counts(words, n, filters)
        found = written(counts.join(shares, ["lang", "shard"]).where("c >= support").select("key"), "frequent")
        filters.append(context.broadcast(key_filter(found, found.count(), bits)))
    return filters


def _exact(ids: np.ndarray, places: np.ndarray, key: np.ndarray, n: int):
    """(first place, count) of every different phrase at the places; ids are exact, keys are hashes."""
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    lead = np.repeat(places[start], np.diff(np.append(start, len(key))))
    same = np.ones(len(places), bool)
    for j in range(n):
        same &= ids[places + j] == ids[lead + j]
    counts = np.add.reduceat(same.astype(np.int64), start) if len(start) else start
    others: dict[bytes, list[int]] = {}  # phrases that share a hash with another one
    for place in places[~same]:
        entry = others.setdefault(ids[place:place + n].tobytes(), [int(place), 0])
        entry[1] += 1
    more = np.array(list(others.values()), np.int64).reshape(-1, 2)
    return np.concatenate([places[start], more[:, 0]]), np.concatenate([counts, more[:, 1]])


def phrase_counts(docs: DataFrame, filters: list, least: int) -> DataFrame:
    """(lang, phrase, k, n): exact counts over all documents of the phrases with at least `least`."""
    def run(batches):
        bits = [f.value for f in filters]
        digest = xxhash.xxh32_intdigest
        vocabulary: dict[bytes, int] = {}
        names: list[bytes] = [b""]
        codes = [0]
        held, size = {}, 0

        def flush():
            code_of = np.array(codes, np.uint32)
            for lang, parts in held.items():
                ids = np.array(parts, np.int32)
                word_codes = code_of[ids]
                for n in range(1, len(bits) + 1):
                    key, inside = _keys(word_codes, n, _seed(lang))
                    inside &= has(bits[n - 1], key)
                    places = np.flatnonzero(inside)
                    first, counts = _exact(ids, places, key[places], n)
                    for c in range(0, len(first), 50_000):
                        text = [b" ".join([names[w] for w in ids[p:p + n].tolist()]).decode("utf-8", "surrogatepass")
                                for p in first[c:c + 50_000].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(text), np.int8))),
                             pa.array(text, pa.string()), pa.array(np.full(len(text), n, np.int32)),
                             pa.array(counts[c:c + 50_000])], names=["lang", "phrase", "k", "n"])
            held.clear()
            vocabulary.clear()
            del names[1:], codes[1:]

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                own = held.setdefault(lang.as_py(), [])
                before = len(own)
                for words in pieces(text.as_py()):
                    for word in words:
                        at = vocabulary.get(word)
                        if at is None:
                            at = vocabulary[word] = len(names)
                            names.append(word)
                            codes.append(digest(word) or 1)
                        own.append(at)
                    own.append(0)
                size += len(own) - before
                if size > BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "lang string, phrase string, k int, n bigint")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: the strongest phrases of 2 to `longest` words per lang.

    a counts the phrase, l and r the two sides of its weakest cut (behind `cut` words), n all
    words of the lang.  Phrases inside a longer one that is as frequent are left out.  Null texts
    have no words, a null lang is `und`; repeated rows count again.  Other columns do not take
    part.  Every part of a phrase that is frequent enough is so itself, so one table of counts
    has all sides.
    """
    words = word_table(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    filters = mine(words, longest, least, bits)
    counts = written(phrase_counts(docs, filters, least), "phrases")
    found = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    side = counts.select("lang", "phrase", "n")
    cuts = cuts.join(side.toDF("lang", "first", "l"), ["lang", "first"]).join(side.toDF("lang", "rest", "r"), ["lang", "rest"])
    big = "cast({} as decimal(19, 0))".format
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(
        f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # a longer phrase is at most as frequent; one word more is enough, what lies between has the same count
    longer = found.where("k > 2")
    inside = longer.select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", 1, F.col("k") - 1), " "), F.array_join(F.slice("w", 2, F.col("k") - 1), " "))).alias("phrase"))
    kept = weakest.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score", F.col("x.cut").cast("bigint").alias("cut"))


def op13_son_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
parts as (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from docs),
words as (select lang, w from parts where len(w) > 0),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from words cross join (values (1), (2), (3), (4), (5)) as s(k) where len(w) >= k),
counts as (select lang, phrase, k, count(*) as f from grams group by all having count(*) >= 100),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
found as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from counts where k > 1),
cuts as (
  select lang, phrase, k, a, w, unnest(range(1, k)) as cut from found),
sides as (
  select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, t.n,
         ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint as score
  from cuts c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  join totals t on t.lang = c.lang),
weakest as (
  select * from sides qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (
  select * from weakest s where not exists (
    select 1 from found x where x.lang = s.lang and length(x.phrase) > length(s.phrase)
      and contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' ') and 100 * x.a >= 100 * s.a)),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score, cut::bigint as cut from ranked where rank <= 2000
"""
