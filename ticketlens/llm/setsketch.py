"""Near copies by SetSketch registers: banded, estimated jointly by likelihood, verified on whole sets."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written
from ticketlens.llm.components import components
from ticketlens.llm.keyfilter import has, key_filter

WORDS, PERCENT = 4, 80
#: registers of a band and bands: a pair at the threshold shares no band with (1 - 0.8 ** 7) ** 65,
#: about 2e-7, and fewer than two with 4e-6
ROWS, BANDS = 7, 65
#: a register holds floor(1 - log_BASE(minimum of exponentials of rate RATE)), cut to 0 .. LIMIT + 1
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
ESTIMATED = 256  # registers that the joint estimate reads
#: a candidate falls away where similarity at the threshold is exp(-SLACK) times less likely than the estimate
SLACK = 20.0
SMALL = 64  # open buckets with more sets than this are cut by a second band
ROUNDS = 2  # rounds of one leader per bucket before sets of different components are paired
REMEMBERED = 100_000  # sets that a task recognises as copies
CHUNK, FLUSH = 512, 8 << 20  # shingles that meet all registers at once; bytes that wait for an output batch
PAIRS = 2_048  # pairs that are estimated at once
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 20  # sets, and shingles, of a block
BROADCAST_ROWS = 200_000  # rows of up to three short columns that a join may broadcast, after a count
GRID = np.linspace(0.0, 1.0, 201)

_draw = np.random.default_rng(20_240_229)
_FACTOR = (_draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64) | 1).astype(np.uint32)
_SHIFT = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text.

    bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space alone.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    held = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(len(words), WORDS)):
        held = (held ^ own[k:k + n]) * _MIX
        held ^= held >> np.uint64(31)
    return np.unique(held)


def registers(held: np.ndarray) -> np.ndarray:
    """The sketch of a set: exponentially spaced, truncated minima of its elements, as uint16.

    Every register sees an independent uniform hash of the elements.  The smallest of them is the
    quantile of an exponential minimum, so only it goes through the logarithm.
    """
    lowest = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    seeds = (held >> np.uint64(32)).astype(np.uint32)
    for c in range(0, len(seeds), CHUNK):
        np.minimum(lowest, (seeds[c:c + CHUNK, None] * _FACTOR + _SHIFT).min(axis=0), out=lowest)
    x = -np.log1p(-(lowest + 0.5) / float(1 << 32)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of register values; keys of different bands differ as well."""
    parts = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        key = (key ^ parts[:, r]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def likelihoods(more, less, n_a, n_b) -> np.ndarray:
    """Log likelihood of every similarity of GRID for pairs of sketches, -inf where it cannot be.

    more and less count the registers in which the first sketch is larger and smaller, out of
    ESTIMATED; n_a and n_b are the sizes of the sets.
    """
    more, less, n_a, n_b = (np.asarray(v, float)[:, None] for v in (more, less, n_a, n_b))
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    can = np.minimum(u, v) / np.maximum(u, v) + 1e-9 >= GRID

    def chance(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)

    first, second = chance(u - v * GRID), chance(v - u * GRID)
    same = np.clip(1.0 - first - second, 0.0, 1.0)

    def term(count, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(count > 0, count * np.log(p), 0.0)

    total = term(more, first) + term(less, second) + term(ESTIMATED - more - less, same)
    return np.where(can, total, -np.inf)


def estimate(more, less, n_a, n_b) -> np.ndarray:
    """Most likely similarity of pairs of sets."""
    return GRID[np.argmax(likelihoods(more, less, n_a, n_b), axis=1)]


class _Set:
    """A set in a cell: its size, registers and text, and its shingles once they are asked for."""

    __slots__ = ("held", "regs", "size", "text")

    def __init__(self, size: int, regs: bytes, text: str):
        self.size, self.regs, self.text, self.held = size, np.frombuffer(regs, np.uint16), text, None

    def shingles(self) -> np.ndarray:
        if self.held is None:
            self.held = shingles(self.text)
        return self.held


def _judged(pairs: list) -> pa.RecordBatch:
    """The pairs (a, b, set of a, set of b) whose estimates leave a link plausible and whose whole sets link.

    The plausible region starts one grid step below the threshold: exact sizes bound the rest.
    """
    x, y = np.stack([p[2].regs for p in pairs]), np.stack([p[3].regs for p in pairs])
    fit = likelihoods((x > y).sum(axis=1), (x < y).sum(axis=1), [p[2].size for p in pairs], [p[3].size for p in pairs])
    reach = GRID >= PERCENT / 100 - (GRID[1] - GRID[0]) - 1e-12
    found = []
    for i in np.flatnonzero(fit[:, reach].max(axis=1) >= fit.max(axis=1) - SLACK):
        a, b, one, two = pairs[i]
        both = len(np.intersect1d(one.shingles(), two.shingles(), assume_unique=True))
        if 100 * both >= PERCENT * (one.size + two.size - both):
            found.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked(batches):
    """Links among the pairs of cells; rows come by cell, the sets of a cell before its pairs."""
    cell, sets, pending, size = None, {}, [], 0
    for batch in batches:
        names = batch.schema.names
        cells = list(zip(*[batch.column(c).to_pylist() for c in ("ga", "ba", "gb", "bb")]))
        uids, others, sizes = (batch.column(c).to_pylist() for c in ("uid", "other", "n"))
        regs, texts = batch.column(names.index("regs")), batch.column(names.index("text"))
        for i, (here, uid, other) in enumerate(zip(cells, uids, others)):
            if here != cell:
                cell, sets = here, {}
            if other is None:
                sets[uid] = _Set(sizes[i], regs[i].as_py(), texts[i].as_py())
                size += 16 * sizes[i]
                continue
            pending.append((uid, other, sets[uid], sets[other]))
            if len(pending) >= PAIRS or size > FLUSH:
                yield _judged(pending)
                pending, size = [], 0
    if pending:
        yield _judged(pending)


def sketch_table(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, mark, n, digest, bands, regs) of every row, written once.

    digest ties equal sets.  bands and regs (the first ESTIMATED registers) are left out for a set
    that the task has seen before; rows without words have neither, nor a digest.  The mark is a
    hash of the text; with the key it finds the text again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("regs", pa.binary())])

    def run(batches):
        seen: OrderedDict[bytes, None] = OrderedDict()
        out, size = [], 0

        def gathered():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for key, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")):
                own = shingles(text.as_py())
                if not len(own):
                    out.append((key, mark, 0, None, None, None))
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if digest in seen:
                    out.append((key, mark, len(own), digest, None, None))
                    continue
                seen[digest] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                sketch = registers(own)
                out.append((key, mark, len(own), digest, band_keys(sketch), sketch[:ESTIMATED].tobytes()))
                size += 16 * BANDS
                if size > FLUSH:
                    yield gathered()
                    out, size = [], 0
            if len(out) > 10_000:
                yield gathered()
                out, size = [], 0
        if out:
            yield gathered()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, "doc_id bigint, mark bigint, n bigint, digest binary, bands array<bigint>, regs binary")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")


def _key(key) -> Column:
    """The key as text; a null key has one of its own."""
    return F.coalesce(key.cast("bigint").cast("string"), F.lit("null"))


def _short(df: DataFrame, label: str) -> DataFrame:
    """The frame written; broadcast if its rows, counted, are few, joined by a shuffle if not."""
    df = written(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _set_table(docs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(uid, n, regs, text) of the sets that share a bucket with another one, written.

    Repeated rows of the documents give one row of the table.
    """
    wanted = rows.select("uid", "doc_id", "mark", "n", "regs").join(
        _short(shared.select("uid").distinct(), "uids"), "uid").select("uid", _key(F.col("doc_id")).alias("_k"), "mark", "n", "regs")
    keys = _short(wanted.select("_k", "mark").distinct(), "keys")
    own = docs.select(_key(F.col("doc_id")).alias("_k"), F.xxhash64("text").alias("mark"), "text")
    texts = own.join(keys, ["_k", "mark"], "left_semi").groupBy("_k", "mark").agg(F.max("text").alias("text"))
    return written(wanted.join(texts, ["_k", "mark"]).select("uid", "n", "regs", "text"), "sets")


def _with_bands(sketches: DataFrame, keys: DataFrame) -> DataFrame:
    """(uid, n, key) of the bands whose keys are among the given ones, and of a few others."""
    shared = keys.sparkSession.sparkContext.broadcast(key_filter(keys, keys.count()))

    def run(batches):
        bits = shared.value
        for batch in batches:
            bands = batch.column("bands")
            own = bands.flatten().to_numpy(zero_copy_only=False)
            kept = has(bits, own.view(np.uint64))
            row = np.repeat(np.arange(len(bands)), bands.value_lengths().to_numpy(zero_copy_only=False))[kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(own[kept])],
                names=["uid", "n", "key"])

    return sketches.mapInArrow(run, "uid bigint, n bigint, key bigint")


def _near(a, b):
    """Whether two set sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among different pairs (a, b) of uids: by their sketches, then on their whole sets.

    Sets that are in many pairs with each other are dealt into the same blocks of bounded size,
    and pairs meet in cells of two blocks.  So a text travels once per cell, not once per pair,
    and the pairs of a set that is in very many are spread over the blocks of its partners.
    """
    pairs = written(pairs, "pairs")
    both = pairs.union(pairs.select("b", "a"))
    near = both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("g"))
    over = near.select(F.col("uid").alias("g"), F.col("g").alias("further"))
    own = near.join(over, "g", "left").join(sets.select("uid", "n"), "uid").select(
        "uid", "n", F.coalesce("further", "g").alias("g"))
    large = own.groupBy("g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    blocks = written(own.join(large, "g").select(
        "uid", "g", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block")), "blocks")
    placed = pairs
    for side in ("a", "b"):
        placed = placed.join(blocks.select(
            F.col("uid").alias(side), F.col("g").alias(f"g{side}"), F.col("block").alias(f"b{side}")), side)
    cell = ["ga", "ba", "gb", "bb"]
    placed = written(placed.select(*cell, "a", "b"), "cells")
    visits = placed.select(*cell, F.col("a").alias("uid")).union(placed.select(*cell, F.col("b").alias("uid"))).distinct()
    texts = visits.join(sets.select("uid", "n", "regs", "text"), "uid").select(
        *cell, "uid", F.lit(None).cast("bigint").alias("other"), "n", "regs", "text")
    rows = texts.unionByName(placed.select(*cell, F.col("a").alias("uid"), F.col("b").alias("other")),
                             allowMissingColumns=True)
    return rows.repartition(*cell).sortWithinPartitions(*cell, F.isnotnull("other")).mapInArrow(
        _linked, "a bigint, b bigint")


def _led(shared: DataFrame, before: DataFrame | None) -> DataFrame:
    """(a, b): for every set the leader with which it shares most buckets, a being the leader.

    The leader of a bucket is the set that meets most others in all of its buckets: the text that
    copies were made from, rather than one of them.  Leaders of the round before do not lead again.
    """
    weight = shared.groupBy("uid").agg(F.sum("k").alias("met"))
    ranked = shared.join(weight, "uid")
    if before is not None:
        ranked = ranked.join(before.select(F.col("a").alias("uid")).distinct(), "uid", "left_anti")
    leads = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("uid")).alias("last"), "n")).alias("lead")).select(
        "key", "lead.met", (-F.col("lead.last")).alias("a"), F.col("lead.n").alias("an"))
    near = shared.join(leads, "key").where("uid <> a").where(_near(F.col("n"), F.col("an")))
    counts = near.groupBy("uid", "a").agg(F.count(F.lit(1)).alias("c"), F.max("met").alias("met"))
    return counts.groupBy(F.col("uid").alias("b")).agg(
        F.max_by("a", F.struct("c", "met", -F.col("a"))).alias("a")).select("a", "b")


def _open(placed: DataFrame) -> DataFrame:
    """Rows of the buckets that hold sets of different components, with the bucket's number of sets."""
    held = placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return placed.join(held.where("lo < hi").select("key", "k"), "key")


def _shared_out(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The open rows (key, uid, n, comp, k) that may have a partner in another component, with out.

    out counts the set's shingles that some set of another component has as well: no intersection
    across components is larger.  A partner has at least the size that the threshold asks for and
    the least size in the buckets of the set.  Shingles travel once; their components are told
    and their sets counted where they meet.
    """
    def run(batches):
        for batch in batches:
            for uid, comp, text in zip(batch.column("uid").to_pylist(), batch.column("comp").to_pylist(), batch.column("text")):
                own = shingles(text.as_py()).view(np.int64)
                for c in range(0, len(own), 100_000):
                    part = own[c:c + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), uid)), pa.array(np.full(len(part), comp)), pa.array(part)],
                        names=["uid", "comp", "token"])

    whose = _short(placed.groupBy("uid").agg(F.first("comp").alias("comp")), "open-uids")
    tokens = sets.select("uid", "text").join(whose, "uid").mapInArrow(run, "uid bigint, comp bigint, token bigint")
    held = tokens.repartition("token")
    both = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    out = held.join(both, "token").groupBy("uid").agg(F.count(F.lit(1)).alias("out"))
    least = placed.join(placed.groupBy("key").agg(F.min("n").alias("low")), "key").groupBy("uid", "n").agg(F.min("low").alias("low"))
    able = out.join(least, "uid").where(
        (100 + PERCENT) * F.col("out") >= PERCENT * (F.col("n") + F.greatest("low", F.ceil(F.col("n") * PERCENT / 100)))).select("uid", "out")
    return written(_open(placed.select("key", "uid", "n", "comp").join(_short(able, "able"), "uid")), "open")


def _across(placed: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share an open bucket, where sizes and shared shingles allow a link."""
    x = placed.select("key", F.col("uid").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("out").alias("ao"))
    y = placed.select("key", F.col("uid").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("out").alias("bo"))
    enough = (100 + PERCENT) * F.least("ao", "bo") >= PERCENT * (F.col("an") + F.col("bn"))
    return x.join(y, "key").where("a < b and ac <> bc").where(_near(F.col("an"), F.col("bn"))).where(enough).select("a", "b")


def clusters(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, comp, low, copies) of every different set; comp is the smallest uid of its component.

    Equal sets are one set.  Sets that share a band meet in a bucket.  First every set is held
    against one leader, ROUNDS times, which ties large groups without listing their
    pairs; then sets of different components are paired inside buckets that are still open, if they
    have enough shingles in common with other components at all.  Open buckets of more than SMALL
    sets are cut finer: there a pair must share a second band as well.
    """
    held = written(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("uid").alias("uid"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "held")
    # the first row of a set in its task always carries the sketch, so the smallest uid does
    sketches = rows.join(held.select("uid"), "uid", "left_semi").select("uid", "n", "bands")
    posted = sketches.select(F.explode("bands").alias("key"))
    counts = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "keys")
    shared = written(_with_bands(sketches, counts).join(counts, "key"), "buckets")
    sets = _set_table(docs, rows, shared)
    links, tested, labels, left = None, None, None, shared
    for _ in range(ROUNDS):
        first = written(_led(left, tested), "led")
        found = written(_verify(first, sets), "links")
        links = found if links is None else links.union(found)
        tested = first if tested is None else tested.union(first)
        labels = components(links)
        own = labels.withColumnRenamed("node", "uid")
        left = written(_open(shared.drop("k").join(own, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))), "open")
    left = _shared_out(left, sets)
    large = left.where(F.col("k") > SMALL)
    other = large.select("uid", "n", "comp", "out", "key").join(shared.select("uid", F.col("key").alias("second")), "uid").where(
        "key <> second")
    finer = _open(other.select("uid", "n", "comp", "out", F.xxhash64(
        F.least("key", "second"), F.greatest("key", "second")).alias("key")).distinct())
    pairs = _across(left.where(F.col("k") <= SMALL)).union(_across(finer)).distinct().join(
        tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(_verify(pairs, sets), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(more))
    return held.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select(
        "digest", F.coalesce("comp", "uid").alias("comp"), "low", "copies")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component_size of every row (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing: their own key is
    their component's.  Repeated rows are linked like copies.  component_id is the smallest key of
    the component, null if it has none; kept tells whether it is the row's own, nulls being equal.
    Extra columns do not take part.
    """
    rows = sketch_table(docs)
    sets = written(clusters(docs, rows), "clusters")
    lows = sets.groupBy("comp").agg(F.min("low").alias("component_id"), F.sum("copies").alias("component_size"))
    named = sets.join(lows, "comp").select("digest", "component_id", "component_size")
    tied = rows.where(F.col("digest").isNotNull()).select("doc_id", "n", "digest").join(named, "digest").drop("digest")
    alone = rows.where(F.col("digest").isNull()).select(
        "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("component_size"))
    return tied.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component_size")


def op11_setsketch_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words),
tokens as (select r, unnest(s) as t from sets),
pairs as (
  select x.r as a, y.r as b, count(*) as both from tokens x join tokens y on x.t = y.t and x.r < y.r group by all),
links as (
  select a, b from pairs join sets x on x.r = a join sets y on y.r = b
  where 100 * pairs.both >= 80 * (len(x.s) + len(y.s) - pairs.both)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select r as a, r as b from sets
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a),
comps as (
  select reach.a, min(sets.doc_id) as component_id, count(*) as component_size
  from reach join sets on sets.r = reach.b group by reach.a)
select doc_id, len(s)::bigint as n_shingles, component_id,
       doc_id is not distinct from component_id as kept, component_size
from sets join comps on comps.a = sets.r
"""
