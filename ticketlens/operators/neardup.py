"""Near-duplicate texts by trigram Jaccard similarity (Q5-Q8).

The set-similarity join is exact.  Texts with equal trigram sets collapse to their first row
before anything else, so a group of copies of any size costs one set.  Candidates come from
signatures of parts (Arasu, Ganti and Kaushik 2006): the trigrams are dealt into one part more than
a similar pair can differ in, so such a pair agrees in a whole part.  A part holds many trigrams,
which few other sets have alike.  Candidates are verified on the whole sets; texts are kept and
moved, trigrams worked out where they are needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import trigram_codes as _codes
from ticketlens.plans.scale import cut_lineage, stored

EPS = 1e-9
SKETCH = [f"w{i}" for i in range(8)]  # columns of 64 parity bits
CELL = 1 << 20  # trigrams of a block of sets that are compared with another


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every number."""
    x = x.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def trigram_sets(
    df: DataFrame,
    key: str = "ticket_id",
    text: str = "text",
    threshold: float = lx.NEAR_DUPLICATE_JACCARD,
) -> DataFrame:
    """(key, low, n, set_id, own, below, sketch) of every text long enough to have a trigram; low is lower-cased.

    The sketch deals the trigrams to bits and says which bits got an odd number: two sets differ in
    at least as many trigrams as their sketches in bits.  own and below are signatures of the parts
    of the set, for its span of sizes with the next and with the one before.  The number of parts
    grows with the size and with what may differ: about one part for 18 trigrams at 0.95, few
    trigrams a part and so more candidates at low thresholds.
    """
    spans = _spans(threshold)

    def signatures(place, worth, span):  # named by the smaller span of the two
        parts = _differ(int(spans[span + 2]) - 1, threshold) + 1
        part = (place % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begin = np.flatnonzero(np.diff(part[order], prepend=-1))
        total = np.zeros(parts, np.uint64)
        total[part[order][begin]] = np.add.reduceat(worth[order], begin)
        name = np.arange(parts, dtype=np.int64) + (np.int64(span) << 32)
        return _mixed(total ^ _mixed(name, 3), 4).view(np.int64)

    def lists(found):
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                sizes, ids, odd, own, below = [], [], [], [], []
                for low in batch.column("low").to_pylist():
                    codes = _codes(low)
                    sizes.append(len(codes))
                    ids.append(hashlib.blake2b(codes.tobytes(), digest_size=32).digest())
                    bits = (_mixed(codes, 5) % np.uint64(64 * len(SKETCH))).astype(np.int64)
                    odd.append(np.packbits((np.bincount(bits, minlength=64 * len(SKETCH)) & 1).astype(bool)).view(np.int64))
                    place, worth = _mixed(codes, 1), _mixed(codes, 2)
                    span = int(np.searchsorted(spans, len(codes), side="right")) - 1
                    own.append(signatures(place, worth, span))
                    below.append(signatures(place, worth, span - 1) if span else np.zeros(0, np.int64))
                odd = np.array(odd, np.int64).reshape(-1, len(SKETCH))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()), lists(own), lists(below),
                     *[pa.array(odd[:, i]) for i in range(len(SKETCH))]],
                    names=[*batch.schema.names, "n", "set_id", "own", "below", *SKETCH])

    # length >= 3 is the same test as a non-empty set, without building the set twice
    rows = _spread(df.where(F.length(text) >= 3).select(key, F.lower(text).alias("low")), key)
    kind = rows.schema[key].dataType.simpleString()
    # lower-casing may change the length of a text, not below three characters
    return rows.mapInArrow(run, f"`{key}` {kind}, low string, n int, set_id binary, own array<bigint>, below array<bigint>, "
                           + ", ".join(f"{w} bigint" for w in SKETCH))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Texts by key, because building the sets costs far more than moving them; where files are read
    by a task for each core as it is, nothing moves."""
    if "Exchange" not in rows._jdf.queryExecution().executedPlan().toString():
        if rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism:
            return rows
    return rows.repartition(F.col(key))


def distinct_sets(rows: DataFrame, key: str) -> DataFrame:
    """One row per distinct trigram set: (set_id, rep, n, own, below, sketch); rep is the smallest key."""
    return rows.groupBy("set_id").agg(
        F.min(key).alias("rep"), *[F.any_value(c).alias(c) for c in ["n", "own", "below", *SKETCH]])


def _differ(n: int, threshold: float) -> int:
    """Trigrams that a set of up to n and a similar one of up to n do not share, both sides together, at most.

    With a sum of sizes s, common >= t / (1 + t) * s, so s - 2 * common <= (1 - t) / (1 + t) * s.
    """
    return int((1.0 - threshold) / (1.0 + threshold) * 2 * n + EPS * (n + 4))


def _spans(threshold: float) -> np.ndarray:
    """First sizes of the spans of sizes; a similar pair is in one span or in two neighbours."""
    first = [1]
    while first[-1] < 1 << 33:
        first.append(int(first[-1] / min(threshold, 0.99)) + 1)
    return np.array(first)


def _tables(df: DataFrame, threshold: float, key: str, text: str):
    """(rows, sets, postings) of the texts, saved; only rows have the texts."""
    rows = stored(trigram_sets(df, key, text, threshold), "rows")
    every = distinct_sets(rows, key)
    sets = stored(every.select("set_id", "rep", "n", *SKETCH), "sets")
    postings = _postings(every, threshold, sets)
    _release(postings)
    return rows, sets, postings


def _postings(sets: DataFrame, threshold: float, sketches: DataFrame | None = None) -> DataFrame:
    """(token, rep, upper, n, sketch) of the signatures that several sets have; a set without any is
    similar to no other.

    upper marks those of a set's span with the one before; two sets of one span meet under the
    others.  The sets have the signatures for the threshold; their sketches may be in a saved table.
    """
    named = lambda c, upper: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(upper).alias("upper")))
    every = sets.select("rep", F.inline(F.concat(named("own", False), named("below", True))))
    # sorted once by token instead of moved twice for a count and a join
    shared = every.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_c > 1").drop("_c")
    return stored(shared.join((sketches or sets).select("rep", "n", *SKETCH), "rep"), "signatures")


def _release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of steps that are over, which it does when the driver collects garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits of the column _h, 32 for each of count and 2 ** 27 at most; full ones let more through."""
    size = min(27, max(12, (32 * count).bit_length()))
    at = f"shiftrightunsigned(_h, {64 - size})"
    rows = hashes.select(F.expr(f"shiftright({at}, 6)").alias("word"), F.expr(
        f"shiftleft(1L, cast({at} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def _texts(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, low) of the needed sets (rep, set_id); a broadcast filter keeps the other texts where they are."""
    hashed = F.xxhash64("set_id").alias("_h")
    shared = rows.sparkSession.sparkContext.broadcast(_filter(needed.select(hashed), needed.count()))

    def run(batches):
        bits, seen = shared.value, set()
        shift = np.uint64(64 - len(bits).bit_length() - 5)  # 2 ** k words of 64
        for batch in batches:
            at = batch.column("_h").to_numpy().view(np.uint64) >> shift
            may = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            once = []  # few copies of a set
            for i, name in zip(may.tolist(), batch.column("set_id").take(pa.array(may)).to_pylist()):
                if name not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(name)
                    once.append(i)
            yield batch.select(["set_id", "low"]).take(pa.array(once, pa.int64()))

    found = rows.select("set_id", "low", hashed).mapInArrow(run, "set_id binary, low string")
    return needed.join(found.groupBy("set_id").agg(F.any_value("low").alias("low")), "set_id").select("rep", "low")


def _verify(candidates: DataFrame, rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity of the candidates on their whole sets.

    The home of a set is the smallest set that it or one of its candidates is a candidate of, which
    most sets of one group share.  Homes are cut into blocks of about CELL trigrams, and pairs are
    compared in cells of two blocks: a text moves once per cell and not once per pair.
    """
    def run(batches):
        at, codes = None, {}
        for batch in batches:
            left, right, sims = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("cell", "rep_a", "rep_b", "low")]
            for cell, a, b, low in zip(*columns):
                if cell != at:
                    at, codes = cell, {}
                if low is not None:  # texts come before the pairs of their cell
                    codes.setdefault(a, []).append(_codes(low))
                    continue
                for x in codes.get(a, ()):
                    for y in codes.get(b, ()):
                        both = np.concatenate([x, y])
                        both.sort(kind="stable")  # two sorted runs, merged
                        common, total = int(np.count_nonzero(both[1:] == both[:-1])), len(both)
                        if common * (1.0 + threshold) >= total * threshold - EPS:
                            left.append(a)
                            right.append(b)
                            sims.append(common / (total - common))
            kind = batch.schema.field("rep_a").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, kind), pa.array(right, kind), pa.array(sims, pa.float64())], names=["rep_a", "rep_b", "sim"])

    pairs = stored(candidates.select("rep_a", "rep_b"), "candidates")
    near = pairs.toDF("rep", "other").union(pairs.select("rep_b", "rep_a"))
    home = near.groupBy("rep").agg(F.least("rep", F.min("other")).alias("home"))
    home = near.join(home.toDF("other", "home"), "other").groupBy("rep").agg(F.min("home").alias("home"))
    needed = stored(sets.select("set_id", "rep", "n").join(home, "rep"), "needed")
    blocks = needed.groupBy("home").agg(F.ceil(F.sum("n") / F.lit(CELL)).alias("_blocks"))
    placed = needed.join(blocks, "home").select(
        "rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).alias("block")).distinct()
    cells = stored(
        pairs.join(placed.toDF("rep_a", "block_a"), "rep_a").join(placed.toDF("rep_b", "block_b"), "rep_b")
        .select(F.xxhash64("block_a", "block_b").alias("cell"), "rep_a", "rep_b"), "cells")
    members = cells.select("cell", F.col("rep_a").alias("rep")).union(cells.select("cell", "rep_b")).distinct()
    kind = sets.schema["rep"].dataType.simpleString()
    texts = members.join(_texts(needed.select("rep", "set_id"), rows), "rep").select(
        "cell", F.col("rep").alias("rep_a"), F.lit(None).cast(kind).alias("rep_b"), "low")
    return (
        texts.union(cells.select("cell", "rep_a", "rep_b", F.lit(None).cast("string").alias("low")))
        .repartition("cell").sortWithinPartitions("cell", F.col("low").isNull())
        .mapInArrow(run, f"rep_a {kind}, rep_b {kind}, sim double")
    )


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs rep_a < rep_b that share a signature and pass the filters of length and of the sketches."""
    side = lambda df, x: df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ["rep", "n", "upper", *SKETCH]])
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in SKETCH), F.lit(0))
    may_differ = (1.0 - threshold) / (1.0 + threshold) * (F.col("n_a") + F.col("n_b"))
    return (
        side(left, "a").join(side(right, "b"), "token")
        .where(
            (F.col("rep_a") < F.col("rep_b")) & ~(F.col("upper_a") & F.col("upper_b"))
            & (F.col("n_b") >= threshold * F.col("n_a") - EPS)
            & (F.col("n_a") >= threshold * F.col("n_b") - EPS)
            & (apart <= may_differ + 1e-6)
        )
        .select("rep_a", "rep_b").distinct()
    )


def near_duplicate_pairs(
    df: DataFrame,
    threshold: float = lx.NEAR_DUPLICATE_JACCARD,
    key: str = "ticket_id",
    text: str = "text",
) -> DataFrame:
    """Q7: (id_a, id_b, sim) between the first rows of all distinct trigram sets.

    Rows with an equal set are tied to their first row by one pair with similarity 1, which
    describes a group of copies of size m with m - 1 pairs.
    """
    rows, sets, postings = _tables(df, threshold, key, text)
    between = _verify(_candidates(postings, postings, threshold), rows, sets, threshold)
    copies = (
        rows.select(key, "set_id")
        .join(sets.select("set_id", "rep"), "set_id")
        .where(F.col(key) != F.col("rep"))
        .select(F.col("rep").alias("rep_a"), F.col(key).alias("rep_b"), F.lit(1.0).alias("sim"))
    )
    return between.unionByName(copies).toDF("id_a", "id_b", "sim")


def _leader_rounds(rows, sets, postings, threshold, min_gain=0.2, max_rounds=20):
    """Thin out dense clusters without listing their pairs.

    A set that is the smallest key in every posting list it appears in has no earlier possible
    neighbour, so it is kept; sets similar to it are dropped.  A posting list holds at most one
    such leader per round, so the work of a round is linear in the postings.  Rounds go on
    while they decide a good part of the sets; the rest is left to the pair graph.
    """
    undecided = postings
    total = undecided.select("rep").distinct().count()
    kept, dropped = [], []
    for _ in range(max_rounds):
        first = undecided.groupBy("token").agg(F.min("rep").alias("first"))
        leaders = (
            undecided.join(first, "token")
            .groupBy("rep")
            .agg(F.bool_and(F.col("first") == F.col("rep")).alias("leads"))
            .where("leads")
            .select("rep")
        )
        leaders = cut_lineage(leaders)
        lead_postings = undecided.join(leaders, "rep", "left_semi")
        lost = _verify(_candidates(lead_postings, undecided, threshold), rows, sets, threshold)
        lost = cut_lineage(lost.select(F.col("rep_b").alias("rep")).distinct())
        kept.append(leaders)
        dropped.append(lost)
        decided = leaders.unionByName(lost)
        undecided = stored(undecided.join(decided, "rep", "left_anti"), "undecided")
        _release(undecided)
        left = undecided.select("rep").distinct().count()
        if left == 0 or total - left < min_gain * total:
            break
        total = left
    return undecided, kept, dropped


def _ordered_survivors(edges: DataFrame):
    """Lexicographically first independent set on edges a < b: returns the dropped keys."""
    dropped = None
    edges = cut_lineage(edges.select("rep_a", "rep_b"))
    while not edges.isEmpty():
        # a key without an undecided smaller neighbour is kept
        free = edges.select(F.col("rep_a").alias("rep")).distinct().join(
            edges.select(F.col("rep_b").alias("rep")).distinct(), "rep", "left_anti"
        )
        lost = cut_lineage(
            edges.join(free, edges["rep_a"] == free["rep"], "left_semi")
            .select(F.col("rep_b").alias("rep"))
            .distinct()
        )
        dropped = lost if dropped is None else dropped.unionByName(lost)
        rest = edges.join(lost, edges["rep_a"] == lost["rep"], "left_anti")
        rest = rest.join(lost, rest["rep_b"] == lost["rep"], "left_anti")
        rest = rest.join(free, rest["rep_a"] == free["rep"], "left_anti")
        edges = cut_lineage(rest)
    return dropped


def near_duplicate_drops(
    df: DataFrame,
    threshold: float = lx.NEAR_DUPLICATE_JACCARD,
    key: str = "ticket_id",
    text: str = "text",
    dense_factor: int = 50,
) -> DataFrame:
    """Keys that Q8 removes, with the set they belong to."""
    rows, sets, postings = _tables(df, threshold, key, text)
    load = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("postings"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")
    ).first()
    dropped = []
    rest = postings
    if load["postings"] and load["pairs"] > dense_factor * load["postings"]:
        rest, _, dropped = _leader_rounds(rows, sets, postings, threshold)
    edges = _verify(_candidates(rest, rest, threshold), rows, sets, threshold)
    lost = _ordered_survivors(edges)
    reps = [d for d in [*dropped, lost] if d is not None]
    members = rows.select(key, "set_id").join(sets.select("set_id", "rep"), "set_id")
    if not reps:
        return members.where(F.col(key) != F.col("rep")).select(key)
    gone = reps[0]
    for r in reps[1:]:
        gone = gone.unionByName(r)
    marked = members.join(gone.distinct().withColumn("_gone", F.lit(True)), "rep", "left")
    return marked.where(F.col("_gone").isNotNull() | (F.col(key) != F.col("rep"))).select(key)


def drop_near_duplicates(
    df: DataFrame,
    threshold: float = lx.NEAR_DUPLICATE_JACCARD,
    key: str = "ticket_id",
    text: str = "text",
) -> DataFrame:
    """Q8: greedy in key order; a row goes when it is similar to an earlier row that stays."""
    return df.join(near_duplicate_drops(df, threshold, key, text), key, "left_anti")
