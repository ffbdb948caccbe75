"""N-gram Jaccard join: token-combination prefixes over word shingles, verified on whole sets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_sample, fresh, remove_tables, table, written
from ticketlens.llm.components import components

WORDS, PERCENT = 5, 75
COMBINE = 2  # tokens in a combination
RARE = 32  # tokens of at most so many sets of two blocks are counted pair by pair, others as a matrix
HOME_ROUNDS = 2  # rounds in which sets of dense groups find a home
EXTEND_PERCENT = 4  # extension of prefixes, as a share of the set
BROADCAST_ROWS = 200_000  # rows of up to three short columns that a join may broadcast, after a count
SAMPLE_DOCS = 4_000  # documents that the order of tokens is estimated on; any order is right
COMMON_PER_MILLE, COMMON_MOST = 2, 100_000  # tokens that the order puts last
REMEMBERED = 100_000  # sets that a task recognises as copies
BLOCK_SETS, BLOCK_TOKENS = 1_024, 1_000_000  # different sets, and tokens, of a component that meet as one block
COLUMNS = 4_096  # tokens that blocks are compared on at once


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text.

    bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space alone.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter(
        (digest(b" ".join(words[i:i + WORDS])) for i in range(n)), np.uint64, n))


def extension(size: int) -> int:
    """Tokens of a set's prefix that a linked partner's prefix has as well, at the least.

    A linked set shares at least PERCENT of the tokens.  The prefix leaves out that many less the
    extension, so the first common tokens, as many as the extension, are inside; the smaller of
    two extensions holds for a pair.
    """
    return max(COMBINE, EXTEND_PERCENT * size // 100)


def _extension(n) -> Column:
    return F.greatest(F.lit(COMBINE), F.floor(n * EXTEND_PERCENT / 100))


def prefix_length(size: int) -> int:
    return min(size, size - math.ceil(PERCENT * size / 100) + extension(size))


def _common_tokens(docs: DataFrame, sample_docs: int) -> np.ndarray:
    """Tokens of a large share of documents, rarest first; at most COMMON_MOST of them."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(shingles(text).view(np.int64).tolist())
        yield pa.RecordBatch.from_pydict(
            {"token": list(seen), "n": list(seen.values())},
            schema=pa.schema([("token", pa.int64()), ("n", pa.int64())]))

    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_docs)
    least = max(5, sample_docs * COMMON_PER_MILLE // 1000)
    rows = (sample.select("text").mapInArrow(count, "token bigint, n bigint")
            .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .orderBy(F.desc("n"), "token").limit(COMMON_MOST).collect())
    return np.array([r["token"] for r in rows], np.int64)[::-1].view(np.uint64)


def prefix_table(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, scratch: list[str] | None = None) -> DataFrame:
    """(uid, doc_id, mark, n, digest, prefix) of every row, written once.

    The prefix holds the first tokens of the set: those that are not common by their hash, then
    the common ones by frequency.  A task leaves it out for a set that it has seen before;
    digests tie copies together.  Rows without words have neither.  The mark is a hash of the
    text; with the key it finds the text again.
    """
    common = _common_tokens(docs, sample_docs)
    place = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[place], place.astype(np.uint64)))

    def run(batches):
        known, rank = shared.value
        seen: OrderedDict[bytes, None] = OrderedDict()
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None)
                    prefixes.append(None)
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                digests.append(digest)
                if digest in seen:
                    prefixes.append(None)
                    continue
                seen[digest] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    late = known[at] == own
                    last = own[late][np.argsort(rank[at[late]], kind="stable")]
                    own = np.concatenate([own[~late], last])
                prefixes.append(own[:prefix_length(len(own))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n", "digest", "prefix"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       "text").mapInArrow(
        run, "doc_id bigint, mark bigint, n bigint, digest binary, prefix array<bigint>")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "prefixes", scratch)


class _Sets:
    """Shingle sets of texts, the last few remembered."""

    def __init__(self, most: int = 16):
        self.kept: OrderedDict[str, np.ndarray] = OrderedDict()
        self.most = most

    def __getitem__(self, text: str) -> np.ndarray:
        if text not in self.kept:
            self.kept[text] = shingles(text)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(text)
        return self.kept[text]


def _linked(batches):
    """The pairs whose whole sets meet the threshold."""
    sets = _Sets()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            x, y = sets[a], shingles(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones among pairs (a, b) of uids; texts is (uid, text)."""
    one = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a bigint, b bigint")


def _short(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """The frame written; broadcast if its rows, counted, are few, joined by a shuffle if not."""
    df = written(df, label, scratch)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts_of(docs: DataFrame, rows: DataFrame, pairs: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(uid, text) of the rows that pairs name; once more for every repeated row."""
    uids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    wanted = rows.select("uid", "doc_id", "mark").join(_short(uids, "uids", scratch), "uid").select(
        "uid", _key(F.col("doc_id")).alias("_k"), "mark")
    own = docs.where(F.col("text").isNotNull()).select(
        _key(F.col("doc_id")).alias("_k"), F.xxhash64("text").alias("mark"), "text")
    return written(own.join(_short(wanted, "wanted", scratch), ["_k", "mark"]).select("uid", "text"), "texts", scratch)


def _key(key) -> Column:
    """The key as text; a null key has one of its own."""
    return F.coalesce(key.cast("bigint").cast("string"), F.lit("null"))


def _bound(x, y) -> Column:
    """Tokens that the prefixes of two linked sets of these sizes have in common, at the least.

    All common tokens that the prefix ending first in the order has are in the other one as well;
    what it leaves out of its own set is all that it may miss of the least intersection.
    """
    def left_out(n):
        return F.greatest(F.lit(0), F.ceil(n * PERCENT / 100) - _extension(n))

    return F.ceil((x + y) * PERCENT / (100 + PERCENT)) - F.greatest(left_out(x), left_out(y))


def _sized(x, y) -> Column:
    """Whether two set sizes allow a link."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _unsettled(placed: DataFrame, key: list[str], whose: str, scratch: list[str]) -> DataFrame:
    """The rows whose key sets of different `whose` hold, k of them, in sets with enough such rows.

    A set has its extension in common with any linked one, so sets with fewer rows fall away, and
    that settles more keys.
    """
    spark, before = placed.sparkSession, []
    held = Window.partitionBy(*key)
    for _ in range(2):
        after: list[str] = []
        found = written(placed.withColumns({
            "k": F.count(F.lit(1)).over(held), "_lo": F.min(whose).over(held), "_hi": F.max(whose).over(held),
        }).where("_lo < _hi").drop("_lo", "_hi"), "unsettled", after)
        remove_tables(spark, before)
        enough = found.groupBy("uid", "n").count().where(F.col("count") >= _extension(F.col("n"))).select("uid")
        placed, before = found.join(_short(enough, "enough", after), "uid"), after
    placed = written(placed, "unsettled", scratch)
    remove_tables(spark, before)
    return placed


def _homes(placed: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(comp, home) of components that have neighbours, and the rows that sets of other homes share.

    Every set goes to the home of the leader with which it shares the most tokens, if these are
    half of what a link needs.  The leader of a token is the set that shares most of all its
    tokens: the text that copies were made from, rather than one of them.
    """
    spark, edges, homes, before = placed.sparkSession, None, None, []
    rows = placed.withColumn("home", F.col("comp"))
    for _ in range(HOME_ROUNDS):
        after: list[str] = []
        rows = _unsettled(rows, ["token"], "home", after)
        remove_tables(spark, before)
        before = after
        met = _short(rows.groupBy("uid").agg(F.sum("k").alias("met")), "met", after)
        lead = Window.partitionBy("token").orderBy(F.desc("met"), "uid")
        led = rows.join(met, "uid").select("uid", "n", "comp", "home", *[
            F.first(c).over(lead).alias(f"lead_{c}") for c in ("uid", "n", "comp", "home")]).where("home <> lead_home")
        near = led.where(_sized(F.col("n"), F.col("lead_n"))).groupBy(
            "uid", "n", "comp", "lead_uid", "lead_n", "lead_comp").agg(F.count(F.lit(1)).alias("c")).where(
            2 * F.col("c") >= _bound(F.col("n"), F.col("lead_n")))
        found = written(near.groupBy("uid", "comp").agg(
            F.max_by("lead_comp", F.struct("c", -F.col("lead_uid"))).alias("b")).select(
            F.col("comp").alias("a"), "b").distinct(), "homeward", scratch)
        edges = found if edges is None else edges.union(found)
        homes = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("home"))
        rows = rows.drop("home").join(_short(homes, "homes", scratch), "comp", "left").withColumn(
            "home", F.coalesce("home", "comp"))
    rows = written(rows, "homed", scratch)
    remove_tables(spark, before)
    return homes, rows


def _between(rows: DataFrame, tested: DataFrame, scratch: list[str]) -> DataFrame:
    """Candidate pairs of different homes: prefixes share what a link of sets of their sizes needs.

    Sets meet by token and class of size; sizes of linked sets are in the same or in neighbouring
    classes, and the class of the larger set counts.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log((PERCENT + 25 + 1) / PERCENT)).cast("int")
    sized = rows.withColumn("own", size).withColumn("size", F.explode(F.array("own", F.col("own") + 1)))
    sized = _unsettled(sized, ["token", "size"], "home", scratch).select("token", "size", "uid", "n", "home", "own")
    x = sized.toDF("token", "size", "x", "xn", "lo", "xs")
    y = sized.toDF("token", "size", "y", "yn", "hi", "ys")
    pairs = x.join(y, ["token", "size"]).where(
        (F.col("lo") < F.col("hi")) & (F.col("size") == F.greatest("xs", "ys")) & _sized(F.col("xn"), F.col("yn")))
    pairs = pairs.groupBy("x", "y", "xn", "yn").count().where(F.col("count") >= _bound(F.col("xn"), F.col("yn")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(
        tested, ["a", "b"], "left_anti")


def _met(docs: DataFrame, rows: DataFrame, sets: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The rows of sets (uid, n, g) with text, block, lo and hi: once for every two blocks of a group that meet.

    The sets of a group g are dealt into blocks of bounded size.
    """
    large = sets.groupBy("g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = written(sets.join(_short(large, "large", scratch), "g").withColumn(
        "block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")), "dealt", scratch)
    uids = dealt.select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    texts = _texts_of(docs, rows, uids, scratch).dropDuplicates(["uid"])
    return dealt.join(texts, "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other")


def _inside(docs: DataFrame, rows: DataFrame, placed: DataFrame, homes: DataFrame, scratch: list[str]) -> DataFrame:
    """Links (a, b) that tie the components of a home: its sets are compared whole in blocks, without listing pairs."""
    able = _unsettled(placed.join(_short(homes, "homes", scratch), "comp"), ["token", "home"], "comp", scratch)
    sets = able.select("uid", "n", "comp", F.col("home").alias("g")).distinct()
    met = _met(docs, rows, sets, scratch).select("uid", "text", "comp", "block", "g", "lo", "hi")
    return met.groupBy("g", "lo", "hi").applyInArrow(_block_ties, "a bigint, b bigint")


def linked_rows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(uid, doc_id, mark, n, digest, comp) of every row; comp is the smallest uid of its component.

    Sets of shingles that are equal are tied by their digest.  Prefixes are extended so that
    linked sets share COMBINE tokens of theirs.  First every document is held against the first
    document of each of its tokens, which ties large groups without listing their pairs; then
    only documents of different components meet.  Tokens all of whose documents are in one
    component are settled.  Dense groups get a home and are compared inside it, whole and in
    blocks; between homes, documents whose prefixes share enough are paired and verified on
    their whole sets, so no link between components is lost.  Tables in between go when the next
    ones are written.
    """
    scratch: list[str] = []
    prefixes: list[str] = []
    postings: list[str] = []
    prefixed = prefix_table(docs, sample_docs, prefixes)
    rows = written(prefixed.drop("prefix"), "rows")
    equal = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("uid").alias("a"))
    copies = rows.where(F.col("digest").isNotNull()).join(equal, "digest").where("a <> uid").select(
        "a", F.col("uid").alias("b"))
    order = Window.partitionBy("token").orderBy("uid")
    posted = prefixed.where(F.col("prefix").isNotNull()).select("uid", "n", F.explode("prefix").alias("token"))
    shared = written(posted.select(
        "token", "uid", "n", F.first("uid").over(order).alias("lead"),
        F.lead("uid").over(order).alias("next")).where("lead <> uid or next is not null")
        .drop("next"), "shared-tokens", postings)
    remove_tables(docs.sparkSession, prefixes)
    # the leader with most tokens in common, if these are half of what a link needs
    near = shared.where("lead <> uid").groupBy("uid", "n", "lead").agg(F.count(F.lit(1)).alias("c")).where(
        2 * F.col("c") >= _extension(F.ceil(F.col("n") * PERCENT / 100)))
    first = written(near.groupBy("uid").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("a"))
                    .select("a", F.col("uid").alias("b")), "candidates", scratch)
    texts: list[str] = []
    links = written(_verify(first, _texts_of(docs, rows, first, texts)).union(copies), "links", scratch)
    remove_tables(docs.sparkSession, texts)
    labels = components(links)
    able = shared.groupBy("uid", "n").count().where(F.col("count") >= _extension(F.col("n"))).select("uid").join(
        labels.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("comp", "uid").alias("comp"))
    placed = _unsettled(shared.select("token", "uid", "n").join(_short(able, "able", scratch), "uid"),
                        ["token"], "comp", scratch).drop("k")
    remove_tables(docs.sparkSession, postings)
    homes, apart = _homes(placed, scratch)
    within = written(_inside(docs, rows, placed, homes, texts), "ties", scratch)
    remove_tables(docs.sparkSession, texts)
    more = written(_between(apart, first, texts), "candidates", texts)
    extra = within
    if not more.isEmpty():
        extra = written(_verify(more, _texts_of(docs, rows, more, texts)), "links", scratch).union(within)
    labels = components(labels.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(extra))
    remove_tables(docs.sparkSession, scratch)
    remove_tables(docs.sparkSession, texts)
    return rows.select("uid", "doc_id", "mark", "n", "digest").join(
        labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def link(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size of every row (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing; repeated rows are
    linked like copies; component_id is the smallest key of the component (null if it has none).
    Extra columns do not take part.
    """
    placed = linked_rows(docs, sample_docs)
    lows = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("component_size"))
    return placed.join(lows, "comp").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "component_size")


def _block_matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the sets of two blocks, and which of them are linked; a set is not linked with itself."""
    sets = [shingles(t) for t in group.column("text").to_pylist()]
    block = group.column("block").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int32)
    rare = (seen[token] > 1) & (seen[token] <= RARE)
    t, o = token[rare], owner[rare]
    for step in range(1, min(RARE, len(sets))):
        meet = np.flatnonzero(t[step:] == t[:-step])
        np.add.at(both, (o[meet], o[meet + step]), 1)
    both = (both + both.T)[np.ix_(x, y)]  # a set comes before the later ones among a token's
    frequent = seen[token] > RARE
    token, owner = (np.cumsum(seen > RARE) - 1)[token[frequent]], owner[frequent]
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, (c, c + COLUMNS))
        held = np.zeros((len(sets), int(token[b - 1]) + 1 - c), np.float32)
        held[owner[a:b], token[a:b] - c] = 1
        both += (held[x] @ held[y].T).astype(np.int32)
    linked = 100 * both >= PERCENT * (sizes[x][:, None] + sizes[y] - both)
    if lo == hi:
        np.fill_diagonal(linked, False)
    return x, y, linked


def _block_links(group: pa.Table) -> pa.Table:
    """Rows that each set of two blocks is linked with across them, or inside if they are one."""
    x, y, linked = _block_matrix(group)
    copies = group.column("copies").to_numpy()
    count = np.zeros(len(copies), np.int64)
    if group.column("lo")[0] != group.column("hi")[0]:
        count[y] = copies[x] @ linked
    count[x] = linked @ copies[y]
    return pa.table({"uid": group.column("uid"), "n_links": pa.array(count, pa.int64())})


def _block_ties(group: pa.Table) -> pa.Table:
    """A link (a, b) for every two components of two blocks that a linked pair joins, less those that follow."""
    x, y, linked = _block_matrix(group)
    _, first, label = np.unique(group.column("comp").to_numpy(), return_index=True, return_inverse=True)
    i, j = np.nonzero(linked)
    one, two = label[x[i]], label[y[j]]
    ends = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)])[:, one != two], axis=1)
    root = np.arange(len(first))
    kept = []
    for a, b in ends.T.tolist():
        ra, rb = a, b
        while root[ra] != ra:
            root[ra] = ra = root[root[ra]]
        while root[rb] != rb:
            root[rb] = rb = root[root[rb]]
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    uid = group.column("uid").to_numpy()
    kept = np.array(kept, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(uid[first[kept[:, 0]]]), "b": pa.array(uid[first[kept[:, 1]]])})


def link_counts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_shingles, n_links of every row: the other rows that it is linked with itself.

    Linked rows are in one component, so only its sets meet.  Equal sets count as one with a
    multiplicity.  The different sets of a component are dealt into blocks of bounded size; every
    two blocks are compared whole in a task that gives back sums per set, never pairs.
    """
    placed = written(linked_rows(docs, sample_docs), "placed")
    per = written(placed.where(F.col("digest").isNotNull()).groupBy("digest", "comp", "n").agg(
        F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")), "sets")
    several = per.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("comp")
    sets = per.join(_short(several, "several"), "comp").select("uid", "n", "copies", F.col("comp").alias("g"))
    near = _met(docs, placed, sets).select("uid", "text", "copies", "block", "g", "lo", "hi").groupBy(
        "g", "lo", "hi").applyInArrow(_block_links, "uid bigint, n_links bigint").groupBy("uid").agg(F.sum("n_links").alias("near"))
    counts = per.join(near, "uid", "left").select(
        "digest", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")).where("n_links > 0")
    return placed.join(_short(counts, "link-counts"), "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The input's rows and columns, one row of every component: that of the smallest key."""
    stay = linked_rows(docs, sample_docs).groupBy("comp").agg(
        F.min_by(F.struct("doc_id", "mark"), F.struct(F.isnull("doc_id"), "doc_id", "uid")).alias("r")).select(
        _key(F.col("r.doc_id")).alias(fresh(docs.columns, "_k")), F.col("r.mark").alias(fresh(docs.columns, "_m")))
    k, m = stay.columns
    found = docs.withColumns({k: _key(F.col("doc_id")), m: F.xxhash64("text")}).join(stay.distinct(), [k, m])
    return found.dropDuplicates([k, m]).select(docs.columns)


def op2_shingle_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def op2_link_counts(spark, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
tokens as (select r, unnest(s) as t from sets),
pairs as (
  select x.r as a, y.r as b, count(*) as both from tokens x join tokens y on x.t = y.t and x.r < y.r group by all),
links as (
  select a, b from pairs join sets x on x.r = a join sets y on y.r = b
  where 100 * pairs.both >= 75 * (len(x.s) + len(y.s) - pairs.both)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select r as a, r as b from sets
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a),
comps as (
  select reach.a, min(sets.doc_id) as component_id, count(*) as component_size
  from reach join sets on sets.r = reach.b group by reach.a)
select doc_id, len(s)::bigint as n_shingles, component_id, component_size
from sets join comps on comps.a = sets.r
"""

COUNTS_ORACLE = r"""
with words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
tokens as (select r, unnest(s) as t from sets),
pairs as (
  select x.r as a, y.r as b, count(*) as both from tokens x join tokens y on x.t = y.t and x.r <> y.r group by all),
links as (
  select a, count(*) as n_links from pairs join sets x on x.r = a join sets y on y.r = b
  where 100 * pairs.both >= 75 * (len(x.s) + len(y.s) - pairs.both) group by a)
select doc_id, len(s)::bigint as n_shingles, coalesce(n_links, 0)::bigint as n_links
from sets left join links on links.a = sets.r
"""
