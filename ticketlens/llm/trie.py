"""Conversation prefix trie: sorted neighbours, union-find over their common prefixes, merged forests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written
from ticketlens.llm.ranks import running_totals

SHARE, HEADS = 100, 6  # conversations c - c % SHARE lend their first crc32(c) % HEADS turns
BAND = 64  # turns of a conversation in one row; longer ones have several
BLOCK = 1 << 16  # rows of one forest
BROADCAST_ROWS = 200_000  # rows of two short columns that a join may broadcast, after a count
MARK = 32  # characters of a turn's mark in a key
NO_ENDS = hashlib.sha256(b"").hexdigest()
ORDER = ("band", "start", "key", "c")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(c, p, mark, n) of every turn, written: place in its conversation, digest and code points.

    Turns are ordered by turn (null first), rows of one turn by role and digest of role and text.
    The table is sorted over all tasks at once, so a long conversation spans several of them; the
    few that do get the counts of the tasks before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("mark"),
        F.length(text).cast("bigint").alias("n"))

    def number(batches):
        part = TaskContext.get().partitionId()
        first = last = None
        seen = 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            first = c[0] if first is None else first
            new = np.concatenate([[True], c[1:] != c[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            local = np.arange(len(c)) - start + 1
            if last is not None and c[0] == last:
                local[:int(np.argmax(c != c[0])) or len(c)] += seen
            last, seen = c[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.array(np.full(len(c), part, np.int32)), pa.array(local.astype(np.int64)),
                 pa.array(c == first), batch.column("mark"), batch.column("n")],
                names=["c", "part", "local", "edge", "mark", "n"])

    keys = ["c", "turn", "role", "mark"]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        number, "c bigint, part int, local bigint, edge boolean, mark string, n bigint"), "turns")
    # one conversation per task at most starts before it
    spanning = placed.where("edge and local = 1").select("c").distinct()
    counts = placed.join(F.broadcast(spanning), "c").groupBy("c", "part").agg(F.max("local").alias("k"))
    earlier = counts.alias("x").join(counts.alias("y"), F.expr("x.c = y.c and x.part < y.part")).groupBy(
        F.col("y.c").alias("c"), F.col("y.part").alias("part")).agg(F.sum("x.k").alias("before"))
    return placed.join(F.broadcast(earlier), ["c", "part"], "left").select(
        "c", (F.col("local") + F.coalesce("before", F.lit(0))).alias("p"), "mark", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, depth, mark, n, length) of the rebuilt turns; a null depth states a conversation as such."""
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    own = turns.groupBy("c").agg(F.max("p").alias("own"))
    heads = turns.where((F.col("c") % SHARE == 0) & (F.col("p") < HEADS)).groupBy(F.col("c").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("p", "mark", "n"))).alias("lent"))
    convs = own.select("c", "own", head.cast("int").alias("h"), (F.col("c") - F.col("c") % SHARE).alias("base")).join(
        heads, "base", "left")
    lent = F.when(F.col("lent").isNull() | (F.col("h") == 0), F.array().cast("array<struct<p:bigint,mark:string,n:bigint>>")
                  ).otherwise(F.slice("lent", 1, F.greatest("h", F.lit(1))))
    convs = written(convs.select("c", "h", lent.alias("lent")).withColumn("k", F.size("lent").cast("bigint")).join(
        own, "c").withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    first = convs.select("c", F.explode("lent").alias("x"), "length").select("c", F.col("x.p").alias("depth"), "x.mark", "x.n", "length")
    rest = turns.join(convs.select("c", "h", "k", "length"), "c").where("p > h").select(
        "c", (F.col("p") - F.col("h") + F.col("k")).alias("depth"), "mark", "n", "length")
    stub = convs.select("c", F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("mark"),
                        F.lit(None).cast("bigint").alias("n"), "length")
    return first.union(rest).union(stub)


def _along(rows: DataFrame, place: Column, sums: dict[str, str]) -> DataFrame:
    """Adds running sums over the rows before in a conversation, by a place counted from 0."""
    total, top = rows.agg(F.count(F.lit(1)), F.max(place)).first()
    width = len(f"{top:x}")
    return running_totals(rows.withColumn("_o", F.lpad(F.hex(place), width, "0")), F.col("c"), "_o", sums, [], total).drop("_o")


def band_rows(turns: DataFrame, size: int = BAND) -> DataFrame:
    """(c, band, start, next, key, chars, last, many) of every conversation, written.

    A row holds up to `size` turns: the marks as one key, so that keys sort like sequences and a
    prefix comes first.  A conversation ends in its last row, which has fewer than `size` turns,
    maybe none.  start and next name the sequences of turns before and behind the row by two
    64-bit hashes of all their marks, summed; the empty sequence has an empty name.
    """
    band = F.when(F.col("depth").isNull(), F.floor(F.col("length") / size)).otherwise(F.floor((F.col("depth") - 1) / size))
    sums = [F.sum(F.xxhash64(F.lit(s), "depth", "mark").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)]
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "mark", "n"))
    rows = turns.groupBy("c", band.cast("bigint").alias("band"), "length").agg(
        F.sort_array(F.collect_list(turn)).alias("t"), *sums).select(
        "c", "band", F.array_join(F.transform("t", lambda x: x["mark"]), "").alias("key"),
        F.transform("t", lambda x: x["n"]).alias("chars"),
        (F.col("band") == F.floor(F.col("length") / size)).alias("last"), (F.col("length") >= size).alias("many"),
        *[F.coalesce(f"s{s}", F.lit(0).cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)])
    rows = written(rows, "bands")
    none = F.lit(None).cast("string")
    short = rows.where("not many").select("c", "band", F.lit("").alias("start"), none.alias("next"), "key", "chars", "last", "many")
    long = rows.where("many")
    if long.isEmpty():
        return short
    long = _along(long, F.col("band"), {"p1": "s1", "p2": "s2"})

    def name(ahead, one, two):
        return F.md5(F.concat_ws("|", ahead.cast("string"), one.cast("string"), two.cast("string")).cast("binary"))

    p1, p2 = (F.col(p).cast("decimal(38,0)") for p in ("p1", "p2"))
    behind = name(F.col("band") + 1, (p1 + F.col("s1")).cast("decimal(38,0)"), (p2 + F.col("s2")).cast("decimal(38,0)"))
    long = long.select("c", "band", F.when(F.col("band") == 0, "").otherwise(name(F.col("band"), p1, p2)).alias("start"),
                       F.when(F.size("chars") == size, behind).alias("next"), "key", "chars", "last", "many")
    return short.union(long)


def _common(a: str, b: str) -> int:
    """Turns that two keys have in common from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // MARK
    k = 0
    while a[k:k + MARK] == b[k:k + MARK]:
        k += MARK
    return k // MARK


def _neighbours(batches):
    """Adds the turns in common with the row before and behind; -1 in another band or behind another start.

    Null where the task has no such row.
    """
    held, before, gap = None, None, None

    def out(batch, lcp):
        arrays = [batch.column(c) for c in ("c", "band", "start", "next", "key", "chars", "last", "many")]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(lcp[:-1], pa.int32()), pa.array(lcp[1:], pa.int32())],
            names=["c", "band", "start", "next", "key", "chars", "last", "many", "up", "down"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("band", "start", "key")]))
        lcp = []
        for row in rows:
            if before is None:
                lcp.append(None)
            else:
                lcp.append(_common(before[2], row[2]) if before[:2] == row[:2] else -1)
            before = row
        if held is not None:
            yield out(held, [*gap, lcp[0]])
        held, gap = batch, lcp
    if held is not None:
        yield out(held, [*gap, None])


def sorted_neighbours(bands: DataFrame) -> DataFrame:
    """band_rows with up and down, the turns in common with the sorted neighbours, written.

    Rows at the edge of a task meet their neighbours in one small task, two rows of every task.
    """
    kind = ("c bigint, band bigint, start string, next string, key string, chars array<bigint>, "
            "last boolean, many boolean, up int, down int")
    rows = written(bands.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, kind), "neighbours")
    edges = rows.where("up is null or down is null").drop("up", "down")
    fixed = written(edges.repartition(1).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, kind).select(
        "c", "band", F.col("up").alias("up2"), F.col("down").alias("down2")), "edges")
    return rows.join(F.broadcast(fixed), ["c", "band"], "left").withColumns(
        {"up": F.coalesce("up", "up2", F.lit(-1)), "down": F.coalesce("down", "down2", F.lit(-1))}).drop("up2", "down2")


def weighed(rows: DataFrame) -> DataFrame:
    """Adds leaf, fresh and total of every row, those of the conversation's later rows included.

    leaf tells that the conversation ends in a node without children and is the last there; fresh
    adds the code points of the nodes that the row is the first to reach, total those of all.
    """
    size = F.size("chars")
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    own = rows.withColumns({
        "leaf": (F.col("last") & (F.col("down") < size)).cast("bigint"), "total": add(F.col("chars")),
        "fresh": add(F.slice("chars", F.greatest(F.col("up"), F.lit(0)) + 1, size))})
    long = own.where("many")
    none = [F.lit(0).cast("bigint").alias(f"t_{c}") for c in ("leaf", "fresh", "total")]
    short = own.where("not many").select("*", *none)
    if long.isEmpty():
        return short
    long = written(long, "long")
    top = long.agg(F.max("band")).first()[0]
    tails = _along(long.select("c", "band", "leaf", "fresh", "total"), F.lit(top) - F.col("band"),
                   {f"t_{c}": c for c in ("leaf", "fresh", "total")}).drop("leaf", "fresh", "total")
    return short.unionByName(long.join(tails, ["c", "band"]).withColumns(
        {f"t_{c}": F.col(f"t_{c}").cast("bigint") for c in ("leaf", "fresh", "total")}))


def _merge(up: np.ndarray, size: np.ndarray, c: np.ndarray):
    """Union-find over the edges between sorted neighbours, deepest first.

    Returns chains of nodes as (lo, hi, smallest, from, to, children of the last, chain above):
    the rows lo to hi share the nodes of depth from to to.  Merging components at a depth makes
    the branching node there; what stood above it in each is a finished chain.  up of the first
    row is what it shares with rows outside: a child counted there is not counted again.
    """
    m = len(size)
    link = list(range(m))
    lo, hi, least, top = list(range(m)), [r + 1 for r in range(m)], c.tolist(), size.tolist()
    kids, waiting = [0] * m, [[] for _ in range(m)]
    chains: list[list] = []
    outside = int(up[0]) if m else -1

    def find(r):
        while link[r] != r:
            link[r] = link[link[r]]
            r = link[r]
        return r

    def close(r, depth):
        """The chain of the component above a depth."""
        for child in waiting[r]:
            chains[child][6] = len(chains)
        waiting[r] = [len(chains)]
        chains.append([lo[r], hi[r], least[r], depth + 1, top[r], kids[r], -1])
        top[r], kids[r] = depth, 0 if lo[r] == 0 and outside > depth else 1

    edges = np.flatnonzero(up[1:] >= 0) + 1
    for r in edges[np.argsort(-up[edges], kind="stable")].tolist():
        depth = int(up[r])
        a, b = find(r - 1), find(r)
        if top[a] > depth:
            close(a, depth)
        if top[b] > depth:
            close(b, depth)
        if hi[a] - lo[a] < hi[b] - lo[b]:
            a, b = b, a
        link[b] = a
        lo[a], hi[a], least[a] = min(lo[a], lo[b]), max(hi[a], hi[b]), min(least[a], least[b])
        kids[a] += kids[b]
        waiting[a].extend(waiting[b])
        waiting[b] = []
    for r in {find(r) for r in range(m)}:
        close(r, -1)
    return chains


FOREST = pa.schema([
    ("open", pa.bool_()), ("id", pa.string()), ("parent", pa.string()), ("parent_conv_id", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends_sha256", pa.string()), ("first", pa.int64()),
    ("ends", pa.string())])


def _forest(block: pa.Table, most: int):
    """Rows of the nodes of a block of sorted rows with up to `most` turns each.

    A node whose rows may go on outside the block is open: it has an id and what the block adds to
    its sums.  Its ends are a piece of the list, to be hashed in order.  Other nodes are complete;
    their parents are known, or named by id where open.
    """
    block = block.combine_chunks()
    c, band, up, down = (block.column(x).to_numpy() for x in ("c", "band", "up", "down"))
    start, behind, key = (block.column(x).to_pylist() for x in ("start", "next", "key"))
    chars = block.column("chars").combine_chunks()
    size = chars.value_lengths().to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([[0], np.cumsum(chars.flatten().to_numpy())])
    m = len(c)

    def along(row, k):
        """Code points of the first k turns of a row."""
        return flat[at[row] + k] - flat[at[row]]

    added = {x: np.concatenate([[0], np.cumsum(block.column(x).to_numpy() + block.column("t_" + x).to_numpy())])
             for x in ("leaf", "fresh", "total")}
    chains = _merge(up.astype(np.int64), size, c)
    lo, hi, least, low, high, kids, above = (np.array(v, np.int64) for v in zip(*chains))
    count = high - low + 1
    which = np.repeat(np.arange(len(chains)), count)
    depth = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    lo, hi, last = lo[which], hi[which], depth == high[which]
    seen = np.maximum(up[lo], 0)
    children = np.where(last, kids[which], np.where((lo == 0) & (up[0] > depth), 0, 1))
    n = hi - lo
    before = np.maximum(depth - 1, 0)
    total = added["total"][hi] - added["total"][lo] - n * along(lo, before)
    fresh = added["fresh"][hi] - added["fresh"][lo] - (along(lo, np.maximum(before, seen)) - along(lo, seen))
    leaves = added["leaf"][hi] - added["leaf"][lo]
    joint = (depth == most) | ((depth == 0) & (band[lo] > 0))
    opened = ((lo == 0) & (up[0] >= depth)) | ((hi == m) & (down[-1] >= depth)) | joint
    # rows of one key stand together, those that end in a node before all others of it
    runs = np.concatenate([np.flatnonzero(np.concatenate([[True], (up[1:] != size[1:]) | (size[1:] != size[:-1])])), [m]])
    run_end = runs[np.searchsorted(runs, lo, side="right")]

    def name(row, d):
        if d == 0:
            return f"{band[row]}:{start[row]}"
        if d == most:
            return f"{band[row] + 1}:{behind[row]}"
        return hashlib.md5(f"{band[row]}:{start[row]}:{key[row][:MARK * d]}".encode()).hexdigest()

    first_of = np.cumsum(count) - count  # where the nodes of a chain start
    out = {f.name: [] for f in FOREST}
    ids: dict[int, str] = {}

    def id_of(i):
        if i not in ids:
            ids[i] = name(int(lo[i]), int(depth[i]))
        return ids[i]

    top_of = first_of + count - 1
    for i in range(len(which)):
        d, row, chain = int(depth[i]), int(lo[i]), int(which[i])
        parent = i - 1 if d > low[chain] else int(top_of[above[chain]]) if above[chain] >= 0 else -1
        is_open = bool(opened[i])
        lower = d == 0 and band[row] > 0  # the sums of this node come with the band before
        out["open"].append(is_open)
        out["id"].append(id_of(i) if is_open else None)
        out["parent"].append(id_of(parent) if parent >= 0 and opened[parent] else None)
        out["parent_conv_id"].append(int(least[which[parent]]) if parent >= 0 and not opened[parent] else None)
        out["conv_id"].append(None if lower else int(least[chain]))
        out["depth"].append(int(band[row]) * most + d)
        out["n_convs"].append(0 if lower else int(n[i]))
        out["n_children"].append(int(children[i]))
        out["n_leaves"].append(0 if lower else int(leaves[i]))
        out["saved"].append(0 if lower else int(total[i] - fresh[i]))
        text = None
        if last[i] and size[row] == d and d < most:
            text = ",".join(map(str, c[row:run_end[i]].tolist()))
        out["ends_sha256"].append(None if is_open else hashlib.sha256(text.encode()).hexdigest() if text else NO_ENDS)
        out["first"].append(int(c[row]) if is_open and text else None)
        out["ends"].append(text if is_open else None)
        if len(out["open"]) >= 10_000:
            yield pa.RecordBatch.from_pydict(out, schema=FOREST)
            out = {f.name: [] for f in FOREST}
    if out["open"]:
        yield pa.RecordBatch.from_pydict(out, schema=FOREST)


def _forests(most: int, block: int):
    """Task function: the forests of blocks of rows, as they come."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == block:
                    yield from _forest(pa.Table.from_batches(held), most)
                    held, rows = [], 0
        if rows:
            yield from _forest(pa.Table.from_batches(held), most)

    return run


def _hashes(batches):
    """(id, ends_sha256) of lists that come in pieces, in order; nothing of them is kept."""
    now, state, any_before = None, None, False
    done: list[tuple[str, str]] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["id", "ends_sha256"])

    for batch in batches:
        for name, ends in zip(batch.column("id"), batch.column("ends")):
            name = name.as_py()
            if name != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state, any_before = name, hashlib.sha256(), False
            if any_before:
                state.update(b",")
            state.update(ends.as_py().encode())
            any_before = True
        if len(done) > 10_000:
            yield out()
            done = []
    if now is not None:
        done.append((now, state.hexdigest()))
    if done:
        yield out()


def prefix_trie(conversations: DataFrame, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations (conv_id, turn, role, text) are rebuilt from the first turns of those that they
    start like.  Their sequences are sorted over all tasks; in blocks of sorted rows union-find
    over the common prefixes of neighbours, deepest first, makes the forest of the block; nodes at
    the edges of blocks are contracted to their sums and merged by name.  Null roles and texts are
    empty, a null turn comes first; rows of one turn are ordered by role and digest, repeated rows
    are turns of their own.  Rows without conv_id belong to no conversation.  An empty table has
    no nodes.  Other columns do not take part.  Turns are compared by 128-bit digests.  `band` turns
    are a row and `block` rows a forest; neither changes the result.
    """
    rows = weighed(sorted_neighbours(band_rows(rebuilt(turn_rows(conversations)), band)))
    kind = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'string' if f.type == pa.string() else 'bigint'}" for f in FOREST)
    columns = [*ORDER, "next", "chars", "up", "down", *[p + x for p in ("", "t_") for x in ("leaf", "fresh", "total")]]
    nodes = written(rows.select(*columns).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_forests(band, block), kind), "forests")
    pieces = nodes.where("open and ends is not null").select("id", "first", "ends")
    hashes = pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_hashes, "id string, ends_sha256 string")
    merged = nodes.where("open").groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("parent_conv_id").alias("parent_conv_id"), F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"), *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")])
    merged = written(merged.join(hashes, "id", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "merged")
    complete = nodes.where("not open").select(*[c for c in merged.columns if c != "id"]).unionByName(merged.drop("id"))
    names = merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("found"))
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    known = complete.where("parent is null").withColumn("found", F.lit(None).cast("bigint"))
    named = complete.where("parent is not null").join(names, "parent")
    return known.unionByName(named).select(
        "conv_id", "depth", F.coalesce("found", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
with own as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
  from conversations where conv_id is not null),
ids as (select c, max(p) as n_own, c::varchar as s from own group by c),
crc as (
  select c, n_own, c - c % 100 as base,
         (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(s, ''), lambda x: ascii(x)::bigint)),
           lambda a, x: list_reduce(list_prepend(xor(a, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, i: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint)) % 6 as h
  from ids),
convs as (
  select x.c, x.h, x.base, least(x.h, coalesce(b.n_own, 0)) as k,
         least(x.h, coalesce(b.n_own, 0)) + greatest(0, x.n_own - x.h) as len
  from crc x left join ids b on b.c = x.base),
seq as (
  select v.c, o.p as d, o.role, o.text from convs v join own o on o.c = v.base and o.p <= v.k
  union all
  select v.c, o.p - v.h + v.k, o.role, o.text from convs v join own o on o.c = v.c and o.p > v.h),
marked as (
  select c, d, length(text) as chars,
         string_agg(md5(length(role) || ':' || role || text), '') over (partition by c order by d) as path
  from seq
  union all
  select c, 0, 0, '' from convs),
nodes as (
  select path, d, any_value(chars) as chars, min(c) as conv_id, count(*) as n_convs from marked group by path, d),
kids as (select left(path, length(path) - 32) as path, count(*) as n_children from nodes where d > 0 group by 1),
ends as (
  select m.path, string_agg(m.c::varchar, ',' order by m.c) as list
  from marked m join convs v on v.c = m.c and v.len = m.d group by m.path),
below as (
  select a.path, sum((n.n_convs - 1) * n.chars)::bigint as saved_tokens,
         sum(case when k.path is null then 1 else 0 end)::bigint as n_leaves
  from nodes n join marked a on a.c = n.conv_id and a.d <= n.d left join kids k on k.path = n.path group by a.path)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
       b.n_leaves, b.saved_tokens, sha256(coalesce(e.list, '')) as ends_sha256
from nodes n left join kids k on k.path = n.path left join ends e on e.path = n.path join below b on b.path = n.path
left join nodes p on n.d > 0 and p.path = left(n.path, length(n.path) - 32)
"""
