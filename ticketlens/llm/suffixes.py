"""Removal of long repeated byte strings by a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 24  # bytes whose smallest hash in a string samples it
SPAN = LENGTH - GRAM + 1
RUN = 200  # most strings in one sampled suffix
ROWS_PER_INDEX = 2_000_000  # entries that one index family holds
TEXT_PER_ENTRY = 24  # bytes of text per sampled suffix at the least
WIDE_CLASS = 4_096  # open suffixes of one anchor that are compared side by side in one task
FIRST_KEY = -(1 << 63)  # rows without key stand before all others

_ODD = 0x9E3779B97F4A7C15
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little")
                   for i in range(256)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest answer is remembered."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done:2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any substring of one text in constant time."""

    def __init__(self, data: bytes):
        n = len(data)
        values = _BYTES[np.frombuffer(data, np.uint8)]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_ODD, n), out=self.total[1:])
        self.undo = _power(pow(_ODD, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[start]) * self.undo[start]
                    + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of that many bytes."""
        return _mix((self.total[size:] - self.total[:-size]) * self.undo[:len(self.total) - size]
                    + np.uint64(size))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def sampled(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, start, strings) of the sampled suffixes of one text.

    The anchor of a string of LENGTH bytes is the smallest hash among its grams, so equal strings
    have equal anchors.  A sampled suffix stands for the maximal run of strings, RUN at most,
    that begin at `start` one after another and share an anchor; the digest covers all of them.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    rolling = Rolling(data)
    low = _sliding_min(rolling.every(GRAM), SPAN)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.append(start, n))
    if size.max() > RUN:
        parts = -(-size // RUN)
        first = np.repeat(start, parts)
        within = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(start + size, parts)
        start = first + within * RUN
        size = np.minimum(RUN, end - start)
    return low[start], rolling.of(start, start + size + LENGTH - 1), start, size


def _check(data: bytes) -> int:
    """23 bits of the text, to tell rows with one key apart."""
    return zlib.crc32(data) & 0x7FFFFF


_ENTRY = pa.schema([(c, pa.int64()) for c in ("anchor", "digest", "doc", "place")])
_ENTRY_DDL = "anchor bigint, digest bigint, doc bigint, place bigint"
_HIT_DDL = "doc bigint, place bigint, strings bigint, anchor bigint"


def _entries(batches):
    """Sampled suffixes of the texts.  Among those that repeat within an Arrow batch only the
    one of the smallest key goes on to the index; the others are known to be repeated, which the
    complement of their place says, and are dealt out by document."""
    for batch in batches:
        parts = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            anchor, digest, start, size = sampled(data)
            if len(anchor):
                place = (np.int64(_check(data)) << 40) | (start << 8) | size
                parts.append((anchor, digest, np.full(len(anchor), doc), place))
        if not parts:
            continue
        anchor, digest, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, doc, digest))
        anchor, digest, doc, place = anchor[order], digest[order], doc[order], place[order]
        first = np.maximum.accumulate(np.where(np.diff(digest, prepend=~digest[:1]) != 0,
                                               np.arange(len(digest)), 0))
        known = doc > doc[first]
        # a suffix of the same key that repeats inside its text is found there
        again = (np.arange(len(digest)) != first) & (doc == doc[first]) & (place >> 40 == place[first] >> 40)
        anchor = np.where(known, _mix(doc.view(np.uint64)), anchor)
        columns = (anchor.view(np.int64), digest.view(np.int64), doc, np.where(known, ~place, place))
        yield pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in columns], schema=_ENTRY)


class Level:
    """One sorted array of the family: suffixes by anchor and digest, the first of each."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[np.lexsort((rows["digest"], rows["anchor"]))]
        self.by_digest = np.argsort(self.rows["digest"], kind="stable")
        self.digests = self.rows["digest"][self.by_digest]

    def __len__(self) -> int:
        return len(self.rows)

    def first(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a digest is there, and its row."""
        at = np.minimum(np.searchsorted(self.digests, digests), len(self.digests) - 1)
        return self.digests[at] == digests, self.by_digest[at]


class Family:
    """Levels of geometric sizes.  Batches must come in the order of their keys."""

    KIND = np.dtype([("anchor", "<i8"), ("digest", "<i8"), ("doc", "<i8"), ("place", "<i8"), ("open", "?")])

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch; returns its repeated suffixes, and suffixes that became open.

        A suffix is repeated if an equal one of a smaller key came before.  It is open if a
        different one has its anchor: their strings may be equal in part.
        """
        new = new[np.lexsort((new["place"], new["doc"], new["digest"]))]
        edge = np.diff(new["digest"], prepend=new["digest"][:1] ^ 1) != 0
        first = np.maximum.accumulate(np.where(edge, np.arange(len(new)), 0))
        old_doc = new["doc"][first]  # key of the first equal suffix so far
        seen = ~edge
        for level in self.levels:
            there, at = level.first(new["digest"])
            old_doc = np.where(there, np.minimum(old_doc, level.rows["doc"][at]), old_doc)
            seen |= there
        repeated = new[old_doc < new["doc"]]
        # rows of one key with other texts keep their own place in the index
        fresh = new[~seen | ((old_doc == new["doc"]) & seen & ~self._same(new, first))]
        opened = []
        if len(fresh):
            fresh = np.sort(fresh, order=["anchor", "digest"])
            one = np.diff(fresh["anchor"], prepend=fresh["anchor"][:1] ^ 1) != 0
            fresh["open"] |= ~one
            fresh["open"][:-1] |= ~one[1:]
            anchors = np.unique(fresh["anchor"])
            for level in self.levels:
                own = level.rows["anchor"]
                lo, hi = np.searchsorted(own, anchors), np.searchsorted(own, anchors, side="right")
                hit = hi > lo
                fresh["open"] |= np.isin(fresh["anchor"], anchors[hit])
                for a, b in zip(lo[hit], hi[hit]):
                    rows = level.rows[a:b]
                    waiting = ~rows["open"]
                    if waiting.any():
                        opened.append(rows[waiting].copy())
                        rows["open"] = True
            opened.append(fresh[fresh["open"]])
            self._insert(Level(fresh))
        return repeated, np.concatenate(opened) if opened else new[:0]

    @staticmethod
    def _same(new: np.ndarray, first: np.ndarray) -> np.ndarray:
        return new["place"] >> 40 == new["place"][first] >> 40

    def _insert(self, level: Level) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = Level(np.concatenate([self.levels.pop().rows, level.rows]))
        self.levels.append(level)


def _indexed(batches):
    """One index family over the entries of a partition, which come in the order of their keys."""
    family = Family()

    def told(rows, is_open):
        anchor = pa.array(rows["anchor"]) if is_open else pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["doc"]), pa.array(rows["place"] >> 8), pa.array(rows["place"] & 0xFF), anchor],
            names=["doc", "place", "strings", "anchor"])

    for batch in batches:
        rows = np.zeros(batch.num_rows, Family.KIND)
        for c in ("anchor", "digest", "doc", "place"):
            rows[c] = batch.column(c).to_numpy()
        known = rows["place"] < 0
        rows["place"] = np.where(known, ~rows["place"], rows["place"])
        yield told(rows[known], False)
        if not known.all():
            repeated, opened = family.add(rows[~known])
            yield told(repeated, False)
            yield told(opened, True)


def _opened(batches):
    """What is under the open suffixes of the texts: (key, doc, place, part).

    Suffixes whose anchor few others have travel as bytes, by their anchor.  Those of wide classes
    travel string by string, by hash, once for each Arrow batch and string; what repeats inside a
    batch has place complemented.
    """
    for batch in batches:
        key, docs, places, parts = [], [], [], []
        first: dict[bytes, int] = {}
        wide = []
        order = np.argsort(batch.column("doc").to_numpy(), kind="stable")
        columns = [batch.column(c).to_pylist() for c in ("doc", "text", "hits")]
        for doc, text, hits in (tuple(c[i] for c in columns) for i in order.tolist()):
            hits = [h for h in hits or () if h["anchor"] is not None]
            if not hits:
                continue
            data = text.encode("utf-8", "surrogatepass")
            own = _check(data)
            for h in hits:
                if h["place"] >> 32 != own:
                    continue
                at, n = h["place"] & 0xFFFFFFFF, h["strings"]
                if not h["wide"]:
                    key.append(h["anchor"])
                    docs.append(doc)
                    places.append(h["place"])
                    parts.append(data[at:at + n + LENGTH - 1])
                    continue
                for k in range(at, at + n):
                    part = hashlib.blake2b(data[k:k + LENGTH], digest_size=16).digest()
                    early = first.setdefault(part, doc)
                    wide.append((part, doc, (own << 32) | k, early < doc))
        for part, doc, place, again in wide:
            key.append(int.from_bytes(part[:8], "little", signed=True) if not again else place ^ doc)
            docs.append(doc)
            places.append(~place if again else place)
            parts.append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()),
             pa.array(parts, pa.binary())], names=["key", "doc", "place", "part"])


def _compared(batches):
    """(doc, place, strings): runs of strings that an earlier document has, of sorted rows."""
    key, first = None, {}
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for k, doc, place, part in zip(*(c.to_pylist() for c in batch.columns)):
            if place < 0:
                out.append((doc, ~place, 1))
                continue
            if k != key:
                key, first = k, {}
            strings = len(part) - LENGTH + 1
            if strings < 1:  # a digest of one string
                if first.setdefault(part, doc) < doc:
                    out.append((doc, place, 1))
                continue
            run = 0
            for i in range(strings):
                if first.setdefault(part[i:i + LENGTH], doc) < doc:
                    run += 1
                elif run:
                    out.append((doc, place + i - run, run))
                    run = 0
            if run:
                out.append((doc, place + strings - run, run))
        columns = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["doc", "place", "strings"])


def removed_strings(data: bytes, repeated: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the bytes to remove: under strings repeated elsewhere or earlier in the text."""
    n = len(data) - LENGTH + 1
    mask = np.zeros(len(data), bool)
    if n <= 0:
        return mask
    edge = np.zeros(len(data) + 1, np.int64)
    for a, k in repeated:
        edge[a] += 1
        edge[a + k + LENGTH - 1] -= 1
    own = Rolling(data).every(LENGTH)
    order = np.argsort(own, kind="stable")
    again = order[1:][own[order[1:]] == own[order[:-1]]]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cleaned(batches):
    for batch in batches:
        rows = []
        for key, text, hits, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits", "more"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            own = _check(data)
            spots = [(h["place"] & 0xFFFFFFFF, h["strings"]) for h in (hits or []) + (more or [])
                     if h["anchor"] is None and h["place"] >> 32 == own]
            mask = removed_strings(data, spots)
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            spans = int(np.count_nonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1))
            rows.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(columns[k], pa.int64()) for k in range(4)), pa.array(columns[4], pa.string()),
             pa.array(columns[5], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    Suffixes are sampled at content-defined places and move once, as digests, to an index family
    per partition, in the order of keys: every batch becomes a sorted array, is scanned against
    the levels and merged with levels of its size.  Where sampled suffixes agree in their anchor
    only, the strings below them are compared one by one.

    A null text counts as empty.  Rows without key stand before all others; rows with equal keys
    are never earlier than one another, but every row is judged.  Texts below LENGTH bytes keep
    all of theirs.  Extra columns do not take part.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_KEY)).alias("doc"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-size // (TEXT_PER_ENTRY * ROWS_PER_INDEX)))
    entries = rows.where(F.octet_length("text") >= LENGTH).select("doc", "text").mapInArrow(_entries, _ENTRY_DDL)
    hits = written(entries.repartition(parts, "anchor").sortWithinPartitions("doc")
                   .mapInArrow(_indexed, _HIT_DDL), "suffix-hits")
    opened = hits.where("anchor is not null")
    wide = opened.groupBy("anchor").count().where(F.col("count") > WIDE_CLASS)
    # repeated suffixes have no anchor left and stay out of the join on it
    hits = opened.join(wide.select("anchor", F.lit(True).alias("wide")), "anchor", "left").unionByName(
        hits.where("anchor is null").withColumn("wide", F.lit(False)))
    by_doc = hits.groupBy("doc").agg(F.collect_list(F.struct(
        "place", "strings", "anchor", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("hits"))
    # the texts move once: both joins read the same exchange
    placed = rows.join(by_doc, "doc", "left")
    found = (placed.select("doc_id", "doc", "text", "hits")
             .mapInArrow(_opened, "key bigint, doc bigint, place bigint, part binary")
             .repartition(parts, "key").sortWithinPartitions("key", "doc")
             .mapInArrow(_compared, "doc bigint, place bigint, strings bigint"))
    more = found.groupBy("doc").agg(F.collect_list(F.struct(
        "place", "strings", F.lit(None).cast("bigint").alias("anchor"), F.lit(False).alias("wide"))).alias("more"))
    return placed.join(more, "doc", "left").select("doc_id", "doc", "text", "hits", "more").mapInArrow(
        _cleaned, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
