"""Packing token ids into windows: minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written
from ticketlens.llm.ranks import running_totals
from ticketlens.llm.tokens import Encoder

WINDOW = 1024
END = b"\0\0\0\0"  # id 0 behind every document


def token_files() -> tuple[str, str]:
    """Tokenizer and rank file of the public 50k byte-level vocabulary, as installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, files=None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every document cut into full windows and a rest: one row per piece, ids closed by id 0.

    A null text counts as empty, which leaves the closing id alone.  `files` are paths that the
    workers can read; without them the installed files are used.  With `keep_ids` the ids follow.
    """

    def run(batches):
        encoder = Encoder(*(files or token_files()))
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = encoder.encode(text or "") + END
                total = len(own) // 4
                for start in range(0, total, window):
                    part = own[4 * start:4 * (start + window)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), total,
                                *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))
            columns = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema.types)], names=schema.names)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                       + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))
    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, ddl + (", ids array<int>" if keep_ids else ""))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths, within their counts, whose sum is the largest that fits the room.

    Bit s of a bitset says that sum s can be reached; the bitsets before each bundle of equal
    lengths are kept, and the counts are found by walking back through them.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left > 0:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per window, first window, offset) for all pieces.

    The largest length left opens a window, best_fill closes it, and the pattern is repeated as
    often as the counts allow, so every pattern uses up a length or comes close to it: the plan's
    size depends on the window, not on the number of pieces.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    ranks = dict.fromkeys(left, 0)
    plan, number = [], 0
    while left:
        top = max(left)
        left[top] -= 1
        pattern = best_fill({k: n for k, n in left.items() if n and k <= window - top}, window - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            c = pattern[k]
            plan.append((k, ranks[k], ranks[k] + c * times, c, number, offset))
            ranks[k] += c * times
            left[k] -= c * times
            if not left[k]:
                del left[k]
            offset += c * k
        number += times
    return sorted(plan)


def pack(docs: DataFrame, files=None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, gapless from 0 in every sequence.

    Pieces of one length are ranked by a hash of document and start; the plan maps length and
    rank to a window.  Repeated rows are packed one by one.  The driver sees the histogram of
    lengths alone, one number for every length up to the window.
    """
    cut = written(pieces(docs, files, window, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = np.array(plan_windows(histogram, window), np.int64).reshape(-1, 6)
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string")))
    ranked = running_totals(
        cut.withColumns({"_h": key, "_one": F.lit(1)}), F.col("length"), "_h", {"_rank": "_one"},
        ["doc_id", "start", "ids_crc32"], sum(histogram.values())).drop("_h", "_one")
    names = [c for c in ranked.columns if c != "_rank"]
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the window

    def place(batches):
        rows = shared.value
        wide = np.int64(1) << 40
        first = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = rows[np.searchsorted(first, length * wide + rank, side="right") - 1]
            inside = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(at[:, 4] + inside // at[:, 3]),
                 pa.array(at[:, 5] + inside % at[:, 3] * length)],
                names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, ddl + ", sequence_id bigint, offset bigint")


def op9_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
