"""Large JSON objects read by many tasks: records inside one object, planned as byte ranges.

A range of bytes does not know whether it begins inside a string, nor how deep.  So every range
is scanned once under both assumptions: how many quotes and brackets it has, and which keys it
saw last at its lowest depths.  Adding this up over the ranges of a file, one short row each,
gives every range the state that it begins in; then the ranges are read as records, each by the
range that it begins in.
"""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 64 << 20  # bytes of a range
AHEAD = 1 << 20  # bytes that are read at once beyond it, until a record or key ends
_QUOTE, _ESCAPE, _COLON = ord('"'), ord("\\"), ord(":")
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
_LEVELS = 4  # lowest depths of a range whose last keys are reported


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    path = path if "://" in path else os.path.abspath(path)
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[:path.index("://") + 3] if "://" in path else ""
    return [(prefix + i.path, i.size) for i in found
            if i.type == fs.FileType.File and i.size and not i.base_name.startswith(("_", "."))]


class _Bytes:
    """The bytes of a range, with a way to read on behind it."""

    def __init__(self, path: str, start: int, size: int):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.end = self.file.size()
        self.size = min(size, self.end - start)
        back = 1  # a run of escapes that reaches the start decides about the first character
        while True:
            head = self.file.read_at(min(back, start), start - min(back, start))
            if len(head) == start or head[:1] != b"\\":
                break
            back *= 2
        run = len(head) - len(head.rstrip(b"\\"))
        self.data = self.file.read_at(self.size, start)
        self.start, self.first_escaped = start, run % 2 == 1

    def grow(self) -> bool:
        """Read on; False at the end of the file."""
        more = self.file.read_at(min(AHEAD, self.end - self.start - len(self.data)), self.start + len(self.data))
        self.data += more
        return bool(more)

    def marks(self):
        """Bytes as an array, and the places of quotes that are not escaped."""
        b = np.frombuffer(self.data, np.uint8)
        at = np.flatnonzero(b == _QUOTE)
        plain = np.flatnonzero(b != _ESCAPE)
        before = np.searchsorted(plain, at) - 1
        run = np.where(before >= 0, at - 1 - plain[np.maximum(before, 0)], at + self.first_escaped)
        return b, at[run % 2 == 0]

    def close(self) -> None:
        self.file.close()


def _depths(b: np.ndarray, quotes: np.ndarray, inside: bool):
    """Places and depth changes of the brackets outside strings; places of opening quotes."""
    steps = np.zeros(len(b), np.int8)
    for c in _OPEN:
        steps[b == c] = 1
    for c in _CLOSE:
        steps[b == c] = -1
    at = np.flatnonzero(steps)
    out = (np.searchsorted(quotes, at) + inside) % 2 == 0
    return at[out], steps[at[out]].astype(np.int64), quotes[1 if inside else 0::2]


def _string(held: _Bytes, at: int) -> tuple[str, bool]:
    """The string that opens at a place, and whether it is a key: a colon follows it."""
    text = held.data
    i = at + 1
    while True:
        i = text.find(b'"', i)
        if i < 0:
            i = len(text)
            if not held.grow():
                return "", False
            text = held.data
            i = at + 1
            continue
        run = i - at - 1 - len(text[at + 1:i].rstrip(b"\\"))
        if run % 2 == 0:
            break
        i += 1
    j = i + 1
    while True:
        while j < len(text) and text[j:j + 1].isspace():
            j += 1
        if j < len(text):
            break
        if not held.grow():
            return "", False
        text = held.data
    if text[j] != _COLON:
        return "", False
    try:
        return json.loads(text[at:i + 1]), True
    except ValueError:  # between two strings, read under the wrong assumption
        return "", False


def _scan(held: _Bytes) -> list[dict]:
    """For both assumptions about the start: depth change, lowest depth and last keys from there on."""
    b, quotes = held.marks()
    out = []
    for inside in (False, True):
        at, steps, opening = _depths(b, quotes, inside)
        depth = np.concatenate([[0], np.cumsum(steps)])
        own = depth[np.searchsorted(at, opening)]
        lowest = int(depth.min())
        keys = {}
        for level in range(lowest, lowest + _LEVELS):
            for place in opening[own == level][::-1]:
                text, is_key = _string(held, int(place))
                if is_key:
                    keys[level] = text
                    break
        out.append({"turns": len(quotes) % 2, "change": int(depth[-1]), "lowest": lowest, "keys": keys})
    return out


def _records(held: _Bytes, inside: bool, depth: int, keys: dict, level: int, under: tuple):
    """(keys, record) of the objects that open at a depth of `level` in this range."""
    b, quotes = held.marks()
    at, steps, opening = _depths(b, quotes, inside)
    before = depth + np.concatenate([[0], np.cumsum(steps)])
    starts = at[(steps == 1) & (before[:-1] == level) & (b[at] == _OPEN[0])]
    ends = at[(steps == -1) & (before[1:] == level)]
    own = before[np.searchsorted(at, opening)]
    names = opening[own <= level]
    levels = own[own <= level]
    held_keys = dict(keys)
    k = 0
    for start, e in zip(starts.tolist(), np.searchsorted(ends, starts).tolist()):
        while k < len(names) and names[k] < start:
            text, is_key = _string(held, int(names[k]))
            if is_key:
                held_keys[int(levels[k])] = text
            k += 1
        path = tuple(held_keys.get(d, "") for d in range(1, level + 1))
        if path[:len(under)] != under:
            continue
        end = int(ends[e]) + 1 if e < len(ends) else _closing(held, start)  # the last one may go on behind the range
        if end is None:
            return
        text = held.data[start:end].decode("utf-8", "replace")
        try:
            json.loads(text)
        except ValueError:
            continue
        yield path, text


def _closing(held: _Bytes, start: int) -> int | None:
    """The place behind the object that opens at a place; None if the file ends before."""
    depth, inside, i = 0, False, start
    while True:
        text = held.data
        while i < len(text):
            c = text[i]
            if inside:
                if c == _ESCAPE:
                    i += 1
                elif c == _QUOTE:
                    inside = False
            elif c == _QUOTE:
                inside = True
            elif c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        if not held.grow():
            return None


def _plan(spark: SparkSession, path: str, size: int) -> list[tuple]:
    """(path, start, size, inside, depth, keys as JSON) of every range; a short row each."""
    ranges = [(name, k * size, size) for name, total in _files(path) for k in range(math.ceil(total / size))]
    if not ranges:
        return []

    def scan(batches):
        for batch in batches:
            rows = []
            for name, start, length in zip(*[c.to_pylist() for c in batch.columns]):
                held = _Bytes(name, start, length)
                rows.append((name, start, json.dumps(_scan(held))))
                held.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "start", "found"])

    table = spark.createDataFrame(ranges, "path string, start bigint, size bigint")
    found = table.repartition(min(len(ranges), 10_000), "path", "start").mapInArrow(scan, "path string, start bigint, found string").collect()
    plan, state = [], {}
    for name, start, text in sorted((r["path"], r["start"], r["found"]) for r in found):
        inside, depth, keys = state.get(name, (False, 0, {}))
        plan.append((name, start, size, inside, depth, json.dumps(keys)))
        one = json.loads(text)[int(inside)]
        keys = {**keys, **{depth + int(level): key for level, key in one["keys"].items()}}
        state[name] = (inside ^ bool(one["turns"]), depth + one["change"], {d: k for d, k in keys.items() if d <= 8})
    return plan


def read_records(spark: SparkSession, path: str, schema: str, level: int, under: tuple = (), size: int = RANGE) -> DataFrame:
    """(keys array<string>, record) of the objects nested `level` brackets deep in the objects at a path.

    level counts all brackets around a record: 2 for records in arrays by key, 3 for those one
    key deeper.  keys are the keys on the way, an array having none ("" in its place).  under
    keeps the records whose first keys are these.  Records that are no valid JSON are left out, an
    object cut off at its end gives the records before.
    """
    plan = _plan(spark, path, size)

    def read(batches):
        for batch in batches:
            for name, start, length, inside, depth, keys in zip(*[c.to_pylist() for c in batch.columns]):
                held = _Bytes(name, start, length)
                rows, many = [], 0
                for found in _records(held, inside, depth, {int(d): k for d, k in json.loads(keys).items()}, level, under):
                    rows.append(found)
                    many += len(found[1])
                    if many > 8 << 20:
                        yield _batch(rows)
                        rows, many = [], 0
                held.close()
                if rows:
                    yield _batch(rows)

    table = spark.createDataFrame(plan, "path string, start bigint, size bigint, inside boolean, depth int, keys string")
    rows = table.repartition(max(1, min(len(plan), 10_000)), "path", "start").mapInArrow(read, "keys array<string>, value string")
    return rows.select("keys", F.from_json("value", schema).alias("record"))


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([list(r[0]) for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string())], names=["keys", "value"])
