"""Filters of 64-bit keys that fit a broadcast: they have all of their keys, and maybe a few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27  # a filter has 32 bits for each key, 2 ** BITS at most; full ones let more through


def key_filter(keys: DataFrame, count: int, most: int = BITS) -> np.ndarray:
    """A filter of the column key as 64-bit words; the driver gets 2 ** (most - 6) short rows at most.

    Keys must be hashes: their leading bits are the place.
    """
    size = min(most, max(12, (32 * count).bit_length()))
    at = f"shiftrightunsigned(key, {64 - size})"
    rows = keys.select(F.expr(f"shiftright({at}, 6)").alias("word"), F.expr(
        f"shiftleft(1L, cast({at} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has the keys (uint64); it may have others as well."""
    at = keys >> np.uint64(64 - len(bits).bit_length() - 5)  # bits come as 2 ** k words of 64
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
