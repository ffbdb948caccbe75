"""Vectorised text features for Arrow batches: code points, letter trigrams, hashed n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.uint32(32)
# odd multipliers of a multiply-shift hash; features may collide, so 32 bits do
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_BASE = 0x01000193
_UNBASE = pow(_BASE, -1, 1 << 32)


SLICE = 1 << 20  # bytes of text that arrays are made of at once; a longer text is a slice of its own


def by_size(batches, column: str = "text"):
    """The rows of the batches in slices of bounded text, whole texts each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > SLICE:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether a code point is a letter, as str.isalpha says."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind one another, a zero before, between and after them.

    Returns the array and the start of every text in it (with the end as last entry).
    """
    encoded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
    flat = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(encoded) + b"\0\0\0\0", np.uint32)
    starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
    return flat, starts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 32-bit values."""
    x = x ^ (x >> np.uint32(15))
    x = x * _B
    return x ^ (x >> np.uint32(13))


def slot(x: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of a hash as an index."""
    return (x >> np.uint32(32 - bits)).astype(np.int32)


def trigram_ids(codes: np.ndarray, bits: int) -> np.ndarray:
    """Hashed id of the trigram around every position but the first and the last."""
    return slot(mix(codes[:-2] * _A + codes[1:-1] * _B + codes[2:] * _C) * _C, bits)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**32, doubled up block by block."""
    out = np.ones(max(1, n), np.uint32)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint32(pow(base, done, 1 << 32))
        done += k
    return out


def words_of(codes: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 32-bit hash of every maximal run of positions that are not blank."""
    edge = np.diff((~blank).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(codes) + 1, np.uint32)
    np.cumsum((codes + _A) * _powers(_BASE, len(codes)), out=total[1:], dtype=np.uint32)
    shift = _powers(_UNBASE, len(codes) + 1)[starts]
    return starts, ends, mix(mix((total[ends] - total[starts]) * shift) * _C)
