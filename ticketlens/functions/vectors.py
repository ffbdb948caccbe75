"""Vector expressions on array<double> columns (V1, V2).  Products are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.text import bind


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has no length."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def l2_normalise(v: Column, eps: float = 0.0) -> Column:
    # the length is worked out once for all components
    return bind(l2_norm(v) + F.lit(eps), lambda norm: F.transform(
        v, lambda x: F.when(norm > 0, x / norm).otherwise(x)))
