"""Test statistics on aggregated rows (one row per group, never per record)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_BELOW = 25


def z_score(p: float) -> float:
    return NormalDist().inv_cdf(p)


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic on the discordant counts; 0 without any."""
    n = b + c
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, 2) / n)


def mcnemar_p_value():
    """Pandas UDF (b, c) -> p: exact two-sided binomial below 25 pairs, else chi-square tail."""

    @F.pandas_udf("double")
    def p_value(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x, y):
            n = int(x + y)
            if n == 0:
                return 1.0
            if n < EXACT_BELOW:
                tail = sum(math.comb(n, i) for i in range(int(min(x, y)) + 1)) / 2**n
                return min(1.0, 2 * tail)
            return math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / n / 2))

        return pd.Series([one(x, y) for x, y in zip(b, c)], dtype="float64")

    return p_value


def bootstrap_interval(n_boot: int, alpha: float = 0.05, seed: int = 42):
    """Pandas UDF (a, b, c, d) -> array(lower, upper) of the accuracy delta.

    Resampling n paired rows only moves the four cell counts, so drawing the cells from a
    multinomial has the same distribution as resampling the rows.
    """

    @F.pandas_udf("array<double>")
    def interval(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for cells in zip(a, b, c, d):
            n = int(sum(cells))
            if n == 0:
                out.append([0.0, 0.0])
                continue
            rng = np.random.default_rng([seed, *[int(x) for x in cells]])
            draws = rng.multinomial(n, [x / n for x in cells], size=n_boot)
            deltas = (draws[:, 2] - draws[:, 1]) / n
            lo, hi = np.percentile(deltas, [100 * alpha / 2, 100 * (1 - alpha / 2)])
            out.append([float(lo), float(hi)])
        return pd.Series(out)

    return interval


def cohens_h(p1: Column, p2: Column) -> Column:
    """B6."""
    return F.lit(2.0) * F.abs(F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def minimum_detectable_effect(n: Column, alpha=0.05, power=0.80, base=0.72) -> Column:
    """B4."""
    z = z_score(1 - alpha / 2) + z_score(power)
    return F.lit(z) * F.sqrt(F.lit(2 * base * (1 - base)) / F.greatest(n, F.lit(1)))


def required_sample_size(mde: Column, alpha=0.05, power=0.80, base=0.72) -> Column:
    """B5."""
    z = z_score(1 - alpha / 2) + z_score(power)
    return F.ceil(
        F.lit(z**2 * 2 * base * (1 - base)) / F.greatest(F.pow(mde, F.lit(2)), F.lit(1e-9))
    ).cast("bigint")
