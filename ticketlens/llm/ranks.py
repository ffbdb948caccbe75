"""Running totals inside groups of any size, without one task per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_SLICE = 4096
HEX = "0123456789abcdef"


def digits_for(total: int) -> int:
    """Hex digits of one slice level, for two levels that leave about PER_SLICE rows a slice."""
    return max(1, math.ceil(math.log(max(total, 1) / PER_SLICE + 1, 16) / 2))


def running_totals(df: DataFrame, by: Column, order: str, sums: dict[str, str], ties: list[str],
                   total_rows: int, slim: DataFrame | None = None) -> DataFrame:
    """Adds for every (output, column) of `sums` the sum over the rows before in the group.

    Rows are ordered by the hex string `order`, then by `ties`.  The leading digits of `order`
    cut every group into slices and those into finer ones; totals of slices are added up among
    themselves, so no task sees more than one slice of a group, however large the group is.
    `by` must not be null.  `slim` has the rows of df without the columns that are only carried;
    slices are added up from it.
    """
    d = digits_for(total_rows)
    sliced = lambda x: x.withColumns({"_by": by, "_hi": F.substring(order, 1, d), "_lo": F.substring(order, d + 1, d)})
    rows = sliced(df)
    fine = (rows if slim is None else sliced(slim)).groupBy("_by", "_hi", "_lo").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums.values())])
    coarse = fine.groupBy("_by", "_hi").agg(*[F.sum(f"_t{k}").alias(f"_t{k}") for k in range(len(sums))])
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w1 = Window.partitionBy("_by").orderBy("_hi")
    w2 = Window.partitionBy("_by", "_hi").orderBy("_lo")
    w3 = Window.partitionBy("_by", "_hi", "_lo").orderBy(order, *ties)
    coarse = coarse.select("_by", "_hi", *[before(w1, f"_t{k}").alias(f"_c{k}") for k in range(len(sums))])
    fine = fine.select("_by", "_hi", "_lo", *[before(w2, f"_t{k}").alias(f"_f{k}") for k in range(len(sums))])
    offsets = fine.join(coarse, ["_by", "_hi"]).select(
        "_by", "_hi", "_lo", *[(F.col(f"_f{k}") + F.col(f"_c{k}")).alias(f"_o{k}") for k in range(len(sums))])
    inner = rows.withColumns({f"_i{k}": before(w3, c) for k, c in enumerate(sums.values())})
    joined = inner.join(offsets, ["_by", "_hi", "_lo"])
    return joined.withColumns({o: F.col(f"_i{k}") + F.col(f"_o{k}") for k, o in enumerate(sums)}).drop(
        "_by", "_hi", "_lo", *[f"_{x}{k}" for x in "io" for k in range(len(sums))])
