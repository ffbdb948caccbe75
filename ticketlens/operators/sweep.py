"""Dominance among points of three objectives by sorted ranges and merged staircases.

All coordinates are to be maximised.  Points are sorted by x and cut into ranges of bounded size.
What the points of a range and of all ranges before it dominate in the plane of y and z is a
staircase; staircases of ranges merge, so a prefix scan over the ranges gives every range the one
of all points with larger x, in as many rounds as the number of ranges has binary digits.  Inside
a range the points are swept in order.  No task sees all points, and none is compared with all
others.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.plans.scale import cut_lineage

RANGE = 20_000  # points of a range
_STAIRS = "r int, y double, z double"


class Staircase:
    """The outline of rectangles (0, y) x (0, z): y rising, z falling; its area is kept up to date."""

    def __init__(self, ys=(), zs=()):
        order = np.argsort(np.asarray(ys, float), kind="stable")
        self.ys = [float(v) for v in np.asarray(ys, float)[order]]
        self.zs = [float(v) for v in np.asarray(zs, float)[order]]
        self.area = math.fsum((y - b) * z for y, b, z in zip(self.ys, [0.0, *self.ys], self.zs))

    def covers(self, y: float, z: float) -> bool:
        """Whether some corner is as large in both."""
        i = bisect_left(self.ys, y)
        return i < len(self.ys) and self.zs[i] >= z

    def add(self, y: float, z: float) -> bool:
        """Take in a rectangle; False if it was covered."""
        i = bisect_left(self.ys, y)
        if i < len(self.ys) and self.zs[i] >= z:
            return False
        hi = i + 1 if i < len(self.ys) and self.ys[i] == y else i
        lo = i
        while lo and self.zs[lo - 1] <= z:
            lo -= 1
        below = self.ys[lo - 1] if lo else 0.0
        lost = sum((self.ys[j] - (self.ys[j - 1] if j else 0.0)) * self.zs[j] for j in range(lo, hi))
        if hi == i and i < len(self.ys):  # the corner behind loses what now belongs to the new one
            lost += (y - (self.ys[i - 1] if i else 0.0)) * self.zs[i]
        self.ys[lo:hi], self.zs[lo:hi] = [y], [z]
        self.area += (y - below) * z - lost
        return True


def staircase_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corners of the outline of a table's rectangles."""
    pdf = pdf.sort_values(["y", "z"], ascending=False)
    keep = pdf["z"] > pdf["z"].cummax().shift(fill_value=-np.inf)
    return pdf[keep]


def ranged(points: DataFrame, per_range: int = RANGE) -> DataFrame:
    """Points (kind, x, y, z) with the range r that they fall in, x falling with r; saved.

    kind 0 are points, others only ask; they come behind points of the same x.
    """
    n = max(1, math.ceil(points.count() / per_range))
    order = [F.desc("x"), "kind", F.desc("y"), F.desc("z")]
    return cut_lineage(points.select("kind", "x", "y", "z").repartitionByRange(n, *order).withColumn(
        "r", F.spark_partition_id()))


def before(rows: DataFrame) -> DataFrame:
    """(r, y, z): for every range the staircase of the points of all ranges before it."""
    def merge(pdf):
        return staircase_of(pdf)[["r", "y", "z"]]

    last = rows.agg(F.max("r")).first()[0] or 0
    held = rows.where("kind = 0").select("r", "y", "z").groupBy("r").applyInPandas(merge, _STAIRS)
    held = cut_lineage(held)
    step = 1
    while step <= last:
        # a range takes in the staircase of the range `step` before, which reaches as far back again
        moved = held.select((F.col("r") + step).alias("r"), "y", "z").where(F.col("r") <= last)
        held = cut_lineage(held.union(moved).groupBy("r").applyInPandas(merge, _STAIRS))
        step *= 2
    return held.select((F.col("r") + 1).alias("r"), "y", "z").where(F.col("r") <= last)


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["x", "kind", "y", "z"], ascending=[False, True, False, False])


def covered(points: DataFrame, per_range: int = RANGE) -> DataFrame:
    """(kind, x, y, z, covered): whether a point before in the order is as large in x, y and z.

    Points must be different, so such a point is larger in one of them.
    """
    rows = ranged(points, per_range)

    def sweep(own: pd.DataFrame, stairs: pd.DataFrame) -> pd.DataFrame:
        held = Staircase(stairs["y"], stairs["z"])
        own = _in_order(own)
        out = [held.covers(y, z) if kind else not held.add(y, z)
               for kind, y, z in zip(own["kind"], own["y"], own["z"])]
        return own[["kind", "x", "y", "z"]].assign(covered=out)

    return rows.groupBy("r").cogroup(before(rows).groupBy("r")).applyInPandas(
        sweep, "kind int, x double, y double, z double, covered boolean")


def volume(points: DataFrame, per_range: int = RANGE) -> DataFrame:
    """One row: the volume that boxes from the origin to the points (x, y, z) cover together.

    Between two values of x in order the cut through the boxes is one staircase, so a range adds
    its slabs down to the first x of the next range.  Points without extent add nothing.
    """
    rows = ranged(points.where("x > 0 and y > 0 and z > 0").withColumn("kind", F.lit(0)), per_range)
    # one row per range that has points
    floors = rows.groupBy("r").agg(F.max("x").alias("top")).select(
        "r", F.lead("top", 1, 0.0).over(Window.orderBy("r")).alias("below"))
    below = rows.join(floors, "r")

    def slabs(own: pd.DataFrame, stairs: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"volume": pd.Series([], dtype=float)})
        held = Staircase(stairs["y"], stairs["z"])
        own = _in_order(own)
        xs = own["x"].tolist()
        parts = []
        for x, nxt, y, z in zip(xs, [*xs[1:], float(own["below"].iloc[0])], own["y"], own["z"]):
            held.add(y, z)
            if nxt < x:
                parts.append((x - nxt) * held.area)
        return pd.DataFrame({"volume": [math.fsum(parts)]})

    found = below.groupBy("r").cogroup(before(rows).groupBy("r")).applyInPandas(slabs, "volume double")
    return found.agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
