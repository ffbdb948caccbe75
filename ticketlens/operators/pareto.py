"""Pareto frontier, best pick and dominated hypervolume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import seeded_index
from ticketlens.operators import sweep
from ticketlens.operators.clean import parse_run_name
from ticketlens.plans.scale import broadcast_checked, cut_lineage

OBJECTIVES = ["accuracy", "latency_ms", "cost_per_ticket"]
ORIGIN = (0.0, 0.0, 0.0)
FLOOR = 1e-6
_SCHEMA = "accuracy double, latency_ms double, cost_per_ticket double"


def _thin(batches):
    """Drop what a batch itself dominates; exact work is left to the sweep."""
    for b in batches:
        b = b.sort_values(OBJECTIVES, ascending=[False, True, True], ignore_index=True)
        held = sweep.Staircase()
        keep = [held.add(y, z) for y, z in zip(-b["latency_ms"], -b["cost_per_ticket"])]
        yield b[keep]


def _axes(df: DataFrame) -> DataFrame:
    """Objectives as coordinates to be maximised."""
    return df.select(F.lit(0).alias("kind"), F.col("accuracy").alias("x"), (-F.col("latency_ms")).alias("y"),
                     (-F.col("cost_per_ticket")).alias("z"))


def frontier_points(df: DataFrame, block: int = sweep.RANGE) -> DataFrame:
    """O1, O2: distinct objective triples that no other triple dominates (>= everywhere, > somewhere).

    Equal points collapse first and batches drop what they dominate themselves.  The rest is
    swept in ranges of `block` points against the merged outline of all better ranges, so no task
    holds all points, however many do not dominate each other.  Triples with a null are no points.
    """
    distinct = df.select(*[F.col(c).cast("double") for c in OBJECTIVES]).dropna().mapInPandas(_thin, _SCHEMA).distinct()
    kept = sweep.covered(_axes(distinct), block).where("not covered")
    return kept.select(F.col("x").alias("accuracy"), (-F.col("y")).alias("latency_ms"), (-F.col("z")).alias("cost_per_ticket"))


def pareto_frontier(df: DataFrame) -> DataFrame:
    """O2: every point with its flag; equal points share it."""
    front = frontier_points(df).withColumn("is_pareto_optimal", F.lit(True))
    return df.join(broadcast_checked(front), OBJECTIVES, "left").withColumn(
        "is_pareto_optimal", F.coalesce("is_pareto_optimal", F.lit(False)))


def select_best(
    df: DataFrame, key: str, latency_budget: float = 200.0, cost_budget: float = 0.20,
) -> DataFrame:
    """O3: best key per priority within the budgets, over the whole frontier if none fits."""
    front = df.where("is_pareto_optimal")
    fits = (F.col("latency_ms") <= latency_budget) & (F.col("cost_per_ticket") <= cost_budget)
    limits = front.agg(
        F.count_if(fits).alias("_fit"),
        *[f(F.when(ok, c)).alias(f"_{n}{tag}")
          for tag, ok in (("f", fits), ("a", F.lit(True)))
          for n, f, c in (("acc", F.max, F.col("accuracy")), ("lat", F.min, F.col("latency_ms")),
                          ("cost", F.min, F.col("cost_per_ticket")))],
    ).withColumn("_one", F.lit(1))
    cand = front.withColumn("_one", F.lit(1)).join(F.broadcast(limits), "_one").where(
        fits | (F.col("_fit") == 0))
    pick = lambda n: F.when(F.col("_fit") > 0, F.col(f"_{n}f")).otherwise(F.col(f"_{n}a")) + 1e-9
    balanced = F.pow(
        F.col("accuracy") / pick("acc") * (pick("lat") / F.col("latency_ms"))
        * (pick("cost") / F.col("cost_per_ticket")), F.lit(1.0 / 3.0))
    best = lambda score: F.max_by(key, F.struct(score, -F.col(key)))
    chosen = cand.withColumn("_b", F.round(balanced, 12)).agg(
        best(F.col("accuracy")).alias("accuracy"), best(-F.col("latency_ms")).alias("speed"),
        best(-F.col("cost_per_ticket")).alias("cost"), best(F.col("_b")).alias("balanced"))
    return chosen.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("priority"), F.col(p).alias(key))
        for p in ("accuracy", "speed", "cost", "balanced")])))


def _scaled(points: DataFrame, reference: tuple) -> DataFrame:
    """Accuracy, speed and cost efficiency above the reference point; what does not exceed it has no volume."""
    inv = lambda c: 1.0 / F.greatest(F.col(c), F.lit(FLOOR))
    axes = zip("xyz", (F.col("accuracy"), inv("latency_ms"), inv("cost_per_ticket")), reference)
    return points.select(*[(c - F.lit(float(low))).alias(name) for name, c, low in axes]).where("x > 0 and y > 0 and z > 0")


def hypervolume(df: DataFrame, reference: tuple = ORIGIN, block: int = sweep.RANGE) -> DataFrame:
    """Exact volume between the frontier and a reference point (accuracy, 1 / latency, 1 / cost).

    Dominated points add nothing, so the sweep takes all points; they are cut into ranges of
    `block` and meet as outlines.
    """
    points = df.select(*[F.col(c).cast("double") for c in OBJECTIVES]).dropna().mapInPandas(_thin, _SCHEMA).distinct()
    return sweep.volume(_scaled(points, reference), block).withColumnRenamed("volume", "hypervolume")


def hypervolume_sampled(df: DataFrame, n_samples: int = 10_000, seed: int = 42, reference: tuple = ORIGIN) -> DataFrame:
    """Monte Carlo estimate with md5-seeded samples between the reference point and the best of each objective."""
    front = cut_lineage(_scaled(frontier_points(df), reference))
    # an empty frontier has no box and no volume
    top = front.agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z")).first()
    if top["x"] is None:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("hypervolume"))
    unit = lambda axis: seeded_index(f"{seed}-{axis}", F.col("id")) / F.lit(float(2**32))
    samples = df.sparkSession.range(n_samples).select(
        F.lit(1).alias("kind"), *[(unit(a) * F.lit(top[a])).alias(a) for a in "xyz"])
    # samples are swept along with the points
    hit = sweep.covered(front.select(F.lit(0).alias("kind"), "x", "y", "z").union(samples)).where("kind = 1 and covered")
    return hit.agg((F.count(F.lit(1)) / n_samples * (top["x"] * top["y"] * top["z"]))
                   .alias("hypervolume"))


def pareto_points(evals: DataFrame) -> DataFrame:
    """Evaluation rows to points, domain and rank read from the run name."""
    domain, rank = parse_run_name(F.col("run_name"))
    return evals.withColumn("domain", domain).withColumn("lora_rank", rank)
