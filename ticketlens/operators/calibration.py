"""Confidence calibration: bins, expected calibration error, temperature choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.routing import Prototypes, argmax, score_tickets, softmax

GRID = [0.01, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50]


def _bin(confidence, n_bins: int):
    """Bin 1..n with edges (lo, hi]; a confidence of 0 falls in no bin."""
    edges = F.array(*[F.lit(i / n_bins) for i in range(n_bins)])
    below = F.size(F.filter(edges, lambda e: e < confidence))
    return F.when(below > 0, below)


def binned(df: DataFrame, n_bins: int = 10, conf="confidence", correct="correct", by=()):
    """Counts, sums of correctness and confidence per bin; the only pass over the data."""
    return (
        df.withColumn("bin", _bin(F.col(conf), n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(correct).cast("int")).alias("n_correct"),
            F.sum(conf).alias("sum_conf"),
        )
    )


def calibration_bins(df: DataFrame, n_bins: int = 10, **columns) -> DataFrame:
    """(bin, accuracy, avg_confidence, n) including empty bins."""
    found = binned(df, n_bins, **columns).where(F.col("bin").isNotNull())
    slots = df.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    return slots.join(found, "bin", "left").select(
        F.col("bin").cast("bigint").alias("bin"),
        F.round(F.coalesce(F.col("n_correct") / F.col("n"), F.lit(0.0)), 4).alias("accuracy"),
        F.round(F.coalesce(F.col("sum_conf") / F.col("n"),
                           (F.col("bin") - 0.5) / n_bins), 4).alias("avg_confidence"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _error():
    """ECE over bin rows: sum of |correct - confidence| mass over all rows."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("n_correct") - F.col("sum_conf")))
    return F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")


def ece(df: DataFrame, n_bins: int = 10, by=(), **columns) -> DataFrame:
    """Expected calibration error, from unrounded bins."""
    return binned(df, n_bins, by=by, **columns).groupBy(*by).agg(
        _error().alias("ece"), F.sum("n").alias("n_samples"))


def calibrate(
    df: DataFrame, protos: Prototypes, label: str = "domain", grid=None, n_bins: int = 10,
) -> DataFrame:
    """One row per temperature with its ECE, accuracy, mean confidence, and the choice.

    Similarities are computed once per ticket; the grid is an array inside the row, so the data
    is read once and one aggregation serves all temperatures.
    """
    grid = grid or GRID
    n = len(protos.domains)
    scored = score_tickets(df, protos).select(
        F.col(label).alias("_truth"), *[f"_s{i}" for i in range(n)])
    tried = softmax(
        scored.withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in grid]))),
        n, F.col("temperature"))
    domain, confidence = argmax(protos)
    graded = tried.select(
        "temperature", confidence.alias("confidence"), (domain == F.col("_truth")).alias("correct")
    )
    bins = binned(graded, n_bins, by=["temperature"])
    table = bins.groupBy("temperature").agg(
        _error().alias("ece"),
        (F.sum("n_correct") / F.sum("n")).alias("accuracy"),
        (F.sum("sum_conf") / F.sum("n")).alias("avg_confidence"),
        F.sum("n").alias("n_samples"),
    )
    best = table.agg(
        F.min_by("temperature", F.struct(F.round("ece", 12), "temperature")).alias("_best"))
    best = best.withColumn("_one", F.lit(1))
    return table.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").select(
        *table.columns, (F.col("temperature") == F.col("_best")).alias("chosen"))
