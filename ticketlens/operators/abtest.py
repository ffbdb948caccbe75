"""Paired A/B tests on predictions."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import stats as st
from ticketlens.plans.scale import evaluate_once


def paired_cells(df, control="control_pred", treatment="treatment_pred", label="label", by=()):
    """The 2x2 table of paired correctness; the only pass over the records."""
    c, t = F.col(control) == F.col(label), F.col(treatment) == F.col(label)
    return df.groupBy(*by).agg(
        F.count_if(c & t).alias("a"), F.count_if(c & ~t).alias("b"),
        F.count_if(~c & t).alias("c"), F.count_if(~c & ~t).alias("d"))


def ab_test(
    df: DataFrame, alpha: float = 0.05, by: str | None = None, n_boot: int | None = None, **cols
) -> DataFrame:
    """B1 over all rows, or B7 per group with the Bonferroni level."""
    cells = paired_cells(df, by=[by] if by else (), **cols)
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    out = cells.withColumns(
        {
            "n": n,
            "control_accuracy": (F.col("a") + F.col("b")) / n,
            "treatment_accuracy": (F.col("a") + F.col("c")) / n,
        }
    ).withColumns(
        {
            "accuracy_delta": F.col("treatment_accuracy") - F.col("control_accuracy"),
            "mcnemar_statistic": st.mcnemar_statistic(F.col("b"), F.col("c")),
            "p_value": st.mcnemar_p_value()(F.col("b"), F.col("c")),
            "effect_size": st.cohens_h(F.col("control_accuracy"), F.col("treatment_accuracy")),
            "mde": st.minimum_detectable_effect(F.col("n"), alpha),
            "ci": st.bootstrap_interval(n_boot or (500 if by else 1000), alpha)("a", "b", "c", "d"),
        }
    )
    level = F.lit(alpha)
    if by:
        # as many rows as groups
        groups = cells.agg(F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(groups), "_one").drop("_one")
        level = F.lit(alpha) / F.greatest("_k", F.lit(1))
    return (
        out.withColumn("alpha", level)
        .withColumn("is_significant", F.col("p_value") < F.col("alpha"))
        .withColumn("ci_lower", F.col("ci")[0])
        .withColumn("ci_upper", F.col("ci")[1])
        .drop("ci", "_k")
    )


#: replicates that share one md5: each takes 16 bits of it
PER_DIGEST = 8


def poisson_weight(u: Column) -> Column:
    """Poisson(1) from a uniform integer of 16 bits; the chance of every count is right to 2 ** -16."""
    total, chance, cuts = 0.0, math.exp(-1), []
    for k in range(8):
        total += chance / math.factorial(k)
        cuts.append(math.floor(total * 65536))
    return functools.reduce(lambda a, b: a + b, [(u >= cut).cast("int") for cut in cuts])


def poisson_bootstrap(df: DataFrame, key: str, values: dict[str, Column], by: tuple = (), replicates: int = 400,
                      alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """B3 for any numeric metric: the keys, metric, n, estimate, ci_lower, ci_upper of its mean.

    Every row counts Poisson(1) times in every replicate, by a hash of seed, key and replicate, so
    rows need no drawing, no numbering and no second pass, and any engine gets the same interval.
    A row becomes one per PER_DIGEST replicates and is added up before the shuffle: what is
    shuffled are sums per group and replicate.  Nulls of a metric take no part in it; a metric
    without values has null bounds.  Paired metrics are differences within a row.  Equal keys get
    equal weights, so give a unique one.
    """
    blocks = math.ceil(replicates / PER_DIGEST)
    names = list(values)
    rows = df.select(*by, F.col(key).alias("_key"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(values.values())])
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string"), F.col("_block").cast("string")))
    long = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_h", digest)
    weights = [poisson_weight(F.conv(F.substring("_h", 4 * k + 1, 4), 16, 10).cast("int")).alias(f"_w{k}") for k in range(PER_DIGEST)]
    long = evaluate_once(long.select(*by, "_block", *[f"_x{i}" for i in range(len(names))], *weights),
                         [f"_w{k}" for k in range(PER_DIGEST)])
    sums = [a for i in range(len(names)) for k in range(PER_DIGEST) for a in (
        F.sum(F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_w{k}"))).alias(f"_n{i}_{k}"),
        F.sum(F.col(f"_w{k}") * F.col(f"_x{i}")).alias(f"_s{i}_{k}"))]
    added = long.groupBy(*by, "_block").agg(*sums)
    means = added.select(*by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), (F.col("_block") * PER_DIGEST + k).alias("replicate"),
                 F.try_divide(f"_s{i}_{k}", f"_n{i}_{k}").alias("mean"))
        for i, name in enumerate(names) for k in range(PER_DIGEST)]))).where(F.col("replicate") < replicates)
    # as many values as replicates
    bounds = means.groupBy(*by, "metric").agg(F.percentile("mean", [alpha / 2, 1 - alpha / 2]).alias("q"))
    found = rows.groupBy(*by).agg(*[a for i in range(len(names)) for a in (
        F.count(f"_x{i}").alias(f"_n{i}"), F.avg(f"_x{i}").alias(f"_e{i}"))]).select(*by, F.inline(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_e{i}").alias("estimate"))
            for i, name in enumerate(names)])))
    same = [found[c].eqNullSafe(bounds[c]) for c in (*by, "metric")]
    return found.join(bounds, functools.reduce(lambda a, b: a & b, same)).select(
        *[found[c] for c in (*by, "metric")], "n", "estimate", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))
