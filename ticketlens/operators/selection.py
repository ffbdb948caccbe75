"""Checkpoint ranking and hyper-parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_checkpoints(
    df: DataFrame, metric: str, k: int = 3, lower_is_better: bool = True,
    key: str = "checkpoint_id", by: str = "domain",
) -> DataFrame:
    """Rank of the k best per group, is_best, and kept or pruned for every row.

    The limit on the rank runs before the shuffle, so only k rows per task and group move.
    """
    value = F.col(metric)
    order = value.asc_nulls_last() if lower_is_better else value.desc_nulls_last()
    top = (
        df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, key)))
        .where(F.col("rank") <= k)
        .select(key, "rank")
    )
    return df.join(top, key, "left").withColumns(
        {
            "is_best": F.coalesce(F.col("rank") == 1, F.lit(False)),
            "kept": F.col("rank").isNotNull(),
        }
    )


def best_checkpoints(df, metric, lower_is_better=True, key="checkpoint_id", by="domain"):
    """One row per group; a missing metric never wins against a present one."""
    value = F.col(metric)
    signed = value if lower_is_better else -value
    order = F.struct(value.isNull(), F.coalesce(signed, F.lit(0.0)), F.col(key))
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(by, "_b.*")


def better_than(a, b, lower_is_better: bool = True):
    """Whether metric column a beats b; a missing value never does."""
    wins = a < b if lower_is_better else a > b
    return F.when(a.isNull(), F.lit(False)).when(b.isNull(), F.lit(True)).otherwise(wins)


def sweep_grid(
    base: DataFrame, ranks, rates, multipliers, dropouts, warmups, domain: str = "domain"
) -> DataFrame:
    """Every hyper-parameter combination for every base row, by exploding short lists."""
    lists = {"lora_r": ranks, "learning_rate": rates, "alpha_mult": multipliers,
             "dropout": dropouts, "warmup": warmups}
    out = base
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    texts = {name: F.element_at(F.create_map(*[F.lit(x) for v in values for x in (v, t(v))]),
                                F.col(name))
             for name, values, t in (("learning_rate", rates, lambda v: f"{v:.0e}"),
                                     ("dropout", dropouts, str), ("warmup", warmups, str))}
    return out.withColumn("lora_alpha", F.col("lora_r") * F.col("alpha_mult")).withColumn(
        "run_name",
        F.concat(F.col(domain), F.lit("_r"), F.col("lora_r").cast("string"), F.lit("_lr"),
                 texts["learning_rate"], F.lit("_a"), F.col("alpha_mult").cast("string"),
                 F.lit("_d"), texts["dropout"], F.lit("_w"), texts["warmup"]))


def sweep_cells(df: DataFrame) -> DataFrame:
    """Mean loss and run count per learning rate and rank; failed runs do not count."""
    return df.where(F.col("error").isNull()).groupBy("learning_rate", "lora_r").agg(
        F.avg("eval_loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_runs"))


def sweep_summary(df: DataFrame, key: str = "run_id") -> DataFrame:
    """Best run per rank with accuracy proxy, relative cost and the overall best flag."""
    ok = df.where(F.col("error").isNull())
    best = ok.groupBy("lora_r").agg(
        F.min_by(key, F.struct("eval_loss", key)).alias(key), F.min("eval_loss").alias("eval_loss"),
        F.max("eval_loss").alias("_max"))
    # one row per rank from here on
    ends = best.agg(F.min("eval_loss").alias("_lo"), F.max("_max").alias("_hi")).withColumn(
        "_one", F.lit(1))
    span = F.col("_hi") - F.col("_lo") + 1e-8
    return best.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one").select(
        "lora_r", key, "eval_loss",
        (1.0 - (F.col("eval_loss") - F.col("_lo")) / span).alias("accuracy_proxy"),
        (F.col("lora_r") / 8.0 * 0.03).alias("cost"),
        (F.col("eval_loss") == F.col("_lo")).alias("is_best"))


def sweep_pivot(df: DataFrame, rates: list[float]) -> DataFrame:
    """Ranks down, learning rates across, mean loss in the cells."""
    cells = sweep_cells(df)
    return cells.groupBy("lora_r").agg(
        *[F.max(F.when(F.col("learning_rate") == r, F.col("mean_loss"))).alias(f"lr_{i}")
          for i, r in enumerate(rates)])


def param_counts(df: DataFrame, hidden: int = 4096, modules: int = 7, layers: int = 32,
                 base: float = 7.24e9) -> DataFrame:
    """Trainable parameters of a rank and their share of the base model."""
    n = F.col("lora_r").cast("bigint") * (2 * hidden * modules * layers)
    return df.withColumn("n_params", n).withColumn("share", n / base)
