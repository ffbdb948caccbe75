"""Plan shapes that keep work spread out when one key holds much of the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.functions.text import seeded_hash

BROADCAST_ROWS = 200_000
QUANTILE_BUCKETS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="ticketlens-")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, compressed, read by column."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the frame has no more than that many rows; reads at most one row more."""
    return df.limit(rows + 1).count() <= rows


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after its size is proven; otherwise leave the join to AQE.

    The frame is persisted so that the check does not compute it a second time.
    """
    df = df.persist()
    return F.broadcast(df) if at_most(df, rows) else df


def seeded_rank(df: DataFrame, seed, key: str, by=(), out: str = "rank", digits: int = 3):
    """Exact rank of every row in seeded-hash order inside each stratum.

    A plain row_number would send a whole stratum to one task.  Here the leading hash digits
    cut each stratum into 16**digits equal slices; rows are ranked inside their slice and the
    slice offsets come from a small count table.
    """
    by = list(by)
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(key))).withColumn(
        "_slice", F.substring("_h", 1, digits)
    )
    offsets = (
        hashed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        .select(*by, "_slice", F.coalesce("_before", F.lit(0)).alias("_before"), "_total")
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", key))
    ranked = hashed.withColumn("_inside", inside)
    joined = _null_safe_join(ranked, offsets, by + ["_slice"])
    return joined.withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint")).drop(
        "_h", "_slice", "_before", "_inside"
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by=(), out: str = "q"):
    """Exact linear-interpolated quantiles per group without one task per group.

    Equal values collapse first.  Each group is then cut into value slices; only the slices
    that hold a wanted position are ranked.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull())
        .select(*by, v.alias("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # asinh is monotone and keeps slices usable on long-tailed values
    scaled = F.asinh("_v")
    spans = counts.groupBy(*by).agg(
        F.min(scaled).alias("_lo"), F.max(scaled).alias("_hi"), F.sum("_n").alias("_total")
    )
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
        spans = spans.withColumn("_all", F.lit(0))
        by_keys = ["_all"]
    else:
        by_keys = by
    sliced = _null_safe_join(counts, spans, by_keys).withColumn(
        "_slice",
        F.when(
            F.col("_hi") > F.col("_lo"),
            F.floor((scaled - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * QUANTILE_BUCKETS),
        ).otherwise(F.lit(0)),
    )
    running = (
        Window.partitionBy(*by_keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = F.array(
        *[
            f(F.lit(p) * (F.col("_total") - 1)).cast("bigint")
            for p in probs
            for f in (F.floor, F.ceil)
        ]
    )
    wanted = (
        sliced.groupBy(*by_keys, "_slice")
        .agg(F.sum("_n").alias("_sn"), F.first("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_sn").over(running), F.lit(0)))
        .withColumn(
            "_ranks",
            F.filter(
                ranks,
                lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sn")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .select(*by_keys, "_slice", "_before", "_ranks", F.col("_total").alias("_t"))
    )
    inside = Window.partitionBy(*by_keys, "_slice").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(inside)
    picked = (
        _null_safe_join(sliced.select(*by_keys, "_slice", "_v", "_n"), wanted,
                        by_keys + ["_slice"])
        .withColumn("_upto", upto)
        .withColumn(
            "_hits",
            F.array_distinct(
                F.filter(
                    "_ranks",
                    lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")),
                )
            ),
        )
        .where(F.size("_hits") > 0)
        .select(*by_keys, "_t", "_v", F.explode("_hits").alias("_rank"))
        .groupBy(*by_keys)
        .agg(
            F.first("_t").alias("_t"),
            # at most two positions per wanted quantile
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
        )
    )

    def at(p):
        h = F.lit(p) * (F.col("_t") - 1)
        lo, hi = F.floor(h).cast("bigint"), F.ceil(h).cast("bigint")
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return a + (b - a) * (h - F.floor(h))

    return picked.select(*by, F.array(*[at(p) for p in probs]).alias(out))


def group_join(df: DataFrame, stats: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics back; the small side is broadcast only when it is small.

    Without groups the statistics are one row, joined on a constant key.
    """
    if by:
        return df.join(broadcast_checked(stats), by, how)
    keyed = stats.limit(1).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(keyed), "_one", how).drop("_one")


def evaluate_once(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep the named computed columns from being copied into later filters and projections.

    The optimizer replaces a column by its expression wherever a filter moves below the
    projection; with several layers of scores that multiplies the work.  A generator over a
    one-element array is a boundary for that, stays inside generated code and shuffles nothing.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
