"""Quality gates: length bounds, IQR fence, duplicates, report and warnings (Q1-Q4, Q13-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.operators import neardup, noise
from ticketlens.plans.scale import broadcast_checked, cut_lineage, exact_quantiles, group_join


def length_bounds(
    df: DataFrame, lo: int = lx.MIN_CHARS, hi: int = lx.MAX_CHARS, text: str = "text"
) -> DataFrame:
    """Q1: inclusive bounds on the number of characters."""
    return df.where(F.length(text).between(lo, hi))


def iqr_limits(
    df: DataFrame, by: list[str], k: float = lx.IQR_MULTIPLIER, text: str = "text"
) -> DataFrame:
    """Fence per group over all input rows: (by..., fence_lo, fence_hi)."""
    lengths = df.select(*by, F.length(text).alias("_len"))
    q = exact_quantiles(lengths, "_len", [0.25, 0.75], by)
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select(
        *by,
        (F.col("q")[0] - k * spread).alias("fence_lo"),
        (F.col("q")[1] + k * spread).alias("fence_hi"),
    )


def flag_outliers(
    df: DataFrame,
    by: list[str] | None = None,
    lo: int = lx.MIN_CHARS,
    hi: int = lx.MAX_CHARS,
    k: float = lx.IQR_MULTIPLIER,
    text: str = "text",
) -> DataFrame:
    """Q1 and Q2 as two flags on every row; the fence quartiles include rows that fail Q1."""
    by = ["domain"] if by is None and "domain" in df.columns else (by or [])
    n = F.length(text)
    return (
        group_join(df, iqr_limits(df, by, k, text), by)
        .withColumn("fails_bounds", ~n.between(lo, hi))
        .withColumn("fails_fence", ~n.between(F.col("fence_lo"), F.col("fence_hi")))
        .drop("fence_lo", "fence_hi")
    )


def iqr_fence(df: DataFrame, by: list[str], k: float = lx.IQR_MULTIPLIER, text="text"):
    """Q2: rows inside the fence of their group."""
    flagged = flag_outliers(df, by, k=k, text=text)
    return flagged.where(~F.col("fails_fence")).drop("fails_bounds", "fails_fence")


def filter_outliers(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Q3: (clean rows, flagged rows with their causes)."""
    flagged = flag_outliers(df, **options)
    bad = F.col("fails_bounds") | F.col("fails_fence")
    return flagged.where(~bad).drop("fails_bounds", "fails_fence"), flagged.where(bad)


def drop_exact_duplicates(df: DataFrame, key: str = "ticket_id", text: str = "text") -> DataFrame:
    """Q4: first row per text.  Copies merge before the shuffle, however many there are."""
    rest = [c for c in df.columns if c != text]
    return (
        df.groupBy(text)
        .agg(F.min_by(F.struct(*rest), F.col(key)).alias("_row"))
        .select(*[F.col(f"_row.{c}") if c != text else F.col(c) for c in df.columns])
    )


def run_quality_gates(
    df: DataFrame,
    noisy_keys: DataFrame | None = None,
    key: str = "ticket_id",
    text: str = "text",
    near_threshold: float = lx.NEAR_DUPLICATE_JACCARD,
    by: list[str] | None = None,
) -> DataFrame:
    """Q13: every row with the reason that removes it, null when it stays.

    Gates run in order: length outliers, exact duplicates, near duplicates, label noise.  Each
    later gate sees only rows that passed the earlier ones.  ``noisy_keys`` are the keys found
    by the label-noise gate; without it that gate passes everything (Q12).
    """
    gated = flag_outliers(df, by, text=text).withColumn(
        "_outlier", F.col("fails_bounds") | F.col("fails_fence")
    ).drop("fails_bounds", "fails_fence")
    inside = gated.where(~F.col("_outlier"))
    first = inside.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(key).alias(key))
    first = first.select(key, F.lit(True).alias("_first"))
    unique = inside.join(first, key, "left_semi").select(key, text)
    near = neardup.near_duplicate_drops(unique, near_threshold, key, text).select(
        key, F.lit(True).alias("_near")
    )
    out = gated.join(first, key, "left").join(near, key, "left")
    noise = F.lit(False)
    if noisy_keys is not None:
        out = out.join(noisy_keys.select(key).distinct().withColumn("_noisy", F.lit(True)), key,
                       "left")
        noise = F.col("_noisy").isNotNull()
    reason = (
        F.when(F.col("_outlier"), "outlier")
        .when(F.col("_first").isNull(), "exact_duplicate")
        .when(F.col("_near").isNotNull(), "near_duplicate")
        .when(noise, "label_noise")
    )
    return out.withColumn("reason", reason).select(*df.columns, "reason")


def run_all_gates(
    df: DataFrame, vectors: DataFrame, key: str = "ticket_id", text: str = "text", label: str = "label",
    vector: str = "v", by: list[str] | None = None, near_threshold: float = lx.NEAR_DUPLICATE_JACCARD, **options,
) -> DataFrame:
    """Q13 in full: the gates of run_quality_gates, then label issues among the rows that passed them.

    vectors is (key, vector).  Rows without a vector or a label pass the noise gate, and so does
    every row if fewer remain than it needs (Q12).  options go to the out-of-fold neighbours.
    """
    gated = cut_lineage(run_quality_gates(df, None, key, text, near_threshold, by))
    left = gated.where(F.col("reason").isNull() & F.col(label).isNotNull()).select(key, label)
    known = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"))
    noisy = noise.noisy_keys(cut_lineage(left.join(known, key)), key, label=label, **options)
    marked = noisy.select(key).distinct().withColumn("_noisy", F.lit("label_noise"))
    return gated.join(marked, key, "left").withColumn("reason", F.coalesce("reason", "_noisy")).select(*gated.columns)


def quality_report(gated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Q14: counts per gate and the noise rate over the whole input."""
    removed = lambda r: F.count_if(F.col("reason") == r)
    grouped = gated.groupBy(*by) if by else gated.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(F.col("reason").isNull()).alias("n_output"),
        removed("outlier").alias("n_outliers"),
        (removed("exact_duplicate") + removed("near_duplicate")).alias("n_duplicates"),
        removed("label_noise").alias("n_noise"),
        (removed("label_noise") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("noise_rate"),
    )


def quality_distribution(gated: DataFrame) -> DataFrame:
    """Q14: kept rows by domain and label in one pass."""
    return (
        gated.where(F.col("reason").isNull())
        .groupingSets([["domain"], ["label"]], "domain", "label")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def quality_warnings(
    report: DataFrame,
    max_noise: float = lx.MAX_NOISE_RATE,
    min_rows: int = lx.MIN_ROWS_PER_DOMAIN,
) -> DataFrame:
    """Q15: one row per breached limit."""
    return report.withColumn(
        "warning",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("noise_rate") > max_noise, "noise_rate"),
                    F.when(F.col("n_output") < min_rows, "too_few_rows"),
                )
            )
        ),
    )


def dataset_stats(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Q16: rows and text-length mean, median and p95 per group."""
    lengths = df.select(*by, F.length(text).alias("_len"))
    base = lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("_len").alias("len_mean")
    )
    q = exact_quantiles(lengths, "_len", [0.5, 0.95], by)
    return base.join(broadcast_checked(q), by).select(
        *by, "n_rows", F.round("len_mean", 1).alias("len_mean"),
        F.round(F.col("q")[0], 1).alias("len_median"), F.round(F.col("q")[1], 1).alias("len_p95"),
    )
