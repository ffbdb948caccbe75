"""Label noise: out-of-fold neighbours, confident learning, centroid distance (Q9-Q12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import seeded_hash
from ticketlens.functions.vectors import as_double, cosine, l2_normalise
from ticketlens.operators.vectors import prototypes, top_neighbours
from ticketlens.plans.scale import at_most, broadcast_checked, cut_lineage, seeded_rank

CLIP = 1e-6
MIN_ROWS = 20
MAX_CLASSES = 1000


def oof_knn_probs(
    df: DataFrame, k: int = 5, folds: int = 5, seed: int = 42, key: str = "vec_id",
    label: str = "label", vector: str = "v",
) -> DataFrame:
    """Q9: (key, given, class, prob) by votes of the k nearest rows outside the own fold.

    Folds are stratified by the rank of the seeded hash inside the label.
    """
    n = df.count()
    k = max(1, min(k, n // folds))
    ranked = seeded_rank(df.select(key, label, vector), seed, key, [label])
    folded = ranked.withColumn("fold", (F.col("rank") - 1) % folds).select(
        key, F.col(label).cast("string").alias("given"), vector, "fold")
    # all pairs are compared here; the probabilities are read several times
    near = cut_lineage(top_neighbours(folded, folded, k, key, key, "given", vector, "euclidean", "fold")
                       .select("query_id", "label"))
    votes = near.groupBy("query_id", "label").agg((F.count(F.lit(1)) / k).alias("share"))
    classes = [r[0] for r in folded.select("given").distinct().orderBy("given")
               .limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    # at most k classes per row
    found = votes.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("found"))
    clipped = folded.select(F.col(key), "given").join(
        found, F.col(key) == F.col("query_id"), "left").select(
        key, "given",
        F.transform(
            F.array(*[F.lit(c) for c in classes]),
            lambda c: F.struct(
                c.alias("class"),
                F.least(F.greatest(F.coalesce(F.try_element_at("found", c), F.lit(0.0)),
                                   F.lit(CLIP)), F.lit(1.0 - CLIP)).alias("p")),
        ).alias("ps"))
    total = F.aggregate("ps", F.lit(0.0), lambda a, s: a + s["p"])
    return clipped.withColumn("total", total).select(
        key, "given", F.explode("ps").alias("s"), "total").select(
        key, "given", F.col("s.class").alias("class"),
        (F.col("s.p") / F.col("total")).alias("prob"))


def label_issues(probs: DataFrame, key: str = "vec_id") -> DataFrame:
    """Q10: keys whose label is likely wrong, with the suggested class and own confidence.

    Confident learning (Northcutt et al. 2021): class thresholds are mean self-confidences; a
    row counts for the most probable class that reaches its threshold; the joint is calibrated
    to the label counts; from every cell (given, other) the rows with the largest margin go.
    Rows whose most probable class is the given one stay.  Ranking inside a cell works on
    counts per margin value and hash slice, never on a whole cell in one task.
    """
    p = F.round("prob", 9)
    thresholds = probs.where(F.col("class") == F.col("given")).groupBy("class").agg(
        F.avg("prob").alias("t"), F.count(F.lit(1)).alias("n_given"))
    above = probs.join(broadcast_checked(thresholds.select("class", "t")), "class").where(
        F.col("prob") >= F.col("t") - 1e-12)
    pick = above.groupBy(key).agg(
        F.first("given").alias("given"),
        F.min_by("class", F.struct((-p).alias("o"), F.col("class"))).alias("class"))
    cells = pick.groupBy("given", "class").agg(F.count(F.lit(1)).alias("c"))
    # class-by-class tables from here: at most the squared number of classes
    rows = cells.withColumn("row", F.sum("c").over(Window.partitionBy("given")))
    given = thresholds.select(F.col("class").alias("given"), "n_given")
    joint = rows.join(given, "given").withColumn(
        "q", F.col("c") / F.col("row") * F.col("n_given"))
    prune = joint.where(F.col("given") != F.col("class")).select(
        "given", "class", F.round("q").cast("bigint").alias("n_prune")).where("n_prune > 0")
    best = probs.groupBy(key).agg(
        F.min_by("class", F.struct((-p).alias("o"), F.col("class"))).alias("predicted"),
        F.max(F.when(F.col("class") == F.col("given"), F.col("prob"))).alias("own"))
    margins = (
        probs.where(F.col("class") != F.col("given"))
        .join(broadcast_checked(prune), ["given", "class"])
        .join(best, key)
        .withColumn("margin", F.round(F.col("prob") - F.col("own"), 9))
        .withColumn("h", seeded_hash(0, F.col(key)))
        .withColumn("slice", F.substring("h", 1, 3))
    )
    group = Window.partitionBy("given", "class")
    sizes = margins.groupBy("given", "class", "margin", "slice").agg(
        F.count(F.lit(1)).alias("_n"))
    before = group.orderBy(F.col("margin").desc(), "slice").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(
        Window.partitionBy("given", "class", "margin", "slice").orderBy("h", key))
    ranked = margins.withColumn("_in", inside).join(
        sizes.drop("_n"), ["given", "class", "margin", "slice"])
    flagged = ranked.where((F.col("_before") + F.col("_in") <= F.col("n_prune"))
                           & (F.col("predicted") != F.col("given")))
    return flagged.groupBy(key).agg(
        F.first("given").alias("given"), F.first("predicted").alias("suggested"),
        F.first("own").alias("self_confidence"))


def centroid_outliers(
    df: DataFrame, threshold: float = lx.CENTROID_COSINE, key: str = "vec_id",
    label: str = "label", vector: str = "v",
) -> DataFrame:
    """Q11: rows whose cosine to the centroid of their own class is below the threshold."""
    unit = df.select(key, label, l2_normalise(as_double(F.col(vector))).alias("u"))
    centroid = prototypes(unit, label, "u").select(label, F.col("prototype").alias("c"))
    return unit.join(broadcast_checked(centroid, 10_000), label).select(
        key, label, cosine(F.col("u"), F.col("c")).alias("similarity")).where(
        F.col("similarity") < threshold)


def noisy_keys(df: DataFrame, key: str = "vec_id", vector: str | None = "v", **options):
    """Q12: keys found by Q10, none without vectors or below the minimum number of rows."""
    if vector is None or vector not in df.columns or at_most(df, MIN_ROWS - 1):
        return df.select(key).limit(0)
    return label_issues(oof_knn_probs(df, key=key, vector=vector, **options), key).select(key)
