"""Exact-size splits, samples and template augmentation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import by_domain, seeded_index
from ticketlens.plans.scale import seeded_rank


def stratified_split(
    df: DataFrame, frac: float, by: str | None, seed: int = 42, key: str = "ticket_id",
    names=("train", "test"),
) -> DataFrame:
    """round(frac * size) rows of every stratum go to the second split, exactly.

    X2: without a stratum column, or with fewer than two strata, the first
    int(n * (1 - frac)) rows of the seeded order go to the first split.
    """
    strata = df.select(by).distinct().limit(2).count() if by else 0
    if strata < 2:
        ranked = seeded_rank(df, seed, key)
        first = F.col("rank") <= F.floor(F.col("_total") * F.lit(1.0 - frac))
        side = F.when(first, names[0]).otherwise(names[1])
    else:
        ranked = seeded_rank(df, seed, key, [by])
        second = F.col("rank") <= F.round(F.col("_total") * F.lit(float(frac)))
        side = F.when(second, names[1]).otherwise(names[0])
    return ranked.withColumn("split", side).drop("rank", "_total")


def three_way_split(
    df: DataFrame, test: float = 0.1, val: float = 0.1, by: str = "domain", seed: int = 42,
    key: str = "ticket_id",
) -> DataFrame:
    """The test part first, then the validation part of the rest, in one ranking."""
    ranked = seeded_rank(df, seed, key, [by])
    rest = F.floor(F.col("_total") * F.lit(1.0 - test))
    train = F.floor(rest * F.lit(1.0 - val / (1.0 - test)))
    side = (
        F.when(F.col("rank") <= train, "train").when(F.col("rank") <= rest, "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", side).drop("rank", "_total")


def merge_domains(parts: dict[str, DataFrame], seed: int = 42, key: str = "ticket_id"):
    """Concatenate per-domain frames, add a missing domain, order by the seeded hash."""
    merged = None
    for domain, part in parts.items():
        if "domain" not in part.columns:
            part = part.withColumn("domain", F.lit(domain))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return seeded_order(merged, seed, key)


def seeded_order(df: DataFrame, seed: int = 42, key: str = "ticket_id") -> DataFrame:
    """Repeatable shuffle as a position column; no task sees a whole table."""
    return seeded_rank(df, seed, key).withColumnRenamed("rank", "position").drop("_total")


def first_per_group(df: DataFrame, n: int, by: str = "domain", key: str = "ticket_id"):
    """First n rows by key per group; the limit applies before the shuffle."""
    w = Window.partitionBy(by).orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def eval_sample(
    df: DataFrame, n: int, prefer=("test", "val"), by: str = "domain", key: str = "ticket_id"
) -> DataFrame:
    """The first existing split per group, then its first n rows."""
    order = F.array_position(F.array(*[F.lit(s) for s in prefer]), F.col("split"))
    usable = df.where(F.col("split").isin(list(prefer))).withColumn("_o", order)
    best = usable.groupBy(by).agg(F.min("_o").alias("_o"))
    return first_per_group(usable.join(best, [by, "_o"], "left_semi").drop("_o"), n, by, key)


def _template_text(template: str, seed, index: Column) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            if piece:
                out.append(F.lit(piece))
        else:
            values = lx.SLOT_VALUES[piece]
            pick = F.pmod(seeded_index(seed, index, F.lit(k)), F.lit(len(values))).cast("int")
            out.append(F.element_at(F.array(*[F.lit(v) for v in values]), pick + 1))
    return F.concat(*out)


def template_text(domain: Column, index: Column, seed=42) -> Column:
    """Template index modulo the number of templates, slots filled by seeded choice."""
    branches = {}
    for d, templates in lx.TEMPLATES.items():
        which = F.pmod(index, F.lit(len(templates)))
        text = None
        for t, template in enumerate(templates):
            filled = _template_text(template, f"{seed}-{d}", index)
            text = F.when(which == t, filled) if text is None else text.when(which == t, filled)
        branches[d] = text
    return by_domain(domain, branches, F.lit(None).cast("string"))


def augment_to_target(
    df: DataFrame, targets: DataFrame, seed=42, chunk: int = 10_000
) -> DataFrame:
    """Template rows that lift every domain to its target size.

    targets (domain, target).  The shortfall is cut into chunks that are spread over the tasks
    before rows are generated, so no task produces a whole domain.
    """
    have = df.groupBy("domain").agg(F.count(F.lit(1)).alias("_have"))
    missing = targets.join(have, "domain", "left").select(
        "domain",
        F.greatest(F.col("target") - F.coalesce("_have", F.lit(0)), F.lit(0)).alias("_n"),
    ).where(F.col("_n") > 0)
    chunks = missing.withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                   F.floor((F.col("_n") - 1) / chunk).cast("bigint")))
    ).repartition("domain", "_c")
    rows = chunks.withColumn(
        "i", F.explode(F.sequence(F.col("_c") * chunk,
                                  F.least((F.col("_c") + 1) * chunk, F.col("_n")) - 1)))
    return rows.select(
        F.concat_ws("-", "domain", F.col("i").cast("string")).alias("example_id"), "domain", "i",
        template_text(F.col("domain"), F.col("i"), seed).alias("text"),
        F.when(F.col("domain") == "escalation", "escalate").otherwise("resolved").alias("label"),
        F.lit("template").alias("source"), F.lit("").alias("response"))


def augmented_dataset(df: DataFrame, targets: DataFrame, seed=42) -> DataFrame:
    """The seeds and the template rows that lift every domain to its target, in seeded order.

    df (ticket_id, domain, text, label, and source and response where it has them).  Counts by
    source follow from the result's source column.
    """
    have = {"source": F.lit("seed"), "response": F.lit("")}
    seeds = df.select(
        F.col("ticket_id").cast("string").alias("example_id"), "domain", "text", "label",
        *[F.coalesce(F.col(c), d).alias(c) if c in df.columns else d.alias(c) for c, d in have.items()])
    rows = seeds.unionByName(augment_to_target(df, targets, seed).drop("i"))
    return seeded_order(rows, seed, "example_id")
