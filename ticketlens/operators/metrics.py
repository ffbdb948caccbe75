"""Business evaluation metrics (E1-E11) and classification reports (M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import by_domain, unsupported_score
from ticketlens.plans.scale import exact_quantiles

COMPOSITE_WEIGHTS = {"resolution": 0.35, "sensitivity": 0.30, "latency": 0.15, "cost": 0.10,
                     "supported": 0.10}
TARGETS = [
    ("auto_resolution_rate", ">", 0.940), ("sensitivity", ">", 0.998),
    ("false_negative_rate", "<", 0.005), ("p95_ms", "<", 200.0),
    ("avg_cost", "<", 0.10), ("unsupported_rate", "<", 0.05),
]


def _with_total(per_group: DataFrame, by: str) -> DataFrame:
    """Rows per group plus a total row (null group), the total summed from the group rows."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_group.columns if c != by]
    total = per_group.agg(*sums).withColumn(by, F.lit(None).cast("string"))
    return per_group.unionByName(total)


def _grouped(df: DataFrame, by: str) -> DataFrame:
    """Null groups become `unknown`, so that null marks the total row alone."""
    return df.withColumn(by, F.coalesce(F.col(by), F.lit("unknown")))


def _counts(df: DataFrame, pred: str, label: str, by: str, *more: Column) -> DataFrame:
    """Additive counts per group: the only pass over the records."""
    df = _grouped(df, by)
    p_esc, l_esc = F.col(pred) == "escalate", F.col(label) == "escalate"
    cost = by_domain(F.col(by), lx.COST_PER_TICKET, F.lit(0.0))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~l_esc).alias("n_true_resolved"),
        F.count_if(~l_esc & ~p_esc).alias("n_both_resolved"),
        F.count_if(l_esc & p_esc).alias("tp"),
        F.count_if(~l_esc & ~p_esc).alias("tn"),
        F.count_if(~l_esc & p_esc).alias("fp"),
        F.count_if(l_esc & ~p_esc).alias("fn"),
        F.count_if(F.col(by).isin(lx.DOMAINS)).alias("n_costed"),
        F.sum(cost).alias("total_cost"),
        *more,
    )


def _rates(counts: DataFrame) -> DataFrame:
    """Rates of E1, E2 and E4 from additive counts."""
    ratio = lambda a, b: F.col(a) / F.greatest(b if not isinstance(b, str) else F.col(b), F.lit(1))
    out = counts.withColumns(
        {
            "auto_resolution_rate": ratio("n_both_resolved", "n_true_resolved"),
            "sensitivity": ratio("tp", F.col("tp") + F.col("fn")),
            "specificity": ratio("tn", F.col("tn") + F.col("fp")),
            "false_negative_rate": ratio("fn", F.col("tp") + F.col("fn")),
            "false_positive_rate": ratio("fp", F.col("tn") + F.col("fp")),
            "precision": ratio("tp", F.col("tp") + F.col("fp")),
            "avg_cost": ratio("total_cost", "n_costed"),
        }
    )
    pr, se = F.col("precision"), F.col("sensitivity")
    empty = F.col("n") == 0
    return out.withColumns(
        {
            "f1": 2 * pr * se / F.greatest(pr + se, F.lit(1e-9)),
            "meets_budget": ~empty & (F.col("false_negative_rate") < lx.FNR_BUDGET),
            "false_negative_rate": F.when(empty, 1.0).otherwise(F.col("false_negative_rate")),
            "false_positive_rate": F.when(empty, 1.0).otherwise(F.col("false_positive_rate")),
            "cost_reduction": 1.0 - F.col("avg_cost") / lx.BASELINE_COST,
        }
    )


def auto_resolution_rate(df, pred="pred", label="label", by="domain") -> DataFrame:
    """E1 by group with the total row."""
    return _rates(_with_total(_counts(df, pred, label, by), by)).select(
        by, "n", "auto_resolution_rate")


def escalation_metrics(df, pred="pred", label="label", by="domain") -> DataFrame:
    """E2 by group with the total row."""
    return _rates(_with_total(_counts(df, pred, label, by), by)).select(
        by, "n", "tp", "tn", "fp", "fn", "sensitivity", "specificity", "false_negative_rate",
        "false_positive_rate", "precision", "f1", "meets_budget")


def latency_metrics(df: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Percentiles, mean, max and the SLA flag in one row."""
    q = exact_quantiles(df, latency, [0.50, 0.95, 0.99]).withColumn("_one", F.lit(1))
    base = df.agg(F.avg(latency).alias("mean_ms"), F.max(latency).alias("max_ms"),
                  F.count(latency).alias("n")).withColumn("_one", F.lit(1))
    return base.join(q, "_one", "left").select(
        F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"),
        F.col("q")[2].alias("p99_ms"), "mean_ms", "max_ms", "n",
        (F.col("q")[1] < lx.LATENCY_SLA_MS).alias("meets_sla"))


def cost_metrics(df: DataFrame, by: str = "domain") -> DataFrame:
    """Cost per known domain and the total row with the average and reduction."""
    per = df.where(F.col(by).isin(lx.DOMAINS)).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_tickets"))
    cost = F.col("n_tickets") * by_domain(F.col(by), lx.COST_PER_TICKET, F.lit(0.0))
    out = _with_total(per.withColumn("total_cost", cost), by)
    avg = F.col("total_cost") / F.greatest("n_tickets", F.lit(1))
    return out.withColumn("avg_cost", avg).withColumn(
        "cost_reduction_pct", (1.0 - F.col("avg_cost") / lx.BASELINE_COST) * 100.0)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n): the one aggregation behind reports and matrices."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """M4: precision, recall, F1 and support per class of truth or prediction."""
    m = confusion(df, truth, pred)
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    by_truth = m.groupBy(F.col("truth").alias("class")).agg(
        F.sum("n").alias("support"), hit.alias("tp"))
    by_pred = m.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = by_truth.join(by_pred, "class", "full")
    precision = zero("tp") / F.greatest(zero("predicted"), F.lit(1))
    recall = zero("tp") / F.greatest(zero("support"), F.lit(1))
    return joined.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
        zero("support").cast("bigint").alias("support"), zero("tp").cast("bigint").alias("tp"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: list[str]) -> DataFrame:
    """M4 / E5: matrix with one column per predicted class."""
    return (confusion(df, truth, pred).groupBy("truth").pivot("pred", classes)
            .agg(F.sum("n")).na.fill(0))


def routing_accuracy(df: DataFrame, truth: str = "domain", pred: str = "pred") -> DataFrame:
    """E5: accuracy, macro and weighted F1 in one row; classes seen on either side count."""
    report = classification_report(df, truth, pred)
    return report.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def composite_score(row: DataFrame) -> DataFrame:
    """E6 on rows with resolution, sensitivity, p95, cost reduction and unsupported rate."""
    w = COMPOSITE_WEIGHTS
    sla = lx.LATENCY_SLA_MS
    latency = F.when(F.col("p95_ms") < sla, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (F.col("p95_ms") - sla) / sla))
    return row.withColumn(
        "composite_score",
        w["resolution"] * F.col("auto_resolution_rate")
        + w["sensitivity"] * F.col("sensitivity")
        + w["latency"] * latency
        + w["cost"] * F.least(F.col("cost_reduction"), F.lit(1.0))
        + w["supported"] * F.greatest(F.lit(0.0), 1.0 - F.col("unsupported_rate") * 10.0),
    )


def domain_evaluation(df, pred="pred", label="label", by="domain") -> DataFrame:
    """Overall and per-domain figures from one pass over the records."""
    counts = _counts(df, pred, label, by, F.sum(F.length("response")).alias("sum_len"),
                     F.count_if(F.col(pred) == "escalate").alias("n_escalated"))
    both = _with_total(counts, by)
    return _rates(both).withColumn(
        "mean_response_length", F.col("sum_len") / F.greatest("n", F.lit(1))
    ).withColumn("n_resolved", F.col("n") - F.col("n_escalated"))


def unsupported_report(df, threshold=lx.UNSUPPORTED_EVAL_THRESHOLD, by="domain") -> DataFrame:
    """Flagged responses, rate and mean confidence by group with the total row."""
    scored = _grouped(df, by).select(by, unsupported_score(F.col("text"), F.col("response")).alias("_s"))
    per = scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_s") >= threshold).alias("n_flagged"),
        F.sum("_s").alias("_sum"))
    out = _with_total(per, by)
    return out.select(
        by, "n_total", "n_flagged",
        (F.col("n_flagged") / F.greatest("n_total", F.lit(1))).alias("unsupported_rate"),
        (F.col("_sum") / F.greatest("n_total", F.lit(1))).alias("avg_confidence"))


def evaluate(df, pred="pred", label="label", by="domain", latency="latency_ms") -> DataFrame:
    """One row with every headline figure, the composite score and the gates."""
    one = lambda x: x.withColumn("_one", F.lit(1))
    total = one(_rates(_with_total(_counts(df, pred, label, by), by)).where(F.col(by).isNull())
                .select("n", "auto_resolution_rate", "sensitivity", "false_negative_rate",
                        "meets_budget", "avg_cost", "cost_reduction"))
    speed = one(latency_metrics(df, latency).select("p95_ms", "meets_sla"))
    claims = one(unsupported_report(df, by=by).where(F.col(by).isNull())
                 .select("unsupported_rate"))
    row = total.join(speed, "_one").join(claims, "_one").drop("_one")
    return passes_gates(composite_score(row))


def passes_gates(row: DataFrame) -> DataFrame:
    """E8."""
    return row.withColumn(
        "passes_gates",
        F.col("meets_budget") & F.col("meets_sla")
        & (F.col("unsupported_rate") < lx.UNSUPPORTED_RATE_GATE))


def target_table(row: DataFrame) -> DataFrame:
    """Metric, value, target and whether it is met."""
    cells = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
            F.lit(op).alias("comparison"), F.lit(t).alias("target"),
            (F.col(m) > t if op == ">" else F.col(m) < t).alias("met"))
        for m, op, t in TARGETS
    ])
    return row.select(F.inline(cells))
