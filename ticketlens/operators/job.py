"""E11 as one job: a sample of graded records and a table of runs give one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.operators import abtest, metrics, pareto
from ticketlens.operators.splits import first_per_group
from ticketlens.plans.scale import cut_lineage

PER_DOMAIN = 200
HEADLINE = ["n", "auto_resolution_rate", "sensitivity", "false_negative_rate", "avg_cost", "cost_reduction", "p95_ms",
            "unsupported_rate", "composite_score", "passes_gates"]


def _long(df: DataFrame, part: str, columns: list[str], group: str | None = None) -> DataFrame:
    """(part, group, metric, value) from columns; null values leave no row."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    name = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    return df.select(F.lit(part).alias("part"), name.alias("group"), F.inline(cells)).where(F.col("value").isNotNull())


def evaluation_job(records: DataFrame, runs: DataFrame, per_domain: int = PER_DOMAIN, key: str = "ticket_id",
                   by: str = "domain") -> DataFrame:
    """(part, group, metric, value): the whole evaluation of a sample, one row per figure.

    records (key, domain, label, control_pred, treatment_pred, latency_ms, text, response) are cut
    to the first per_domain rows of every domain by key, which are saved once.  Parts: headline
    (E6, E8, E11) and target (E9) over all of them, domain (E7) and claims (E10) by domain, with a
    null group for all, ab (B1) treatment against control, pareto (O1-O4) over the runs.  A null
    domain counts as `unknown`, as in E7.
    """
    sample = cut_lineage(first_per_group(records, per_domain, by, key).withColumn("pred", F.col("treatment_pred")))
    row = cut_lineage(metrics.evaluate(sample, by=by))
    frontier = cut_lineage(pareto.pareto_frontier(runs))
    best = pareto.select_best(frontier, "point_id").withColumnRenamed("point_id", "best_point")
    parts = [
        _long(row, "headline", HEADLINE),
        _long(metrics.target_table(row).withColumnRenamed("metric", "name"), "target", ["value", "target", "met"], "name"),
        _long(metrics.domain_evaluation(sample, by=by), "domain", ["n", "auto_resolution_rate", "n_escalated"], by),
        _long(metrics.unsupported_report(sample, by=by), "claims", ["n_flagged", "unsupported_rate"], by),
        _long(abtest.ab_test(sample), "ab", ["n", "accuracy_delta", "mcnemar_statistic", "p_value", "is_significant"]),
        _long(frontier.agg(F.count_if("is_pareto_optimal").alias("n_frontier"), F.count(F.lit(1)).alias("n_runs")), "pareto",
              ["n_frontier", "n_runs"]),
        _long(pareto.hypervolume(runs), "pareto", ["hypervolume"]),
        _long(best, "best", ["best_point"], "priority"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report
