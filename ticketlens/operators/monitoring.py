"""Trace counters, histograms, snapshots, series and alert rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.operators.clean import finalise_traces, total_latency
from ticketlens.plans.scale import exact_quantiles

STAGES = ["router", "lora_load", "generation", "safety", "total"]


def metric_rows(df: DataFrame):
    """Each trace as its counter increments: array<struct<metric, label_1, label_2, label_3, x>>."""
    def row(metric, a=None, b=None, c=None, value=None, when=None):
        text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
        s = F.struct(F.lit(metric).alias("metric"), text(a).alias("label_1"),
                     text(b).alias("label_2"), text(c).alias("label_3"),
                     (F.lit(1.0) if value is None else value).alias("x"))
        return s if when is None else F.when(when, s)

    confident = F.col("routing_confidence") >= lx.ROUTING_CONFIDENT
    reason = F.when(F.col("escalation_score") > 0.5, "keyword").otherwise("model")
    return F.array_compact(F.array(
        row("requests", F.col("domain"), F.col("status")),
        row("routing", F.col("domain"), F.col("routing_method"), confident),
        row("cache", F.col("cache_hit")),
        row("unsupported", F.col("domain"), F.col("unsupported_flagged")),
        row("cost", F.col("domain"), value=F.col("cost")),
        row("escalations", reason, when=F.col("escalation_detected")),
    ))


def trace_counters(df: DataFrame) -> DataFrame:
    """All counters in one aggregation; the same plan runs on a stream in update mode."""
    rows = finalise_traces(df).select(F.inline(metric_rows(df)))
    return rows.groupBy("metric", "label_1", "label_2", "label_3").agg(F.sum("x").alias("value"))


def latency_histogram(df: DataFrame) -> DataFrame:
    """Cumulative bucket counts, count and sum (seconds) by domain and stage."""
    seconds = {
        "router": F.col("router_ms"), "lora_load": F.col("lora_load_ms"),
        "generation": F.col("generation_ms"), "safety": F.col("safety_ms"),
        "total": total_latency(),
    }
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), (c / 1000.0).alias("s"))
                       for s, c in seconds.items()])
    long = df.select("domain", F.inline(stages))
    return long.groupBy("domain", "stage").agg(
        *[F.count_if(F.col("s") <= b).alias(f"le_{str(b).replace('.', '_')}")
          for b in lx.LATENCY_BUCKETS_S],
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("sum_s"))


def metrics_snapshot(df: DataFrame) -> DataFrame:
    """Totals, rates and latency percentiles in one row."""
    timed = df.withColumn("_ms", total_latency())
    base = timed.agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if("escalation_detected").alias("escalations_total"),
        F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
        F.count_if("unsupported_flagged").alias("unsupported_flagged"),
    ).withColumn("_one", F.lit(1))
    q = exact_quantiles(timed, "_ms", [0.5, 0.95]).withColumn("_one", F.lit(1))
    return base.join(q, "_one").select(
        "requests_total", "escalations_total", F.round("cache_hit_rate", 3).alias("cache_hit_rate"),
        "unsupported_flagged", F.col("q")[0].alias("latency_p50_ms"),
        F.col("q")[1].alias("latency_p95_ms"))


def snapshot_record(df: DataFrame) -> DataFrame:
    """W3 as the service reports it: the snapshot with the requests of every domain as a map."""
    domains = df.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    # as many entries as domains
    counts = domains.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))).alias("domain_distribution"))
    return metrics_snapshot(df).withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


def domain_shares(df: DataFrame) -> DataFrame:
    """Requests per domain and their share; the window runs over the few domain rows."""
    counts = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def kpi_status(row: DataFrame) -> DataFrame:
    """Status bands of the headline figures."""
    arr = F.col("auto_resolution_rate")
    return row.withColumns({
        "resolution_status": F.when(arr >= 0.94, "good").when(arr >= 0.90, "warn")
        .otherwise("critical"),
        "fnr_status": F.when(F.col("false_negative_rate") <= lx.FNR_BUDGET, "good")
        .otherwise("critical"),
        "latency_status": F.when(F.col("p95_ms") < lx.LATENCY_SLA_MS, "good")
        .otherwise("critical"),
    })


def rolling_resolution(df: DataFrame, width="1 hour", slide="5 minutes", ts="ts") -> DataFrame:
    """Share of requests resolved without escalation per sliding window and domain."""
    return df.groupBy(F.window(F.col(ts).cast("timestamp"), width, slide).alias("w"),
                      "domain").agg(
        F.avg((~F.col("escalation_detected")).cast("int")).alias("auto_resolution_rate"),
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "domain", "auto_resolution_rate", "n")


def sparklines(df: DataFrame, bucket="1 day", points: int = 24, ts="ts") -> DataFrame:
    """The latest buckets of resolution rate, p95 latency and escalation rate."""
    placed = df.select(
        F.window(F.col(ts).cast("timestamp"), bucket)["start"].alias("bucket"),
        "escalation_detected", total_latency().alias("_ms"))
    base = placed.groupBy("bucket").agg(
        F.avg((~F.col("escalation_detected")).cast("int")).alias("auto_resolution_rate"),
        F.avg(F.col("escalation_detected").cast("int")).alias("escalation_rate"))
    latest = base.orderBy(F.col("bucket").desc()).limit(points)
    # quantiles of the shown buckets alone
    shown = placed.join(F.broadcast(latest.select("bucket")), "bucket", "left_semi")
    q = exact_quantiles(shown, "_ms", [0.95], ["bucket"])
    return latest.join(q, "bucket").select(
        "bucket", "auto_resolution_rate", "escalation_rate", F.col("q")[0].alias("p95_ms"))


def sparklines_with_drift(df: DataFrame, checks: DataFrame, bucket="1 day", points: int = 24, ts="ts") -> DataFrame:
    """W5 in full: the series of sparklines and drift_delta, the largest loss of similarity that D10 saw in a bucket.

    A bucket without a check has a null delta.
    """
    deltas = checks.groupBy(F.window(F.col("window_start").cast("timestamp"), bucket)["start"].alias("bucket")).agg(
        F.max(1.0 - F.col("min_mean_sim")).alias("drift_delta"))
    return sparklines(df, bucket, points, ts).join(deltas, "bucket", "left")


def rule_table(spark, rules=None) -> DataFrame:
    """Alert rules as data."""
    rows = [r[:6] for r in (rules or lx.ALERT_RULES)]
    return spark.createDataFrame(
        rows, "rule_name string, level string, metric string, comparison string, "
              "threshold double, cooldown_s int")


def _message(rules):
    out = None
    for name, _, _, _, _, _, text, scale in rules:
        if name == "semantic_drift_warn":  # the value is a flag; domains and divergence say more
            m = F.concat(F.lit(text), F.coalesce("drifted_domains", F.lit("")), F.lit(" kl="),
                         F.format_string("%.4f", F.coalesce("drift_kl", F.lit(0.0))))
        else:
            m = F.format_string(text, F.col("value") * F.lit(scale))
        out = F.when(F.col("rule_name") == name, m) if out is None else out.when(
            F.col("rule_name") == name, m)
    return out


def evaluate_rules(snapshots: DataFrame, rules: list | None = None, ts: str = "ts") -> DataFrame:
    """Every (snapshot, rule) with the breach flag; a missing metric never breaches.

    snapshots has one column per metric.  Works on batch and streaming frames.
    """
    rules = rules or lx.ALERT_RULES
    metrics = [m for m in dict.fromkeys(r[2] for r in rules) if m in snapshots.columns]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    extra = {"drifted_domains": "string", "kl_divergence": "double"}
    extra = [(F.col(c) if c in snapshots.columns else F.lit(None)).cast(k).alias(
        "drift_kl" if c == "kl_divergence" else c) for c, k in extra.items()]
    long = snapshots.select(ts, *extra, F.inline(cells))
    # the rule list is a handful of rows
    joined = long.join(F.broadcast(rule_table(snapshots.sparkSession, rules)), "metric")
    breach = F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold"))
    return joined.withColumn("breach", F.coalesce(breach, F.lit(False))).withColumn(
        "message", F.when(F.col("breach"), _message(rules))).drop("drifted_domains", "drift_kl")


def _alert_flow(evaluated: DataFrame, ts: str = "ts") -> DataFrame:
    """Evaluations with the breach state before them and the start of their episode.

    A rule's history is cut by day before anything is ordered: changes are found inside a day
    and the state at the end of a day is carried on through the small per-day table.
    """
    rows = evaluated.select(
        "rule_name", "level", F.col(ts).cast("timestamp").alias("ts"), "breach", "cooldown_s",
        "message", F.to_date(ts).alias("day"))
    inside = Window.partitionBy("rule_name", "day").orderBy("ts")
    ends = rows.groupBy("rule_name", "day").agg(F.max_by("breach", "ts").alias("last"))
    days = Window.partitionBy("rule_name").orderBy("day")
    ends = ends.withColumn("prev", F.lag("last").over(days)).drop("last")
    flow = rows.withColumn("before", F.lag("breach").over(inside)).join(
        ends, ["rule_name", "day"]).withColumn(
        "before", F.coalesce("before", "prev", F.lit(False))).withColumn(
        "start", F.when(F.col("breach") & ~F.col("before"), F.col("ts"))).withColumn(
        "own_start", F.last("start", True).over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = flow.groupBy("rule_name", "day").agg(F.max("start").alias("day_start"))
    starts = starts.withColumn("carried", F.last("day_start", True).over(
        days.rowsBetween(Window.unboundedPreceding, -1))).drop("day_start")
    return flow.join(starts, ["rule_name", "day"]).withColumn(
        "fired_at", F.when(F.col("breach"), F.coalesce("own_start", "carried")))


def alert_episodes(evaluated: DataFrame, ts: str = "ts") -> DataFrame:
    """Runs of consecutive breaches per rule (gaps and islands), with resolve time."""
    flow = _alert_flow(evaluated, ts)
    changes = flow.where(F.col("breach") != F.col("before"))
    # only state changes from here on
    nxt = F.lead("ts").over(Window.partitionBy("rule_name").orderBy("ts"))
    return changes.withColumn("resolved_at", nxt).where("breach").select(
        "rule_name", "level", F.col("ts").alias("fired_at"), "resolved_at")


def fire_times(times, breaches, cooldown: float, active: bool, last: float):
    """One rule's state machine: fire on a breach unless active and within the cooldown."""
    fired = []
    for t, b in zip(times, breaches):
        if not b:
            active = False
            continue
        if active and t - last < cooldown:
            continue
        active, last = True, t
        fired.append(t)
    return fired, active, last


def alert_fires(evaluated: DataFrame, ts: str = "ts") -> DataFrame:
    """All fires including re-fires after the cooldown.

    The recurrence restarts with every episode, so each episode is its own group.  A group holds
    the evaluations of one rule in one breach: it grows with time, not with the traffic.
    """
    rows = _alert_flow(evaluated, ts).where("breach")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        seconds = (pdf["ts"] - pd.Timestamp(0)).dt.total_seconds()
        fired, _, _ = fire_times(seconds, [True] * len(pdf), float(pdf["cooldown_s"].iloc[0]),
                                 False, 0.0)
        return pdf.loc[seconds.isin(fired), ["rule_name", "ts", "message"]]

    return rows.select("rule_name", "fired_at", "ts", "cooldown_s", "message").groupBy(
        "rule_name", "fired_at").applyInPandas(
        walk, "rule_name string, ts timestamp, message string")


def active_alerts(evaluated: DataFrame, ts: str = "ts") -> DataFrame:
    """Rules breaching in their latest evaluation, counted by level."""
    last = evaluated.groupBy("rule_name", "level").agg(F.max_by("breach", ts).alias("active"))
    return last.where("active").groupBy("level").agg(F.count(F.lit(1)).alias("n_active"))


def dashboard_snapshot(metrics, evaluation, drift, pareto, ab, alerts) -> DataFrame:
    """One nested record from one-row frames; alerts by level as a map.

    A frame with more than one row is an error; an empty one leaves its part null.
    """
    def one(df, name):
        single = df.agg(F.first(F.struct("*")).alias(name), F.count(F.lit(1)).alias("_rows"))
        checked = F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"{name} has more than one row"))
                         .cast(single.schema[name].dataType)).otherwise(F.col(name))
        return single.select(checked.alias(name), F.lit(1).alias("_one"))

    levels = alerts.agg(
        F.map_from_entries(F.collect_list(F.struct("level", "n_active"))).alias("alerts"),
        F.coalesce(F.sum("n_active"), F.lit(0)).alias("n_alerts")).withColumn("_one", F.lit(1))
    out = one(metrics, "metrics")
    for df, name in ((evaluation, "evaluation"), (drift, "drift"), (pareto, "pareto"),
                     (ab, "ab_test")):
        out = out.join(one(df, name), "_one", "left")
    return out.join(levels, "_one", "left").drop("_one")


def dashboard_record(snapshot: DataFrame, checkpoints: DataFrame, series: DataFrame) -> DataFrame:
    """W6 in full: the record of dashboard_snapshot with the domains that have checkpoints and the sparklines.

    series is what sparklines gives, a bounded number of buckets; each becomes a list in time
    order.
    """
    one = lambda x: x.withColumn("_one", F.lit(1))
    # as many entries as domains, and as buckets
    known = checkpoints.where(F.col("domain").isNotNull()).agg(
        F.sort_array(F.collect_set("domain")).alias("domains"), F.countDistinct("domain").alias("n_domains")).select(
        F.struct("domains", "n_domains").alias("checkpoints"))
    columns = [c for c in series.columns if c != "bucket"]
    rows = series.agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias("_s"))
    lines = rows.select(F.struct(*[F.col(f"_s.{c}").alias(c) for c in columns], F.size("_s").alias("n_points")).alias("sparklines"))
    return one(snapshot).join(one(known), "_one").join(one(lines), "_one").drop("_one")
