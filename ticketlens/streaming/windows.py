"""Append-mode event-time windows and sessions: closed windows leave the state, late rows are counted.

A closed window is written once and its state dropped; rows older than the watermark are dropped
and counted.  Sinks are folders, so a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketlens.operators import drift, monitoring
from ticketlens.operators.clean import finalise_traces
from ticketlens.streaming.monitors import WATERMARK, event_time

ONCE = {"availableNow": True}
PROGRESS = ("batch_id bigint, watermark string, input_rows bigint, late_rows bigint, state_rows bigint, "
            "state_bytes bigint")


def first_deliveries(rows: DataFrame, key: str, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Rows on time, each key once; a key is remembered until the watermark has passed it by the delay.

    This operator sees single rows, so what it drops behind the watermark is the number of late rows.
    """
    return event_time(rows, ts, delay).dropDuplicatesWithinWatermark([key])


def closed_windows(rows: DataFrame, width: str, aggregates: list[Column], by: tuple = (), slide: str | None = None,
                   ts: str = "ts") -> DataFrame:
    """window_start, window_end, the keys and the aggregates of event-time windows.

    rows needs a watermark.  On a stream in append mode a window comes out once the watermark has
    passed its end and then leaves the state.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(window.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in out.columns if c != "w"])


def append_batches(df: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Start an append-mode query that writes parquet below path/data, one folder per batch.

    A repeated batch overwrites its own folder.  finish turns the rows that a batch closes into
    what is written; all groups of a window close in the same batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = finish(batch) if finish else batch
        out.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id:012d}")

    return (df.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or ONCE)).start())


def log_progress(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """Write what the query reports of its batches below path/progress; a run overwrites its own part.

    A query keeps its last spark.sql.streaming.numRecentProgressUpdates batches: call it at least
    as often.
    """
    rows = []
    for p in query.recentProgress:
        states = p["stateOperators"]
        rows.append((p["batchId"], p.get("eventTime", {}).get("watermark"), p["numInputRows"],
                     sum(s["numRowsDroppedByWatermark"] for s in states),
                     sum(s["numRowsTotal"] for s in states), sum(s["memoryUsedBytes"] for s in states)))
    spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("overwrite").json(f"{path}/progress/run={query.runId}")


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").drop("batch")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch that was logged: watermark, input, late and state rows."""
    return spark.read.schema(PROGRESS).json(f"{path}/progress").drop("run")


def closed_counters(traces: DataFrame, width: str = "1 hour") -> DataFrame:
    """W1 by window: every counter of the traces that came in on time."""
    rows = finalise_traces(traces).select("ts", F.inline(monitoring.metric_rows(traces)))
    return closed_windows(rows, width, [F.sum("x").alias("value")], ("metric", "label_1", "label_2", "label_3"))


def closed_resolution(traces: DataFrame, width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Share resolved without escalation per closed sliding window and domain."""
    return closed_windows(traces, width, [
        F.avg((~F.col("escalation_detected")).cast("int")).alias("auto_resolution_rate"),
        F.count(F.lit(1)).alias("n")], ("domain",), slide)


def closed_series(traces: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Counts, rates and latency quantiles per closed bucket."""
    out = closed_windows(traces.withColumn("_ms", monitoring.total_latency()), bucket, [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("escalation_detected").cast("int")).alias("escalation_rate"),
        F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
        F.percentile_approx("_ms", [0.5, 0.95], 10_000).alias("q")])
    return out.select("window_start", "n", "escalation_rate", "cache_hit_rate",
                      F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"))


def closed_drift_checks(probes: DataFrame, path: str, every: str = "30 minutes", trigger: dict | None = None):
    """D10 in append mode: the domains of a window close together, so its report is made in that batch."""
    stats = closed_windows(probes, every, [F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n")], ("domain",))

    def report(batch: DataFrame) -> DataFrame:
        windows = batch.select(F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("w"),
                               "domain", "mean_sim", "n")
        return drift.checks_from_stats(windows)

    return append_batches(stats, path, report, trigger)


def _contacts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_contacts"), F.count_if("escalation_detected").alias("n_escalated"),
            F.max("ts").alias("last_ts")]


def _session_rows(found: DataFrame, customer: str, min_contacts: int) -> DataFrame:
    return found.select(customer, F.col("session.start").alias("first_ts"), "last_ts", "n_contacts", "n_escalated",
                        (F.col("n_contacts") >= min_contacts).alias("repeated_contact"))


def session_stream(traces: DataFrame, gap: str = "2 hours", min_contacts: int = 3, customer: str = "customer_id") -> DataFrame:
    """Contact sessions of a customer: contacts no further apart than the gap, both ends included.

    traces needs a watermark.  State is one row per open session; a session comes out once the
    watermark has passed its last contact by the gap.
    """
    found = traces.groupBy(F.session_window("ts", gap).alias("session"), customer).agg(*_contacts())
    return _session_rows(found, customer, min_contacts)


def sessions(traces: DataFrame, gap_seconds: int = 7200, min_contacts: int = 3, customer: str = "customer_id",
             bucket: str = "day") -> DataFrame:
    """The same on a table.  Rows without time or customer: no session without time, a null customer is one.

    Sessions are first built inside time buckets, which combines a busy customer's contacts in as
    many groups as there are buckets, and then joined across buckets where the gap allows: what is
    left of a customer by then is at most one row per bucket and one per session.
    """
    rows = traces.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts").isNotNull())
    parts = rows.groupBy(F.date_trunc(bucket, "ts").alias("b"), F.session_window("ts", f"{gap_seconds} seconds").alias("session"),
                         customer).agg(*_contacts())
    order = Window.partitionBy(customer).orderBy("session.start")
    before = F.max("last_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.unix_micros(F.col("session.start")) - F.unix_micros(before) > gap_seconds * 1_000_000)
    island = F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = parts.withColumn("_new", new).withColumn("_island", island).groupBy(customer, "_island").agg(
        F.min_by("session", "session.start").alias("session"), F.max("last_ts").alias("last_ts"),
        F.sum("n_contacts").alias("n_contacts"), F.sum("n_escalated").alias("n_escalated"))
    return _session_rows(whole, customer, min_contacts)
