"""Structured Streaming forms of the monitoring operators.

Every function takes a streaming DataFrame and a folder; sinks are files below that folder, so a
restarted query goes on from its checkpoint.  Event time is a TIMESTAMP column ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticketlens.operators import drift, monitoring
from ticketlens.operators.monitoring import fire_times

WATERMARK = "10 minutes"


def event_time(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Cast event time to TIMESTAMP and set the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def append_files(df: DataFrame, path: str):
    """Start an append query that drains what is there and writes parquet below path/data."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data")
            .trigger(availableNow=True).start())


def replace_table(df: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] | None = None):
    """Start a complete-mode query; each batch writes the whole result as its own version.

    Versions are named by batch id, so a repeated batch overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = finish(batch) if finish else batch
        out.write.mode("overwrite").parquet(f"{path}/data/version={batch_id:012d}")

    return (df.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def latest_version(spark, path: str) -> DataFrame:
    """The newest version written by replace_table or rolling_probe."""
    versions = spark.read.parquet(f"{path}/data")
    newest = versions.select(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def counters_stream(traces: DataFrame, path: str):
    """W1."""
    return replace_table(monitoring.trace_counters(traces), path)


def rolling_resolution_stream(traces: DataFrame, path: str):
    """W4 with the watermark bounding the state."""
    return replace_table(monitoring.rolling_resolution(event_time(traces)), path)


def series_stream(traces: DataFrame, path: str, bucket: str = "1 hour"):
    """Per event-time bucket the counts, rates and a quantile sketch of latency."""
    timed = event_time(traces).withColumn("_ms", monitoring.total_latency())
    out = timed.groupBy(F.window("ts", bucket).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("escalation_detected").cast("int")).alias("escalation_rate"),
        F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
        F.percentile_approx("_ms", [0.5, 0.95], 10_000).alias("q"))
    return replace_table(out.select(
        F.col("w.start").alias("bucket"), "n", "escalation_rate", "cache_hit_rate",
        F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms")), path)


def drift_check_stream(probes: DataFrame, path: str, every: str = "30 minutes"):
    """Windowed probe statistics on the stream, the report from each version of them."""
    return replace_table(drift.probe_stats(event_time(probes), every), path,
                         drift.checks_from_stats)


def rolling_probe_stream(traces: DataFrame, path: str, n: int, by: str = "domain",
                         key: str = "trace_id"):
    """Newest n rows per group over all batches.

    Each batch is cut to n rows per group before it meets the stored version, so state stays at
    n rows per group and no task receives a whole group.
    """
    columns = [by, "ts", key]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = drift.rolling_probe(batch.select(*columns), n, by, "ts", key)
        if batch_id > 0:
            fresh = fresh.unionByName(
                spark.read.parquet(f"{path}/data/version={batch_id - 1:012d}").select(*columns))
        out = drift.rolling_probe(fresh, n, by, "ts", key)
        out.write.mode("overwrite").parquet(f"{path}/data/version={batch_id:012d}")

    return (traces.writeStream.foreachBatch(merge)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def alert_stream(snapshots: DataFrame, rules: list | None = None) -> DataFrame:
    """Fired alerts of a snapshot stream; state per rule is (active, last fire time).

    Event time replaces wall-clock time, so a replay gives the same alerts.
    """
    evaluated = monitoring.evaluate_rules(snapshots, rules).select(
        "rule_name", "level", F.col("ts").cast("timestamp").alias("ts"), "breach", "cooldown_s",
        F.coalesce("message", F.lit("")).alias("message"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, last = state.get if state.exists else (False, 0.0)
        # one row per snapshot of this rule in this micro-batch
        pdf = pd.concat(list(batches)).sort_values("ts")
        seconds = (pdf["ts"] - pd.Timestamp(0)).dt.total_seconds()
        fired, active, last = fire_times(seconds, pdf["breach"], float(pdf["cooldown_s"].iloc[0]),
                                         active, last)
        state.update((bool(active), float(last)))
        hit = pdf[seconds.isin(fired) & pdf["breach"]]
        yield hit[["rule_name", "level", "ts", "message"]]

    return evaluated.groupBy("rule_name").applyInPandasWithState(
        step, "rule_name string, level string, ts timestamp, message string",
        "active boolean, last double", "append", GroupStateTimeout.NoTimeout)


def dispatch_alerts(alerts: DataFrame, path: str, *callbacks: Callable[[DataFrame, int], None]):
    """Append fired alerts as JSON lines and hand every batch to the callbacks."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/data/batch={batch_id:012d}")
        for call in callbacks:
            call(batch, batch_id)

    return (alerts.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def repeated_contact_stream(
    traces: DataFrame, min_contacts: int = 3, hours: int = 48, customer: str = "customer_id",
    key: str = "trace_id", slots: int = 64,
) -> DataFrame:
    """R18 on a stream: contacts of the customer in the trailing window.

    State is keyed by slot of customers and time bucket (a contact is copied into the next bucket):
    the calls do not grow with the customers, a slot holds its share of the contacts of two
    buckets, and it is dropped once the watermark has passed the bucket.
    """
    span = hours * 3600
    placed = event_time(traces).select(
        F.col(customer).cast("string").alias("customer"), F.pmod(F.xxhash64(customer), F.lit(slots)).cast("int").alias("slot"),
        F.col(key).cast("bigint").alias("id"), "ts", F.unix_micros("ts").alias("us"),
        F.floor(F.col("ts").cast("double") / span).cast("bigint").alias("own")
    ).withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))

    def step(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        customers, us = state.get if state.exists else ([], [])
        pdf = pd.concat(list(batches))
        own = (pdf["own"] == group[1]).to_numpy()
        customers = np.concatenate([np.array(customers, dtype=object), pdf["customer"].to_numpy(dtype=object)])
        us = np.concatenate([np.array(us, np.int64), pdf["us"].to_numpy(np.int64)])
        end = int((group[1] + 1) * span * 1000)
        state.update((customers.tolist(), us.tolist()))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs()) + 1)
        # customers one behind the other on one line, further apart than the span
        width = int(us.max() - us.min()) + span * 1_000_000 + 1
        line = pd.factorize(customers, use_na_sentinel=False)[0] * width + (us - us.min())
        ordered, at = np.sort(line), line[-len(pdf):][own]
        count = np.searchsorted(ordered, at, side="right") - np.searchsorted(ordered, at - span * 1_000_000, side="left")
        yield pd.DataFrame({key: pdf["id"].to_numpy()[own], "n_contacts": count.astype("int64"),
                            "repeated_contact": count >= min_contacts})

    return placed.select("customer", "slot", "bucket", "id", "ts", "us", "own").groupBy(
        "slot", "bucket").applyInPandasWithState(
        step, f"{key} bigint, n_contacts bigint, repeated_contact boolean",
        "customers array<string>, us array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
