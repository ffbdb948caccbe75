"""Stateful operators by transformWithState: list, map and value state with timers on RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ticketlens.operators import monitoring
from ticketlens.operators.drift import rolling_probe
from ticketlens.streaming.monitors import event_time
from ticketlens.streaming.windows import ONCE, append_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600
CONTACT_SLOTS = 64  # parts of the customers whose contacts are kept together
SLOTS = 16  # parts of a group whose newest rows are kept apart


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class NewestRows(StatefulProcessor):
    """The newest n rows of a key as list state; gives back the list whenever it changed."""

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us bigint, id bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        best = held
        for part in rows:
            best = sorted({*best, *zip(part["us"].tolist(), part["id"].tolist())}, reverse=True)[:self.n]
        if best == held:
            return
        self.rows.put(best)
        yield pd.DataFrame({"by": [key[0]] * len(best), "slot": key[1], "us": [b[0] for b in best], "id": [b[1] for b in best]})

    def close(self) -> None:
        pass


def newest_rows_stream(traces: DataFrame, path: str, n: int, by: str = "domain", key: str = "trace_id",
                       ttl_seconds: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """D9 on a stream: path/data holds the newest n rows of every group and slot, each replaced when it changes.

    A group is dealt into SLOTS by the key, so a busy group is several states; state and table
    hold n rows per group and slot at most.  With a time to live, groups that get no rows for
    that long lose their state (the table keeps their last rows).
    """
    spark = traces.sparkSession
    rows = traces.select(
        F.col(by).alias("by"), F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col(key).cast("bigint").alias("id"))
    newest = rows.groupBy("by", "slot").transformWithStateInPandas(
        NewestRows(n, ttl_seconds and ttl_seconds * 1000), "by string, slot int, us bigint, id bigint", "Update",
        "ProcessingTime" if ttl_seconds else "None")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("by", "slot").parquet(f"{path}/data")

    with rocksdb(spark):
        return (newest.writeStream.outputMode("update").foreachBatch(replace)
                .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or ONCE)).start())


def read_newest(spark: SparkSession, path: str, n: int, by: str = "domain", key: str = "trace_id") -> DataFrame:
    """(by, ts, key) of the newest n rows of every group, from what newest_rows_stream keeps."""
    rows = spark.read.schema("us bigint, id bigint, by string, slot int").parquet(f"{path}/data").select(
        F.col("by").alias(by), F.timestamp_micros("us").alias("ts"), F.col("id").alias(key))
    return rolling_probe(rows, n, by, "ts", key)


class TrailingContacts(StatefulProcessor):
    """The contact times of a slot of customers by spell of time, as map state; a timer drops each spell.

    A call counts the contacts of all customers of its slot at once.  Only the spells that new
    contacts fall into are written; those in reach are read once a batch.
    """

    def __init__(self, min_contacts: int, span: int):
        self.min_contacts, self.span = min_contacts, span
        self.spell = max(HOUR, span // 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getMapState("spells", "spell bigint", "customers array<string>, us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        us, customers = new["us"].to_numpy(np.int64), new["customer"].to_numpy(dtype=object)
        spells = us // (self.spell * 1_000_000)
        reach = self.span // self.spell + 1
        held = {spell: (np.array(c, dtype=object), np.array(t, np.int64)) for (spell,), (c, t) in self.spells.iterator()
                if spells.min() - reach <= spell <= spells.max()}
        for spell in np.unique(spells).tolist():
            if spell not in held:
                self.handle.registerTimer((spell + 1) * self.spell * 1000 + self.span * 1000)
                held[spell] = (np.array([], dtype=object), np.array([], np.int64))
            own = spells == spell
            held[spell] = tuple(np.concatenate([old, x[own]]) for old, x in zip(held[spell], (customers, us)))
            self.spells.updateValue((spell,), tuple(x.tolist() for x in held[spell]))
        count = trailing_counts(*[np.concatenate(x) for x in zip(*held.values())], customers, us, self.span * 1_000_000)
        yield pd.DataFrame({"id": new["id"].to_numpy(), "n_contacts": count, "repeated_contact": count >= self.min_contacts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spell = (expiredTimerInfo.getExpiryTimeInMs() - self.span * 1000) // (self.spell * 1000) - 1
        self.spells.removeKey((spell,))
        return iter([])

    def close(self) -> None:
        pass


def trailing_counts(customers: np.ndarray, us: np.ndarray, who: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """How many of the contacts (customers, us) each customer of who had in the span up to its time at."""
    names = pd.factorize(np.concatenate([customers, who]), use_na_sentinel=False)[0].astype(np.int64)
    # customers one behind the other on one line of the ranks of the times
    times, rank = np.unique(us, return_inverse=True)
    width = len(times) + 1
    line = np.sort(names[:len(us)] * width + rank)
    mine = names[len(us):] * width
    first, last = np.searchsorted(times, at - span, side="left"), np.searchsorted(times, at, side="right")
    return (np.searchsorted(line, mine + last, side="left") - np.searchsorted(line, mine + first, side="left")).astype("int64")


def trailing_contacts_stream(traces: DataFrame, min_contacts: int = 3, hours: int = 48, customer: str = "customer_id",
                             key: str = "trace_id", slots: int = CONTACT_SLOTS) -> DataFrame:
    """R18 on a stream: every contact on time with the customer's contacts in the trailing window seen so far.

    Start it with start_append.  State is keyed by slot of customers, so the calls and timers do not
    grow with the customers; it holds the contact times in reach of the watermark.
    """
    rows = event_time(traces).select(
        "ts", F.pmod(F.xxhash64(customer), F.lit(slots)).cast("int").alias("slot"),
        F.col(customer).cast("string").alias("customer"), F.unix_micros("ts").alias("us"),
        F.col(key).cast("bigint").alias("id"))
    out = rows.groupBy("slot").transformWithStateInPandas(
        TrailingContacts(min_contacts, hours * HOUR), "id bigint, n_contacts bigint, repeated_contact boolean",
        "Append", "EventTime")
    return out.select(F.col("id").alias(key), "n_contacts", "repeated_contact")


class AlertState(StatefulProcessor):
    """Whether a rule is active and when it fired last, as value state; fires and resolutions come out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "active boolean, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, last = self.state.get() if self.state.exists() else (False, 0.0)
        pdf = pd.concat(list(rows)).sort_values("ts")
        seconds = (pdf["ts"] - pd.Timestamp(0)).dt.total_seconds()
        events = []
        for at, breach, cooldown in zip(seconds, pdf["breach"], pdf["cooldown_s"]):
            fired, now, last = monitoring.fire_times([at], [breach], float(cooldown), active, last)
            events.append("fired" if fired else "resolved" if active and not now else None)
            active = now
        self.state.update((bool(active), float(last)))
        out = pdf.assign(event=events)
        yield out.loc[out["event"].notna(), ["rule_name", "level", "ts", "event", "message"]]

    def close(self) -> None:
        pass


def alert_events_stream(snapshots: DataFrame, rules: list | None = None) -> DataFrame:
    """W8 on a stream of snapshots in time order: (rule_name, level, ts, event, message).

    A breach fires unless the rule is active and within its cooldown; the first snapshot without a
    breach resolves it.  Event time replaces the clock, so a replay gives the same events.  State
    is two values per rule, however long a breach lasts.  Start it with start_append.
    """
    evaluated = monitoring.evaluate_rules(snapshots, rules).select(
        "rule_name", "level", F.col("ts").cast("timestamp").alias("ts"), "breach", "cooldown_s",
        F.coalesce("message", F.lit("")).alias("message"))
    return evaluated.groupBy("rule_name").transformWithStateInPandas(
        AlertState(), "rule_name string, level string, ts timestamp, event string, message string", "Append", "None")


def start_append(df: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Start an append-mode query of these operators; parquet below path/data, one folder per batch."""
    with rocksdb(df.sparkSession):
        return append_batches(df, path, None, trigger)
