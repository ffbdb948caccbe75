"""Streams over several batches: state that shrinks, late rows, bounded state of busy keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import monitoring
from ticketlens.streaming import stateful, windows

DAY = dt.datetime(2024, 3, 1)


class Feed:
    """A folder that rows arrive in, and one query started anew for every arrival."""

    def __init__(self, spark, tmp_path, schema, start):
        self.spark, self.schema, self.start = spark, schema, start
        self.source, self.path = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        query = self.start(self.spark.readStream.schema(self.schema).parquet(self.source), self.path)
        query.awaitTermination()
        windows.log_progress(self.spark, query, self.path)
        return query.recentProgress


def _at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def test_closed_windows_leave_the_state_and_late_rows_are_counted(spark, tmp_path):
    def start(stream, path):
        rows = windows.first_deliveries(stream, "id")
        return windows.append_batches(windows.closed_windows(rows, "10 minutes", [F.count(F.lit(1)).alias("n")], ("k",)), path)

    feed = Feed(spark, tmp_path, "id bigint, k string, ts timestamp", start)
    feed.arrive([(i, "a" if i % 2 else "b", _at(i)) for i in range(60)])
    assert windows.read_closed(spark, feed.path).count() == 8  # four windows end before 59 - 10 minutes
    # out of order but on time, a second delivery, and two rows behind the watermark
    feed.arrive([(100, "a", _at(52)), (59, "a", _at(59)), (101, "a", _at(3)), (102, "b", _at(40))])
    last = feed.arrive([(103, "b", _at(500))])
    closed = {(r["window_start"], r["k"]): r["n"] for r in windows.read_closed(spark, feed.path).collect()}
    assert closed[(_at(0), "a")] == 5 and closed[(_at(50), "a")] == 6 and closed[(_at(40), "b")] == 5
    assert (_at(500), "b") not in closed and len(closed) == 12
    progress = windows.read_progress(spark, feed.path)
    assert progress.agg(F.sum("late_rows")).first()[0] == 2
    states = [s["numRowsTotal"] for s in last[-1]["stateOperators"]]
    assert max(states) == 1  # one open window, one remembered key


def test_sessions_on_a_stream_agree_with_the_table(spark, tmp_path):
    schema = "trace_id bigint, customer_id bigint, ts timestamp, escalation_detected boolean"
    rows = [(0, 1, _at(0), True), (1, 1, _at(120), False),  # exactly the gap: one session
            (2, 1, _at(241), False), (3, 2, _at(1430), False), (4, 2, _at(1450), True),  # across midnight
            (5, None, _at(5), False), (6, 3, _at(2500), False), (7, 1, _at(0), True)]
    table = windows.sessions(spark.createDataFrame(rows, schema)).collect()
    found = {(r["customer_id"], r["first_ts"]): (r["n_contacts"], r["n_escalated"], r["repeated_contact"]) for r in table}
    assert found == {(1, _at(0)): (3, 2, True), (1, _at(241)): (1, 0, False), (2, _at(1430)): (2, 1, False),
                     (None, _at(5)): (1, 0, False), (3, _at(2500)): (1, 0, False)}
    feed = Feed(spark, tmp_path, schema, lambda s, p: windows.append_batches(
        windows.session_stream(windows.event_time(s)), p))
    feed.arrive([rows[0], rows[7], rows[5]])
    feed.arrive([rows[1]])
    feed.arrive([rows[2], rows[3]])
    feed.arrive([rows[4], rows[6]])
    stream = {tuple(r) for r in windows.read_closed(spark, feed.path).collect()}
    assert stream == {tuple(r) for r in table if r["customer_id"] != 3}  # the last one is still open
    none = windows.sessions(spark.createDataFrame([], schema))
    assert none.count() == 0


def test_busy_customer_keeps_bounded_state(spark, tmp_path):
    schema = "trace_id bigint, customer_id bigint, ts timestamp"
    feed = Feed(spark, tmp_path, schema, lambda s, p: stateful.start_append(
        stateful.trailing_contacts_stream(s, hours=2), p))
    per = 5_000
    states = []
    for part in range(4):  # three hours of one customer in every part
        rows = [(part * per + i, 1, _at(180 * part + 180 * i / per)) for i in range(per)]
        progress = feed.arrive(rows + [(10**6 + part, 2, _at(180 * part))])
        states.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    out = {r["trace_id"]: r for r in spark.read.parquet(f"{feed.path}/data").collect()}
    assert len(out) == 4 * per + 4
    # contacts in two hours: the share of the three hours that a part covers
    assert out[per + per // 2]["n_contacts"] == pytest.approx(per * 2 / 3, abs=2)
    assert out[0]["n_contacts"] == 1 and not out[0]["repeated_contact"] and out[per]["repeated_contact"]
    assert out[10**6 + 1]["n_contacts"] == 1
    assert max(states[1:]) <= states[1] + 4  # hours and timers, not contacts


def test_alert_state_does_not_grow_with_a_breach(spark, tmp_path):
    rules = [("low", "warn", "rate", "<", 0.5, 3600, "rate %.1f", 1.0)]
    feed = Feed(spark, tmp_path, "ts timestamp, rate double",
                lambda s, p: stateful.start_append(stateful.alert_events_stream(s, rules), p))
    feed.arrive([(_at(0), 0.9), (_at(10), 0.1), (_at(20), 0.2)])
    feed.arrive([(_at(30), 0.2), (_at(69), 0.2), (_at(70), 0.2)])
    progress = feed.arrive([(_at(80), 0.9), (_at(81), 0.1)])
    events = [(r["ts"], r["event"]) for r in spark.read.parquet(f"{feed.path}/data").orderBy("ts").collect()]
    assert events == [(_at(10), "fired"), (_at(70), "fired"), (_at(80), "resolved"), (_at(81), "fired")]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    snapshots = spark.createDataFrame(
        [(_at(m), r) for m, r in ((0, 0.9), (10, 0.1), (20, 0.2), (30, 0.2), (69, 0.2), (70, 0.2), (80, 0.9), (81, 0.1))],
        "ts timestamp, rate double")
    batch = monitoring.alert_fires(monitoring.evaluate_rules(snapshots, rules)).orderBy("ts").collect()
    assert [r["ts"] for r in batch] == [t for t, e in events if e == "fired"]


def test_newest_rows_replace_each_other(spark, tmp_path):
    feed = Feed(spark, tmp_path, "trace_id bigint, domain string, ts timestamp",
                lambda s, p: stateful.newest_rows_stream(s, p, 3))
    feed.arrive([(i, "a", _at(i)) for i in range(100)] + [(500, None, _at(1))])
    feed.arrive([(200, "a", _at(200)), (201, "a", _at(-5)), (202, "b", _at(0))])
    feed.arrive([(203, "a", _at(99))])
    kept = {(r["domain"], r["trace_id"]) for r in stateful.read_newest(spark, feed.path, 3).collect()}
    assert kept == {("a", 200), ("a", 203), ("a", 99), ("b", 202), (None, 500)}
    assert spark.read.parquet(f"{feed.path}/data").count() <= 3 * stateful.SLOTS * 3
