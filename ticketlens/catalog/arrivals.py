"""Queries of the streams that carry state over several batches, some rows of which come late.

The table arrives in four parts by time; one row in twenty comes with the part after its own, and
one in thirty is delivered twice.  Every part is a run of the query that goes on from the
checkpoint of the run before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog import monitoring as mon
from ticketlens.catalog.base import query
from ticketlens.functions import lexicon as lx
from ticketlens.operators import monitoring as op
from ticketlens.plans.scale import new_path
from ticketlens.plans.views import table, view
from ticketlens.streaming import stateful, windows

PARTS = 4
COOLDOWN = 6 * 3600  # longer than the hour between two snapshots, so that it suppresses

_SLOW_RULES = [(*r[:5], COOLDOWN, *r[6:]) for r in lx.ALERT_RULES]

# ok: the rows on time, arrival by arrival; the watermark is that of the arrivals before
_ON_TIME = """
bounds as (select min(ts) as lo, max(ts) as hi, date_trunc('milliseconds', max(ts)) - interval 10 minutes as closed from traces_v),
ar as (select t.*, least(3, floor(4 * (epoch_us(ts) - epoch_us(lo))::double / (epoch_us(hi) - epoch_us(lo)))::int) as q from traces_v t, bounds),
mv as (select *, case when trace_id % 20 = 7 and q < 3 then q + 1 else q end as arrival from ar),
wm as (select arrival + 1 as arrival, date_trunc('milliseconds', max(max(ts)) over (order by arrival)) - interval 10 minutes as w from mv group by arrival),
ok as (select mv.* from mv left join wm on wm.arrival = mv.arrival where w is null or ts > w)"""


def _parts(spark, sf, twice=True):
    """Traces with the part that they arrive with."""
    rows = view(spark, sf, "traces_v")
    lo, hi = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    own = F.least(F.lit(PARTS - 1), F.floor(PARTS * (F.unix_micros(F.col("ts").cast("timestamp")) - lo).cast("double") / F.lit(hi - lo)).cast("int"))
    rows = rows.withColumn("_q", own).withColumn(
        "_part", F.when((F.col("trace_id") % 20 == 7) & (F.col("_q") < PARTS - 1), F.col("_q") + 1).otherwise(F.col("_q"))).drop("_q")
    return rows.unionByName(rows.where("trace_id % 30 = 11")) if twice else rows


def _run(spark, rows, start, read=windows.read_closed):
    """Let the parts of rows arrive one after another; start(stream, path) starts the query."""
    source, path = new_path(spark, "arrivals"), new_path(spark, "stream")
    schema = rows.drop("_part").schema
    for part in range(PARTS):
        rows.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(source)
        running = start(spark.readStream.schema(schema).parquet(source), path)
        running.awaitTermination()
        windows.log_progress(spark, running, path)
    return read(spark, path)


def _on_time(stream):
    return windows.first_deliveries(stream, "trace_id")


def _plain(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("w1_append_counters", f"""
with {_ON_TIME},
c as (select time_bucket(interval 1 hour, ts) as window_start, ok.* from ok),
x as (
select window_start, 'requests' as metric, domain as label_1, case when escalation_detected then 'escalated' else 'resolved' end as label_2,
  null::varchar as label_3, count(*)::double as value from c group by all
union all select window_start, 'routing', domain, routing_method, (routing_confidence >= 0.7)::varchar, count(*) from c group by all
union all select window_start, 'cache', cache_hit::varchar, null, null, count(*) from c group by all
union all select window_start, 'unsupported', domain, unsupported_flagged::varchar, null, count(*) from c group by all
union all select window_start, 'cost', domain, null, null, round(sum({mon._COST}), 6) from c group by all
union all select window_start, 'escalations', case when escalation_score > 0.5 then 'keyword' else 'model' end, null, null, count(*)
  from c where escalation_detected group by all)
select x.* from x, bounds where window_start + interval 1 hour <= closed""")
def w1_append(spark, sf):
    out = _run(spark, _parts(spark, sf), lambda s, p: windows.append_batches(windows.closed_counters(_on_time(s)), p))
    return mon._rounded(out.drop("window_end").withColumn("window_start", _plain("window_start")), "value")


@query("w4_append_rolling_resolution", f"""
with {_ON_TIME},
x as (select time_bucket(interval 5 minutes, ts) - to_minutes(5 * k) as window_start, domain, escalation_detected
  from ok, (select unnest(range(0, 12)) as k))
select window_start, domain, round(avg((not escalation_detected)::int), 6) as auto_resolution_rate, count(*) as n
from x, bounds where window_start + interval 1 hour <= closed group by window_start, domain""")
def w4_append(spark, sf):
    out = _run(spark, _parts(spark, sf), lambda s, p: windows.append_batches(windows.closed_resolution(_on_time(s)), p))
    return mon._rounded(out.drop("window_end").withColumn("window_start", _plain("window_start")), "auto_resolution_rate")


@query("w3_w5_append_series", f"""
with {_ON_TIME}, x as (select *, router_ms + lora_load_ms + generation_ms + safety_ms as ms from ok)
select time_bucket(interval 1 hour, ts) as window_start, count(*) as n, round(avg(escalation_detected::int), 6) as escalation_rate,
  round(avg(cache_hit::int), 6) as cache_hit_rate, round(quantile_disc(ms, 0.5), 6) as p50_ms, round(quantile_disc(ms, 0.95), 6) as p95_ms
from x, bounds where time_bucket(interval 1 hour, ts) + interval 1 hour <= closed group by window_start""")
def w5_append(spark, sf):
    out = _run(spark, _parts(spark, sf), lambda s, p: windows.append_batches(windows.closed_series(_on_time(s)), p))
    return mon._rounded(out.withColumn("window_start", _plain("window_start")), "escalation_rate", "cache_hit_rate", "p50_ms", "p95_ms")


@query("w5_late_rows", f"""
with {_ON_TIME} select (select count(*) + count(*) filter (where trace_id % 30 = 11) from mv) as input_rows,
  (select count(*) + count(*) filter (where trace_id % 30 = 11) from mv where trace_id not in (select trace_id from ok)) as late_rows""")
def w5_late(spark, sf):
    out = _run(spark, _parts(spark, sf), lambda s, p: windows.append_batches(windows.closed_series(_on_time(s)), p),
               windows.read_progress)
    return out.agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))


_ARRIVED_CHECK = mon._CHECK.replace("from traces_v t join sm s", "from ok t join sm s")


@query("d10_append_drift_check", f"""
with {_ON_TIME}, {_ARRIVED_CHECK} select window_start, n_domains, n_probes, round(min_mean_sim, 6) as min_mean_sim, drifted_domains,
  round(kl, 6) as kl_divergence, (drifted_domains <> '' or kl > 0.15) as drift_detected
from ck, bounds where window_start + interval 6 hours <= closed""")
def d10_append(spark, sf):
    sims = mon._pairs(spark, sf).select(F.col("vec_id").alias("ref"), "sim")
    n = table(spark, sf, "embeddings").count()

    def start(stream, path):
        probes = _on_time(stream).withColumn("ref", F.col("trace_id") % n).join(sims, "ref").select("ts", "domain", "sim")
        return windows.closed_drift_checks(probes, path, "6 hours")

    out = _run(spark, _parts(spark, sf), start)
    return mon._rounded(out.select(
        _plain("window_start"), "n_domains", "n_probes", "min_mean_sim", F.array_join("drifted_domains", ",").alias("drifted_domains"),
        "kl_divergence", "drift_detected"), "min_mean_sim", "kl_divergence")


# a session ends where the next contact is more than the gap away
_SESSIONS = """
g as (select *, case when ts - lag(ts) over (partition by customer_id order by ts) <= interval 2 hours then 0 else 1 end as new from {source}),
i as (select *, sum(new) over (partition by customer_id order by ts rows unbounded preceding) as island from g),
s as (select customer_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_contacts,
  count(*) filter (where escalation_detected) as n_escalated, count(*) >= 3 as repeated_contact from i group by customer_id, island)"""


def _session_columns(out):
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("r18_sessions", f"with {_SESSIONS.format(source='traces_v')} select * from s")
def r18_sessions(spark, sf):
    return _session_columns(windows.sessions(view(spark, sf, "traces_v")))


@query("r18_append_sessions", f"""
with {_ON_TIME}, {_SESSIONS.format(source='ok')} select s.* from s, bounds where last_ts + interval 2 hours <= closed""")
def r18_append_sessions(spark, sf):
    return _session_columns(_run(spark, _parts(spark, sf), lambda s, p: windows.append_batches(
        windows.session_stream(_on_time(s)), p)))


@query("r18_state_contacts", f"""
with {_ON_TIME}
select x.trace_id, count(*) as n_contacts, count(*) >= 3 as repeated_contact
from ok x join ok y on y.customer_id = x.customer_id and y.arrival <= x.arrival and y.ts between x.ts - interval 48 hours and x.ts
group by x.trace_id""")
def r18_state(spark, sf):
    return _run(spark, _parts(spark, sf, False), lambda s, p: stateful.start_append(stateful.trailing_contacts_stream(s), p))


@query("d9_state_newest", """
with r as (select trace_id, domain, ts, row_number() over (partition by domain order by ts desc, trace_id desc) as r from traces_v)
select trace_id, domain, ts from r where r <= 50""")
def d9_state(spark, sf):
    out = _run(spark, _parts(spark, sf), lambda s, p: stateful.newest_rows_stream(s, p, 50),
               lambda s, p: stateful.read_newest(s, p, 50))
    return out.withColumn("ts", _plain("ts"))


_FIRES = f"""
with recursive {mon._EVALUATED.strip()},
o as (select rule_name, level, ts, coalesce(breach, false) as breach, row_number() over (partition by rule_name order by ts) as rn from ev),
st as (
  select distinct rule_name, level, 0::bigint as rn, null::timestamp as ts, false as active, timestamp '1970-01-01' as last, null::varchar as event from o
  union all
  select o.rule_name, o.level, o.rn, o.ts, o.breach, case when o.breach and not (st.active and o.ts - st.last < interval {COOLDOWN} seconds) then o.ts else st.last end,
    case when o.breach and not (st.active and o.ts - st.last < interval {COOLDOWN} seconds) then 'fired' when st.active and not o.breach then 'resolved' end
  from st join o on o.rule_name = st.rule_name and o.rn = st.rn + 1)"""


@query("w8_alert_fires_cooldown", f"{_FIRES} select rule_name, ts from st where event = 'fired'")
def w8_cooldown(spark, sf):
    evaluated = op.evaluate_rules(view(spark, sf, "hourly_v"), _SLOW_RULES)
    return op.alert_fires(evaluated).select("rule_name", _plain("ts"))


@query("w8_state_alerts", f"{_FIRES} select rule_name, level, ts, event from st where event is not null")
def w8_state(spark, sf):
    rows = view(spark, sf, "hourly_v").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = rows.agg(F.min("ts").cast("bigint"), F.max("ts").cast("bigint")).first()
    part = F.least(F.lit(PARTS - 1), F.floor(PARTS * (F.col("ts").cast("bigint") - lo) / F.lit(max(1, hi - lo))).cast("int"))
    out = _run(spark, rows.withColumn("_part", part), lambda s, p: stateful.start_append(stateful.alert_events_stream(s, _SLOW_RULES), p))
    return out.select("rule_name", "level", _plain("ts"), "event")
