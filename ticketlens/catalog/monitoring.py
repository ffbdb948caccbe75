"""Queries of drift measurement and monitoring."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.catalog.evaluation import _COUNTS, _LAT
from ticketlens.catalog.vectors import _MEANS
from ticketlens.functions import lexicon as lx
from ticketlens.operators import abtest, drift, metrics, pareto
from ticketlens.operators import monitoring as op
from ticketlens.plans.views import table, view


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def _pairs(spark, sf):
    """Base vectors and current ones mixed with those of the next key."""
    raw = view(spark, sf, "current_vectors_v")
    mixed = raw.select(
        "vec_id",
        F.zip_with("base_v", "next_v", lambda a, b: a + (b - a) * F.col("mix")).alias("v"))
    return drift.paired_cosine(raw.select("vec_id", "domain", F.col("base_v").alias("v")), mixed,
                               "vec_id")


_SIM = """
cv as (select vec_id, domain, base_v, list_transform(range(1, 65), lambda i: base_v[i] + (next_v[i] - base_v[i]) * mix) as cur from current_vectors_v),
sm as (select vec_id, domain, list_cosine_similarity(base_v, cur) as sim from cv)"""
_STATS = """avg(sim) as mean_sim, stddev_pop(sim) as std_sim, min(sim) as min_sim, max(sim) as max_sim, count(*) as n"""


@query("d1_embedding_drift", f"""
with {_SIM}, st as (select domain, {_STATS} from sm group by domain)
select domain, round(mean_sim, 6) as mean_sim, round(std_sim, 6) as std_sim, round(min_sim, 6) as min_sim, round(max_sim, 6) as max_sim,
  n, round(1 - mean_sim, 6) as distance, mean_sim < 0.94 as drifted from st""")
def d1(spark, sf):
    return _rounded(drift.drift_stats(_pairs(spark, sf)), "mean_sim", "std_sim", "min_sim",
                    "max_sim", "distance")


@query("d2_fast_drift", f"""
with {_SIM} select round(avg(sim), 6) as mean_sim, avg(sim) < 0.94 as drifted from sm""")
def d2(spark, sf):
    return _rounded(drift.drift_stats(_pairs(spark, sf), by=()).select("mean_sim", "drifted"),
                    "mean_sim")


def _steps(spark, sf):
    return _pairs(spark, sf).withColumn("step", F.col("vec_id") % 6)


_HIST = f"""{_SIM},
hs as (select domain, vec_id % 6 as step, 1 - avg(sim) as distance, count(*) as n from sm group by all)"""


@query("d3_d4_drift_history", f"""
with {_HIST} select domain, step, round(distance, 6) as distance, n, distance > 0.10 as is_drifting,
  case when distance > 0.20 then 'severe' when distance > 0.10 then 'drifting' else 'stable' end as level,
  step = max(step) over (partition by domain) as is_latest from hs""")
def d4(spark, sf):
    return _rounded(drift.drift_history(_steps(spark, sf)).select(
        "domain", "step", "distance", "n", "is_drifting", "level", "is_latest"), "distance")


@query("d5_drift_trend", f"""
with {_HIST}, i as (select *, row_number() over (partition by domain order by step) as i from hs)
select domain, round(case when count(*) >= 2 then regr_slope(distance, i) end, 6) as slope, count(*) as n_points from i group by domain""")
def d5(spark, sf):
    return _rounded(drift.drift_trend(drift.drift_history(_steps(spark, sf))), "slope")


@query("d6_contamination", f"""
with {_MEANS} select a.domain as domain_a, b.domain as domain_b,
  round(greatest(0, list_cosine_similarity(a.proto, b.proto)), 6) as similarity from protos a join protos b on a.domain < b.domain""")
def d6(spark, sf):
    return _rounded(drift.contamination(view(spark, sf, "vectors_v")), "similarity")


_SHARES = r"""
tb as (select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[^\s\x0B\x1C-\x1F\x85\p{Z}]+')) as token from documents where lang = 'en') group by token),
tc as (select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[^\s\x0B\x1C-\x1F\x85\p{Z}]+')) as token from documents where lang <> 'en') group by token),
sh as (select coalesce(tb.token, tc.token) as token, coalesce(tb.n, 0) / (select sum(n) from tb)::double as b,
  coalesce(tc.n, 0) / (select sum(n) from tc)::double as c from tb full join tc on tb.token = tc.token)"""


def _corpora(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    return docs.where("lang = 'en'"), docs.where("lang <> 'en'")


@query("d7_vocabulary_shift", f"""
with {_SHARES} select round(sum(c * ln((c + 1e-9) / (b + 1e-9))), 6) as kl_divergence,
  round(max(abs(c - b)), 6) as max_shift, count(*) as n_tokens from sh""")
def d7(spark, sf):
    return _rounded(drift.vocabulary_shift(*_corpora(spark, sf))[0], "kl_divergence", "max_shift")


@query("d7_top_shifted_tokens", f"""
with {_SHARES} select token, round(b, 6) as base_share, round(c, 6) as current_share, round(abs(c - b), 6) as shift
from sh order by round(abs(c - b), 12) desc, token limit 20""")
def d7_top(spark, sf):
    return _rounded(drift.vocabulary_shift(*_corpora(spark, sf))[1], "base_share",
                    "current_share", "shift")


_MIX = ", ".join(f"('{d}', {p}::double)" for d, p in lx.TRAINING_MIX.items())


@query("d8_distribution_shift", f"""
with p as (select * from (values {_MIX}) t(domain, p)), n as (select domain, count(*) as n from traces_v group by domain),
u as (select greatest(coalesce(p, 1e-9), 1e-9) as p, greatest(coalesce(n.n / (select sum(n) from n)::double, 1e-9), 1e-9) as q
  from p full join n on n.domain = p.domain)
select round(sum(p * ln(p / q)), 6) as kl_divergence, sum(p * ln(p / q)) > 0.15 as distribution_shift from u""")
def d8(spark, sf):
    return _rounded(drift.distribution_shift(view(spark, sf, "traces_v")), "kl_divergence")


@query("d9_rolling_probe", """
with r as (select trace_id, domain, row_number() over (partition by domain order by ts desc, trace_id desc) as r from traces_v)
select trace_id, domain from r where r <= 50""")
def d9(spark, sf):
    return drift.rolling_probe(view(spark, sf, "traces_v"), 50).select("trace_id", "domain")


def _probes(spark, sf):
    """Every trace as a probe whose similarity is that of the vector its key points at."""
    sims = _pairs(spark, sf).select(F.col("vec_id").alias("ref"), "sim")
    n = sims.agg(F.count(F.lit(1)).alias("n_vec")).withColumn("_one", F.lit(1))
    traces = view(spark, sf, "traces_v").select("trace_id", "ts", "domain").withColumn(
        "_one", F.lit(1)).join(F.broadcast(n), "_one").withColumn(
        "ref", F.col("trace_id") % F.col("n_vec"))
    return traces.join(sims, "ref").select("ts", "domain", "sim")


_CHECK = f"""{_SIM},
pb as (select time_bucket(interval 6 hours, t.ts) as w, t.domain, s.sim from traces_v t join sm s on s.vec_id = t.trace_id % (select count(*) from sm)),
pd as (select w, domain, avg(sim) as m, count(*) as n from pb group by w, domain),
qd as (select *, greatest(n / sum(n) over (partition by w)::double, 1e-9) as q from pd),
mx as (select * from (values {_MIX}) t(domain, p)),
grid as (select w.w, mx.domain, mx.p from (select distinct w from pd) w, mx
  union all select w, domain, 1e-9 from qd where domain not in (select domain from mx)),
kl as (select g.w, sum(g.p * ln(g.p / coalesce(q.q, 1e-9))) as kl from grid g left join qd q on q.w = g.w and q.domain = g.domain group by g.w),
ck as (select pd.w as window_start, count(*) as n_domains, sum(n)::bigint as n_probes, min(m) as min_mean_sim,
  coalesce(string_agg(domain, ',' order by domain) filter (where m < 0.94), '') as drifted_domains, any_value(kl.kl) as kl
  from pd join kl on kl.w = pd.w group by pd.w)"""


@query("d10_drift_check", f"""
with {_CHECK} select window_start, n_domains, n_probes, round(min_mean_sim, 6) as min_mean_sim, drifted_domains, round(kl, 6) as kl_divergence,
  kl > 0.15 as distribution_shift, (drifted_domains <> '' or kl > 0.15) as drift_detected from ck""")
def d10(spark, sf):
    out = drift.drift_check(_probes(spark, sf), "6 hours").withColumn(
        "drifted_domains", F.array_join("drifted_domains", ","))
    return _rounded(out.drop("alert_fired").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")), "min_mean_sim",
        "kl_divergence")


@query("d11_drift_report", f"""
with {_CHECK} select count(*) as n_checks, count(*) filter (where drifted_domains <> '' or kl > 0.15) as total_drifts,
  max(n_domains) as max_domains, bool_and(not (drifted_domains <> '' or kl > 0.15)) as all_pass from ck""")
def d11(spark, sf):
    return drift.drift_report(drift.drift_check(_probes(spark, sf), "6 hours"))


_COST = "case domain when 'technical' then 0.05 when 'billing' then 0.12 when 'returns' then 0.09 when 'escalation' then 0.15 else 0.10 end::double"


@query("w1_trace_counters", f"""
select 'requests' as metric, domain as label_1, case when escalation_detected then 'escalated' else 'resolved' end as label_2,
  null::varchar as label_3, count(*)::double as value from traces_v group by all
union all select 'routing', domain, routing_method, (routing_confidence >= 0.7)::varchar, count(*) from traces_v group by all
union all select 'cache', cache_hit::varchar, null, null, count(*) from traces_v group by all
union all select 'unsupported', domain, unsupported_flagged::varchar, null, count(*) from traces_v group by all
union all select 'cost', domain, null, null, round(sum({_COST}), 6) from traces_v group by all
union all select 'escalations', case when escalation_score > 0.5 then 'keyword' else 'model' end, null, null, count(*)
  from traces_v where escalation_detected group by all""")
def w1(spark, sf):
    return _rounded(op.trace_counters(view(spark, sf, "traces_v")), "value")


_STAGES = """
sg as (select domain, unnest(['router', 'lora_load', 'generation', 'safety', 'total']) as stage,
  unnest([router_ms, lora_load_ms, generation_ms, safety_ms, router_ms + lora_load_ms + generation_ms + safety_ms]) / 1000 as s from traces_v)"""
_LE = ", ".join(f"count(*) filter (where s <= {b}) as le_{str(b).replace('.', '_')}"
                for b in lx.LATENCY_BUCKETS_S)


@query("w2_latency_histogram", f"""
with {_STAGES} select domain, stage, {_LE}, count(*) as n, round(sum(s), 6) as sum_s from sg group by domain, stage""")
def w2(spark, sf):
    return _rounded(op.latency_histogram(view(spark, sf, "traces_v")), "sum_s")


_SNAP = """
ms as (select *, router_ms + lora_load_ms + generation_ms + safety_ms as ms from traces_v),
sn as (select count(*) as requests_total, count(*) filter (where escalation_detected) as escalations_total,
  round(avg(cache_hit::int), 3) as cache_hit_rate, count(*) filter (where unsupported_flagged) as unsupported_flagged,
  round(quantile_cont(ms, 0.5), 6) as latency_p50_ms, round(quantile_cont(ms, 0.95), 6) as latency_p95_ms from ms)"""


@query("w3_metrics_snapshot", f"with {_SNAP} select * from sn")
def w3(spark, sf):
    return _rounded(op.metrics_snapshot(view(spark, sf, "traces_v")), "latency_p50_ms",
                    "latency_p95_ms")


@query("w4_rolling_resolution", """
with x as (select time_bucket(interval 5 minutes, ts) - to_minutes(5 * k) as window_start, domain, escalation_detected
  from traces_v, (select unnest(range(0, 12)) as k))
select window_start, domain, round(avg((not escalation_detected)::int), 6) as auto_resolution_rate, count(*) as n
from x group by window_start, domain""")
def w4(spark, sf):
    out = op.rolling_resolution(view(spark, sf, "traces_v"))
    return _rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")),
                    "auto_resolution_rate")


@query("w5_sparklines", """
with x as (select time_bucket(interval 1 day, ts) as bucket, escalation_detected, router_ms + lora_load_ms + generation_ms + safety_ms as ms from traces_v)
select bucket, round(avg((not escalation_detected)::int), 6) as auto_resolution_rate, round(avg(escalation_detected::int), 6) as escalation_rate,
  round(quantile_cont(ms, 0.95), 6) as p95_ms from x group by bucket order by bucket desc limit 24""")
def w5(spark, sf):
    out = op.sparklines(view(spark, sf, "traces_v"))
    return _rounded(out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")),
                    "auto_resolution_rate", "escalation_rate", "p95_ms")


_RULES = ", ".join(f"('{n}', '{l}', '{m}', '{c}', {t}::double)" for n, l, m, c, t, *_ in
                   lx.ALERT_RULES)
_EVALUATED = f"""
ru as (select * from (values {_RULES}) t(rule_name, level, metric, cmp, threshold)),
lo as (select ts, unnest(['auto_resolution_rate', 'p95_ms', 'unsupported_rate', 'cache_hit_rate',
    'false_negative_rate', 'drift_detected', 'kl_divergence']) as metric,
  unnest([auto_resolution_rate, p95_ms, unsupported_rate, cache_hit_rate,
    false_negative_rate, drift_detected, kl_divergence])::double as value,
  'Semantic drift detected: domains=' || drifted_domains || ' kl=' || printf('%.4f', kl_divergence::double) as drift_message from hourly_v),
ev as (select lo.ts, rule_name, level, value, drift_message, case when cmp = '<' then value < threshold else value > threshold end as breach
  from lo join ru on ru.metric = lo.metric)"""


def _evaluated(spark, sf):
    return op.evaluate_rules(view(spark, sf, "hourly_v"))


@query("w7_evaluate_rules", f"""with {_EVALUATED} select ts, rule_name, level, breach,
  case when breach and rule_name = 'semantic_drift_warn' then drift_message end as drift_message from ev""")
def w7(spark, sf):
    return _evaluated(spark, sf).select(F.col("ts").cast("timestamp_ntz").alias("ts"),
                                        "rule_name", "level", "breach",
                                        F.when(F.col("rule_name") == "semantic_drift_warn", F.col("message"))
                                        .alias("drift_message"))


@query("w8_alert_episodes", f"""
with {_EVALUATED},
b as (select *, coalesce(lag(breach) over (partition by rule_name order by ts), false) as before from ev),
c as (select *, lead(ts) over (partition by rule_name order by ts) as resolved_at from b where breach <> before)
select rule_name, level, ts as fired_at, resolved_at from c where breach""")
def w8(spark, sf):
    out = op.alert_episodes(_evaluated(spark, sf))
    return out.select("rule_name", "level", F.col("fired_at").cast("timestamp_ntz")
                      .alias("fired_at"), F.col("resolved_at").cast("timestamp_ntz")
                      .alias("resolved_at"))


# the evaluations are an hour apart and every cooldown is shorter, so each breach fires
@query("w8_alert_fires", f"with {_EVALUATED} select rule_name, ts from ev where breach")
def w8_fires(spark, sf):
    return op.alert_fires(_evaluated(spark, sf)).select(
        "rule_name", F.col("ts").cast("timestamp_ntz").alias("ts"))


_ACTIVE = f"""{_EVALUATED}, la as (select rule_name, level, arg_max(breach, ts) as active from ev group by rule_name, level)"""


@query("w9_active_alerts", f"with {_ACTIVE} select level, count(*) as n_active from la where active group by level")
def w9(spark, sf):
    return op.active_alerts(_evaluated(spark, sf))


@query("w6_dashboard_snapshot", f"""
with {_SNAP}, {_COUNTS}, {_LAT}, {_ACTIVE}
select requests_total, latency_p95_ms, round(m.arr, 6) as auto_resolution_rate, round(lat.p95, 6) as eval_p95_ms,
  (select count(*) from la where active) as n_alerts from sn, m, lat where m.domain is null""")
def w6(spark, sf):
    graded = view(spark, sf, "graded_v").withColumnRenamed("treatment_pred", "pred")
    points = pareto.pareto_frontier(view(spark, sf, "points_v")).agg(
        F.count_if("is_pareto_optimal").alias("n_frontier"))
    snap = op.dashboard_snapshot(
        op.metrics_snapshot(view(spark, sf, "traces_v")), metrics.evaluate(graded),
        drift.drift_stats(_pairs(spark, sf), by=()), points,
        abtest.ab_test(view(spark, sf, "graded_v")), op.active_alerts(_evaluated(spark, sf)))
    return snap.select(
        "metrics.requests_total", F.round("metrics.latency_p95_ms", 6).alias("latency_p95_ms"),
        F.round("evaluation.auto_resolution_rate", 6).alias("auto_resolution_rate"),
        F.round("evaluation.p95_ms", 6).alias("eval_p95_ms"), "n_alerts")


@query("w11_domain_shares", """
select domain, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from traces_v group by domain""")
def w11(spark, sf):
    return _rounded(op.domain_shares(view(spark, sf, "traces_v")), "share")


@query("w11_kpi_status", f"""
with {_COUNTS}, {_LAT} select case when arr >= 0.94 then 'good' when arr >= 0.9 then 'warn' else 'critical' end as resolution_status,
  case when fnr <= 0.005 then 'good' else 'critical' end as fnr_status, case when p95 < 200 then 'good' else 'critical' end as latency_status
from m, lat where m.domain is null""")
def w11_kpi(spark, sf):
    graded = view(spark, sf, "graded_v").withColumnRenamed("treatment_pred", "pred")
    return op.kpi_status(metrics.evaluate(graded)).select("resolution_status", "fnr_status",
                                                          "latency_status")


@query("w3_domain_distribution", f"""
with {_SNAP} select requests_total, latency_p95_ms, domain, n from sn, (select domain, count(*) as n from traces_v group by domain)""")
def w3_domains(spark, sf):
    out = op.snapshot_record(view(spark, sf, "traces_v"))
    return _rounded(out.select("requests_total", "latency_p95_ms", F.explode("domain_distribution").alias("domain", "n")), "latency_p95_ms")


_LINES = f"""{_CHECK},
x as (select time_bucket(interval 1 day, ts) as bucket, escalation_detected, router_ms + lora_load_ms + generation_ms + safety_ms as ms from traces_v),
sl as (select bucket, avg((not escalation_detected)::int) as arr, quantile_cont(ms, 0.95) as p95 from x group by bucket order by bucket desc limit 24),
dd as (select time_bucket(interval 1 day, window_start) as bucket, max(1 - min_mean_sim) as drift_delta from ck group by bucket)"""


@query("w5_sparklines_drift", f"""
with {_LINES} select sl.bucket, round(arr, 6) as auto_resolution_rate, round(p95, 6) as p95_ms, round(drift_delta, 6) as drift_delta
from sl left join dd on dd.bucket = sl.bucket""")
def w5_drift(spark, sf):
    out = op.sparklines_with_drift(view(spark, sf, "traces_v"), drift.drift_check(_probes(spark, sf), "6 hours"))
    return _rounded(out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "auto_resolution_rate", "p95_ms", "drift_delta"),
                    "auto_resolution_rate", "p95_ms", "drift_delta")


@query("w6_dashboard_record", f"""
with {_SNAP}, {_LINES}
select requests_total, (select count(distinct domain) from checkpoints_v) as n_domains,
  (select string_agg(distinct domain, ',' order by domain) from checkpoints_v) as domains,
  (select count(*) from sl) as n_points, (select round(sum(arr), 6) from sl) as arr_sum,
  (select round(arg_max(drift_delta, sl.bucket), 6) from sl left join dd on dd.bucket = sl.bucket) as last_drift from sn""")
def w6_record(spark, sf):
    traces, checks = view(spark, sf, "traces_v"), drift.drift_check(_probes(spark, sf), "6 hours")
    record = op.dashboard_record(op.snapshot_record(traces), view(spark, sf, "checkpoints_v"), op.sparklines_with_drift(traces, checks))
    return record.select(
        "requests_total", "checkpoints.n_domains", F.array_join("checkpoints.domains", ",").alias("domains"),
        F.col("sparklines.n_points").cast("bigint").alias("n_points"),
        F.round(F.aggregate("sparklines.auto_resolution_rate", F.lit(0.0), lambda a, x: a + x), 6).alias("arr_sum"),
        F.round(F.element_at("sparklines.drift_delta", -1), 6).alias("last_drift"))


@query("d11_drift_record", f"""
with {_CHECK}, h as (select * from ck order by window_start desc limit 10)
select (select count(*) from ck) as n_checks, (select count(*) from ck where drifted_domains <> '' or kl > 0.15) as total_drifts,
  (select string_agg(distinct domain, ',' order by domain) from traces_v) as domains,
  window_start, round(min_mean_sim, 6) as min_mean_sim, (drifted_domains <> '' or kl > 0.15) as drift_detected from h""")
def d11_record(spark, sf):
    probes = _probes(spark, sf)
    record = drift.drift_record(drift.drift_check(probes, "6 hours"), probes, last=10)
    return _rounded(record.select("n_checks", "total_drifts", F.array_join("domains", ",").alias("domains"), F.inline("history")).select(
        "n_checks", "total_drifts", "domains", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "min_mean_sim",
        "drift_detected"), "min_mean_sim")
