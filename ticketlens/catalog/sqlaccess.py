"""Queries of the SQL access: scalar functions, table functions and rules as predicates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ticketlens.catalog import monitoring as mon
from ticketlens.catalog.base import query
from ticketlens.catalog.models import _PREF
from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqlfuncs, udtfs
from ticketlens.functions import sqltext as sq
from ticketlens.functions.text import response_score
from ticketlens.operators import monitoring as op
from ticketlens.operators.predicates import PredicateRule, evaluate_predicates
from ticketlens.plans.views import view

_COST = " ".join(f"when '{d}' then {c}" for d, c in lx.COST_PER_TICKET.items())


@query("sql_functions_scores", f"""
select ticket_id, {sq.guard_score('text')} as guard, {sq.empathy_score('response')} as empathy, {sq.action_score('response')} as action,
  {sq.clarity_score('response')} as clarity, round({sq.length_score('response')}, 6) as length_part,
  {sq.policy_score('response', 'domain')} as policy, (case domain {_COST} else {lx.UNKNOWN_DOMAIN_COST} end)::double as cost from graded_v""")
def sql_functions_scores(spark, sf):
    sqlfuncs.register(spark)
    return spark.sql(
        "select ticket_id, guard_score(text) as guard, empathy_score(response) as empathy, action_score(response) as action, "
        "clarity_score(response) as clarity, round(length_score(response), 6) as length_part, "
        "policy_score(response, domain) as policy, ticket_cost(domain) as cost from {graded}", graded=view(spark, sf, "graded_v"))


@query("sql_functions_statistics", """
with x as (select domain, control_pred = label as c, treatment_pred = label as t from graded_v),
y as (select domain, count(*) filter (where c and not t) as b, count(*) filter (where not c and t) as c, avg(c::int) as p, avg(t::int) as q from x group by domain)
select domain, round(case when b + c = 0 then 0 else (abs(b - c) - 1)::double ** 2 / (b + c) end, 6) as statistic,
  round(2 * abs(asin(sqrt(p)) - asin(sqrt(q))), 6) as effect from y""")
def sql_functions_statistics(spark, sf):
    sqlfuncs.register(spark)
    return spark.sql(
        "with x as (select domain, control_pred = label as c, treatment_pred = label as t from {graded}), "
        "y as (select domain, count_if(c and not t) as b, count_if(not c and t) as c, avg(cast(c as int)) as p, "
        "avg(cast(t as int)) as q from x group by domain) "
        "select domain, round(mcnemar_statistic(b, c), 6) as statistic, round(cohens_h(p, q), 6) as effect from y",
        graded=view(spark, sf, "graded_v"))


@query("sql_ranked_scores", f"""
with s as (select ticket_id, pos, {sq.response_score('response', 'domain')} as score from candidates_v),
r as (select *, row_number() over (partition by ticket_id order by score desc, pos)::int as rank from s)
select ticket_id, pos, score, rank from r where rank <= 3""")
def sql_ranked_scores(spark, sf):
    udtfs.register_udtfs(spark)
    scored = view(spark, sf, "candidates_v").select("ticket_id", "pos", response_score(F.col("response"), F.col("domain")).alias("score"))
    return spark.sql("select * from ranked_scores(table({scored}), 'ticket_id', 'pos', 'score', 3)", scored=scored)


@query("sql_preference_pairs", f"""
with {_PREF} select ticket_id, chosen_pos as chosen, rejected_pos as rejected, chosen_score, rejected_score from pp""")
def sql_preference_pairs(spark, sf):
    udtfs.register_udtfs(spark)
    scored = view(spark, sf, "candidates_v").select("ticket_id", "pos", response_score(F.col("response"), F.col("domain")).alias("score"))
    return spark.sql(f"select * from preference_pairs(table({{scored}}), 'ticket_id', 'pos', 'score', {lx.PREFERENCE_GAP}D)", scored=scored)


@query("sql_evaluate_rules", f"""
with {mon._EVALUATED} select ts, rule_name, level, coalesce(breach, false) as breach from ev""")
def sql_evaluate_rules(spark, sf):
    udtfs.register_udtfs(spark)
    rules = json.dumps([r[:5] for r in lx.ALERT_RULES])
    hourly = view(spark, sf, "hourly_v").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(f"select ts, rule_name, level, breach from evaluate_rules(table({{hourly}}), 'ts', '{rules}')", hourly=hourly)


# two of the rules cannot work and stay silent: one divides by zero, one names a column that is not there
_PREDICATES = [
    PredicateRule("miss_ratio", "warn", "unsupported_rate / (1 - cache_hit_rate) > 0.617", "unsupported answers against cache misses",
                  "'ratio ' || cast(unsupported_rate / (1 - cache_hit_rate) > 1.013 as string)"),
    PredicateRule("slow_and_shifted", "critical", "p95_ms > 50 and kl_divergence > 0.1", "slow while the mix shifts",
                  "concat('p95 above budget, drift ', drift_detected)"),
    PredicateRule("fallback_text", "warn", "auto_resolution_rate < 0.8", "resolution is low", "cast(1 / (drift_detected - drift_detected) as string)"),
    PredicateRule("divides_by_zero", "warn", "1 / (drift_detected - drift_detected) > 0", "never"),
    PredicateRule("missing_column", "warn", "no_such_metric > 0", "never"),
]


@query("w7_predicate_rules", """
with r as (
  select ts, 'miss_ratio' as rule_name, 'warn' as level, unsupported_rate / nullif(1 - cache_hit_rate, 0) > 0.617 as breach,
    'ratio ' || (unsupported_rate / nullif(1 - cache_hit_rate, 0) > 1.013)::varchar as message from hourly_v
  union all select ts, 'slow_and_shifted', 'critical', p95_ms > 50 and kl_divergence > 0.1,
    'p95 above budget, drift ' || case when drift_detected = 1 then '1.0' else '0.0' end from hourly_v
  union all select ts, 'fallback_text', 'warn', auto_resolution_rate < 0.8, 'resolution is low' from hourly_v
  union all select ts, 'divides_by_zero', 'warn', false, null from hourly_v
  union all select ts, 'missing_column', 'warn', false, null from hourly_v)
select ts, rule_name, level, coalesce(breach, false) as breach, case when breach then message end as message from r""")
def w7_predicates(spark, sf):
    out = evaluate_predicates(view(spark, sf, "hourly_v"), _PREDICATES)
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "rule_name", "level", "breach", "message")


@query("w8_predicate_episodes", """
with b as (select ts, unsupported_rate / nullif(1 - cache_hit_rate, 0) > 0.617 as x from hourly_v),
p as (select ts, coalesce(x, false) as breach, coalesce(lag(coalesce(x, false)) over (order by ts), false) as before from b),
c as (select *, lead(ts) over (order by ts) as resolved_at from p where breach <> before)
select 'miss_ratio' as rule_name, ts as fired_at, resolved_at from c where breach""")
def w8_predicate_episodes(spark, sf):
    out = op.alert_episodes(evaluate_predicates(view(spark, sf, "hourly_v"), _PREDICATES)).where("rule_name = 'miss_ratio'")
    return out.select("rule_name", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"),
                      F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))
