"""Queries of the evaluation metrics and A/B statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqltext as sq
from ticketlens.functions import stats as st
from ticketlens.functions import text as tx
from ticketlens.operators import abtest, clean
from ticketlens.operators import metrics as op
from ticketlens.plans.views import view


def _graded(spark, sf):
    return view(spark, sf, "graded_v").withColumnRenamed("treatment_pred", "pred")


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


_COST = f"({sq.case_map('domain', lx.COST_PER_TICKET, '0')})::double"
_COUNTS = f"""
c as (select domain, count(*) as n, count(*) filter (where label = 'resolved') as ntr,
  count(*) filter (where label = 'resolved' and treatment_pred = 'resolved') as nbr,
  count(*) filter (where label = 'escalate' and treatment_pred = 'escalate') as tp,
  count(*) filter (where label = 'resolved' and treatment_pred = 'escalate') as fp,
  count(*) filter (where label = 'escalate' and treatment_pred = 'resolved') as fn,
  sum({_COST}) as cost, sum(length(response))::bigint as len,
  count(*) filter (where treatment_pred = 'escalate') as nesc
  from graded_v group by grouping sets ((), (domain))),
m as (select domain, n, nbr / greatest(ntr, 1)::double as arr, tp, nbr as tn, fp, fn,
  tp / greatest(tp + fn, 1)::double as sens, nbr / greatest(nbr + fp, 1)::double as spec,
  fn / greatest(tp + fn, 1)::double as fnr, fp / greatest(nbr + fp, 1)::double as fpr,
  tp / greatest(tp + fp, 1)::double as prec, cost, cost / n as avg_cost, len, nesc from c)"""
_LAT = """
lat as (select quantile_cont(latency_ms, 0.5) as p50, quantile_cont(latency_ms, 0.95) as p95,
  quantile_cont(latency_ms, 0.99) as p99, avg(latency_ms) as mean, max(latency_ms) as top, count(*) as n from graded_v)"""
_CLAIMS = f"""
u as (select domain, {sq.unsupported_score('text', 'response')} as s from graded_v),
cl as (select domain, count(*) as n_total, count(*) filter (where s >= 0.6) as n_flagged, avg(s) as avg_s
  from u group by grouping sets ((), (domain)))"""


@query("e0_flagship_by_domain", f"""
with k as (select domain, label, {sq.escalation_score('text')} as kw, {sq.keyword_domain('text')} as kwd from clean_v),
r as (select domain, label, case when kw >= 0.5 then 'escalation' when kwd is not null then kwd else 'technical' end as routed,
  (kw >= 0.6 or kw >= 0.5) as escalated from k),
g as (select domain, count(*) as n, count(*) filter (where routed = domain) as n_routed,
  count(*) filter (where label = 'resolved') as ntr, count(*) filter (where label = 'resolved' and not escalated) as nbr,
  sum(({sq.case_map('routed', lx.COST_PER_TICKET, '0')})::double) as cost from r group by grouping sets ((), (domain)))
select coalesce(domain, 'all') as domain, n, n_routed, round(nbr / greatest(ntr, 1)::double, 6) as auto_resolution_rate,
  round(cost / n, 6) as avg_cost from g""")
def flagship(spark, sf):
    tickets = clean.clean_tickets(view(spark, sf, "tickets_v").drop("ts"))
    kw = tx.escalation_score(F.col("text"))
    routed = tickets.select(
        "domain", "label", kw.alias("kw"), tx.keyword_domain(F.col("text")).alias("kwd")
    ).select(
        F.col("domain").alias("truth"), "label",
        F.when(F.col("kw") >= 0.5, "escalation")
        .otherwise(F.coalesce("kwd", F.lit("technical"))).alias("domain"),
        (F.col("kw") >= lx.FALLBACK_ESCALATION).alias("escalated"))
    per = routed.groupBy("truth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("truth") == F.col("domain")).alias("n_routed"),
        F.count_if(F.col("label") == "resolved").alias("ntr"),
        F.count_if((F.col("label") == "resolved") & ~F.col("escalated")).alias("nbr"),
        F.sum(clean.ticket_cost(F.col("domain"))).alias("cost"))
    out = op._with_total(per, "truth")
    return out.select(
        F.coalesce("truth", F.lit("all")).alias("domain"), "n", "n_routed",
        F.round(F.col("nbr") / F.greatest("ntr", F.lit(1)), 6).alias("auto_resolution_rate"),
        F.round(F.col("cost") / F.col("n"), 6).alias("avg_cost"))


@query("e1_auto_resolution_rate", f"""
with {_COUNTS} select domain, n, round(arr, 6) as auto_resolution_rate from m""")
def e1(spark, sf):
    return _rounded(op.auto_resolution_rate(_graded(spark, sf)), "auto_resolution_rate")


@query("e2_escalation_metrics", f"""
with {_COUNTS} select domain, n, tp, tn, fp, fn, round(sens, 6) as sensitivity, round(spec, 6) as specificity,
 round(fnr, 6) as false_negative_rate, round(fpr, 6) as false_positive_rate, round(prec, 6) as precision,
 round(2 * prec * sens / greatest(prec + sens, 1e-9), 6) as f1, fnr < 0.005 as meets_budget from m""")
def e2(spark, sf):
    return _rounded(op.escalation_metrics(_graded(spark, sf)), "sensitivity", "specificity",
                    "false_negative_rate", "false_positive_rate", "precision", "f1")


@query("e3_latency_metrics", f"""
with {_LAT} select round(p50, 6) as p50_ms, round(p95, 6) as p95_ms, round(p99, 6) as p99_ms,
  round(mean, 6) as mean_ms, top as max_ms, n, p95 < 200 as meets_sla from lat""")
def e3(spark, sf):
    return _rounded(op.latency_metrics(_graded(spark, sf)), "p50_ms", "p95_ms", "p99_ms",
                    "mean_ms")


@query("e3_latency_metrics_traces", """
with t as (select router_ms + lora_load_ms + generation_ms + safety_ms as x from traces_v)
select round(quantile_cont(x, 0.5), 6) as p50_ms, round(quantile_cont(x, 0.95), 6) as p95_ms,
  round(quantile_cont(x, 0.99), 6) as p99_ms, round(avg(x), 6) as mean_ms, round(max(x), 6) as max_ms,
  count(*) as n, quantile_cont(x, 0.95) < 200 as meets_sla from t""")
def e3_traces(spark, sf):
    df = view(spark, sf, "traces_v").select(clean.total_latency().alias("latency_ms"))
    return _rounded(op.latency_metrics(df), "p50_ms", "p95_ms", "p99_ms", "mean_ms", "max_ms")


@query("e4_cost_metrics", f"""
with c as (select domain, count(*) as n_tickets, sum({_COST}) as total_cost from traces_v
  where domain <> 'unknown' group by grouping sets ((), (domain)))
select domain, n_tickets, round(total_cost, 6) as total_cost, round(total_cost / n_tickets, 6) as avg_cost,
  round((1 - total_cost / n_tickets / 0.5) * 100, 6) as cost_reduction_pct from c""")
def e4(spark, sf):
    return _rounded(op.cost_metrics(view(spark, sf, "traces_v")), "total_cost", "avg_cost",
                    "cost_reduction_pct")


def _keyword_routed(spark, sf):
    return view(spark, sf, "clean_v").select(
        "domain", F.coalesce(tx.keyword_domain(F.col("text")), F.lit("technical")).alias("pred"))


_KW = f"""
k as (select domain as truth, coalesce({sq.keyword_domain('text')}, 'technical') as pred from clean_v),
cm as (select truth, pred, count(*) as n from k group by all),
tr as (select truth as class, sum(n) as support, sum(n) filter (where truth = pred) as tp from cm group by truth),
pd as (select pred as class, sum(n) as predicted from cm group by pred),
rp as (select class, coalesce(tp, 0) / greatest(coalesce(predicted, 0), 1)::double as precision,
  coalesce(tp, 0) / greatest(coalesce(support, 0), 1)::double as recall, coalesce(support, 0)::bigint as support,
  coalesce(tp, 0)::bigint as tp from tr full join pd using (class)),
rf as (select *, 2 * precision * recall / greatest(precision + recall, 1e-12) as f1 from rp)"""


@query("e5_routing_accuracy", f"""
with {_KW} select round(sum(tp) / sum(support)::double, 6) as accuracy, round(avg(f1), 6) as macro_f1,
 round(sum(f1 * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as n from rf""")
def e5(spark, sf):
    return _rounded(op.routing_accuracy(_keyword_routed(spark, sf)), "accuracy", "macro_f1",
                    "weighted_f1")


@query("m4_classification_report", f"""
with {_KW} select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support, tp from rf""")
def m4(spark, sf):
    return _rounded(op.classification_report(_keyword_routed(spark, sf), "domain", "pred"),
                    "precision", "recall", "f1")


@query("m4_confusion_matrix", f"""
with {_KW} select truth, {', '.join(f"coalesce(sum(n) filter (where pred = '{d}'), 0)::bigint as {d}" for d in lx.DOMAINS)}
from cm group by truth""")
def m4_matrix(spark, sf):
    return op.confusion_matrix(_keyword_routed(spark, sf), "domain", "pred", lx.DOMAINS)


_EVAL = f"""{_COUNTS}, {_LAT}, {_CLAIMS},
ev as (select m.n, arr, sens, fnr, fnr < 0.005 as meets_budget, avg_cost, 1 - avg_cost / 0.5 as red, p95, p95 < 200 as meets_sla,
  n_flagged / n_total::double as ur from m, lat, cl where m.domain is null and cl.domain is null),
ec as (select *, 0.35 * arr + 0.30 * sens + 0.15 * case when p95 < 200 then 1.0 else greatest(0, 1 - (p95 - 200) / 200) end::double
  + 0.10 * least(red, 1) + 0.10 * greatest(0, 1 - ur * 10) as comp from ev)"""


@query("e6_e8_e11_evaluate", f"""
with {_EVAL} select n, round(arr, 6) as auto_resolution_rate, round(sens, 6) as sensitivity,
  round(fnr, 6) as false_negative_rate, meets_budget, round(avg_cost, 6) as avg_cost, round(red, 6) as cost_reduction,
  round(p95, 6) as p95_ms, meets_sla, round(ur, 6) as unsupported_rate, round(comp, 6) as composite_score,
  meets_budget and meets_sla and ur < 0.05 as passes_gates from ec""")
def e11(spark, sf):
    return _rounded(op.evaluate(_graded(spark, sf)), "auto_resolution_rate", "sensitivity",
                    "false_negative_rate", "avg_cost", "cost_reduction", "p95_ms",
                    "unsupported_rate", "composite_score")


@query("e7_domain_evaluation", f"""
with {_COUNTS} select domain, n, round(arr, 6) as auto_resolution_rate, nesc as n_escalated, n - nesc as n_resolved,
  round(len / n::double, 6) as mean_response_length, round(avg_cost, 6) as avg_cost from m""")
def e7(spark, sf):
    return _rounded(op.domain_evaluation(_graded(spark, sf)).select(
        "domain", "n", "auto_resolution_rate", "n_escalated", "n_resolved",
        "mean_response_length", "avg_cost"), "auto_resolution_rate", "mean_response_length",
        "avg_cost")


@query("e9_target_table", f"""
with {_EVAL}
select 'auto_resolution_rate' as metric, round(arr, 6) as value, 0.94::double as target, arr > 0.94 as met from ec
union all select 'sensitivity', round(sens, 6), 0.998, sens > 0.998 from ec
union all select 'false_negative_rate', round(fnr, 6), 0.005, fnr < 0.005 from ec
union all select 'p95_ms', round(p95, 6), 200, p95 < 200 from ec
union all select 'avg_cost', round(avg_cost, 6), 0.1, avg_cost < 0.1 from ec
union all select 'unsupported_rate', round(ur, 6), 0.05, ur < 0.05 from ec""")
def e9(spark, sf):
    return op.target_table(op.evaluate(_graded(spark, sf))).select(
        "metric", F.round("value", 6).alias("value"), "target", "met")


@query("e10_unsupported_report", f"""
with {_CLAIMS} select domain, n_total, n_flagged, round(n_flagged / n_total::double, 6) as unsupported_rate,
  round(avg_s, 6) as avg_confidence from cl""")
def e10(spark, sf):
    return _rounded(op.unsupported_report(_graded(spark, sf)), "unsupported_rate",
                    "avg_confidence")


def _cells(group):
    return f"""
x as (select domain, control_pred = label as c, treatment_pred = label as t from graded_v),
y as (select {'domain,' if group else ''} count(*) as n, count(*) filter (where c and t) as a, count(*) filter (where c and not t) as b,
  count(*) filter (where not c and t) as cc, count(*) filter (where not c and not t) as d from x {'group by domain' if group else ''}),
z as (select *, (a + b) / n::double as ca, (a + cc) / n::double as ta,
  case when b + cc = 0 then 0 else (abs(b - cc) - 1)::double ** 2 / (b + cc) end as stat from y)"""


_Z = st.z_score(0.975) + st.z_score(0.80)
_AB = f"""round(ca, 6) as control_accuracy, round(ta, 6) as treatment_accuracy, round(ta - ca, 6) as accuracy_delta,
  round(stat, 6) as mcnemar_statistic, round(2 * abs(asin(sqrt(ca)) - asin(sqrt(ta))), 6) as effect_size,
  round({_Z!r} * sqrt({2 * 0.72 * 0.28!r} / n), 6) as mde, a, b, cc as c, d, n"""
_AB_COLUMNS = ["control_accuracy", "treatment_accuracy", "accuracy_delta", "mcnemar_statistic",
               "effect_size", "mde"]


@query("b1_ab_test", f"with {_cells(False)} select {_AB}, stat > 3.841458820694124 as is_significant from z")
def b1(spark, sf):
    out = abtest.ab_test(view(spark, sf, "graded_v"))
    return _rounded(out.select(*_AB_COLUMNS, "a", "b", "c", "d", "n", "is_significant"),
                    *_AB_COLUMNS)


@query("b7_ab_test_by_domain", f"""
with {_cells(True)} select domain, {_AB}, round(0.05 / count(*) over (), 6) as alpha from z""")
def b7(spark, sf):
    out = abtest.ab_test(view(spark, sf, "graded_v"), by="domain")
    return _rounded(out.select("domain", *_AB_COLUMNS, "a", "b", "c", "d", "n", "alpha"),
                    *_AB_COLUMNS, "alpha")


# exact two-sided binomial on small customer groups, chi-square ones only by statistic
@query("b2_mcnemar_by_customer_group", """
with x as (select customer_id, control_pred = label as c, treatment_pred = label as t from
   (select g.*, t.customer_id from graded_v g join tickets_v t on t.ticket_id = g.ticket_id)),
y as (select customer_id, count(*) filter (where c and not t) as b, count(*) filter (where not c and t) as c from x group by customer_id),
i as (select customer_id, b, c, unnest(range(0, least(b, c) + 1)) as k from y where b + c between 1 and 24),
p as (select customer_id, least(1.0, 2 * sum(gamma((b + c + 1)::double) / gamma((k + 1)::double) / gamma((b + c - k + 1)::double)) / 2.0 ** any_value(b + c)) as p
  from i group by customer_id)
select y.customer_id, y.b, y.c, round(case when y.b + y.c = 0 then 0 else (abs(y.b - y.c) - 1)::double ** 2 / (y.b + y.c) end, 6) as statistic,
  round(case when y.b + y.c = 0 then 1.0 else p.p end::double, 6) as exact_p_value from y left join p on p.customer_id = y.customer_id""")
def b2(spark, sf):
    owner = view(spark, sf, "tickets_v").select("ticket_id", "customer_id")
    cells = abtest.paired_cells(view(spark, sf, "graded_v").join(owner, "ticket_id"),
                                by=["customer_id"])
    few = F.col("b") + F.col("c") < 25  # the exact test; tests/ hold the other branch
    return cells.select(
        "customer_id", "b", "c",
        F.round(st.mcnemar_statistic(F.col("b"), F.col("c")), 6).alias("statistic"),
        F.when(few, F.round(st.mcnemar_p_value()("b", "c"), 6)).alias("exact_p_value"))


_ERFC = "t * exp(-h * h - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"
# p of the discordant counts in y (customer_id, b, c): exact below 25 pairs, else the chi-square
# tail by a rational approximation of erfc, 1.2e-7 at most from it
_P_VALUES = f"""
i as (select customer_id, b, c, unnest(range(0, least(b, c) + 1)) as k from y where b + c between 1 and 24),
p as (select customer_id, least(1.0, 2 * sum(gamma((b + c + 1)::double) / gamma((k + 1)::double) / gamma((b + c - k + 1)::double)) / 2.0 ** any_value(b + c)) as p
  from i group by customer_id),
h as (select customer_id, (abs(b - c) - 1)::double / sqrt(2.0 * (b + c)) as s from y where b + c >= 25),
e as (select customer_id, s, abs(s) as h, 1 / (1 + 0.5 * abs(s)) as t from h),
q as (select customer_id, {_ERFC} as p from e)
select y.customer_id, y.b, y.c,
  round(case when y.b + y.c = 0 then 1.0 when y.b + y.c < 25 then p.p else q.p end::double, 6) as p_value
from y left join p on p.customer_id = y.customer_id left join q on q.customer_id = y.customer_id"""


def mcnemar_p_values(cells):
    """customer_id, b, c and the p-value of every group, whichever test its size asks for."""
    return cells.select("customer_id", "b", "c", F.round(st.mcnemar_p_value()("b", "c"), 6).alias("p_value"))


@query("b2_mcnemar_p_value_by_customer_group", f"""
with x as (select customer_id, control_pred = label as c, treatment_pred = label as t from
   (select g.*, t.customer_id from graded_v g join tickets_v t on t.ticket_id = g.ticket_id)),
y as (select customer_id, count(*) filter (where c and not t) as b, count(*) filter (where not c and t) as c from x group by customer_id),
{_P_VALUES}""")
def b2_p_value(spark, sf):
    owner = view(spark, sf, "tickets_v").select("ticket_id", "customer_id")
    return mcnemar_p_values(abtest.paired_cells(
        view(spark, sf, "graded_v").join(owner, "ticket_id"), by=["customer_id"]))


@query("b3_bootstrap_interval")
def b3(spark, sf):
    out = abtest.ab_test(view(spark, sf, "graded_v"), by="domain")
    return out.select("domain", "accuracy_delta", "ci_lower", "ci_upper", "p_value")


_UNIFORM = "('0x' || substr(h, 4 * k + 1, 4))::int"
_WEIGHT = " + ".join(f"(u >= {math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))})::int" for k in range(8))


@query("b3_poisson_bootstrap", f"""
with x as (select domain, ticket_id, (treatment_pred = label)::int - (control_pred = label)::int as accuracy_delta,
  case when treatment_pred = 'resolved' then latency_ms end as resolved_latency_ms from graded_v),
v as (select domain, ticket_id, 'accuracy_delta' as metric, accuracy_delta::double as x from x
  union all select domain, ticket_id, 'resolved_latency_ms', resolved_latency_ms from x where resolved_latency_ms is not null),
d as (select domain, ticket_id, metric, x, b, md5('42:' || ticket_id || ':' || b) as h from v, (select unnest(range(0, 50)) as b)),
u as (select domain, metric, x, 8 * b + k as replicate, {_UNIFORM} as u from d, (select unnest(range(0, 8)) as k)),
w as (select domain, metric, replicate, x, {_WEIGHT} as w from u),
m as (select domain, metric, sum(w * x) / nullif(sum(w), 0)::double as mean from w group by domain, metric, replicate),
e as (select domain, metric, count(*) as n, avg(x) as estimate from v group by domain, metric)
select e.domain, e.metric, any_value(n) as n, round(any_value(estimate), 6) as estimate,
  round(quantile_cont(mean, 0.025), 6) as ci_lower, round(quantile_cont(mean, 0.975), 6) as ci_upper
from e join m on m.domain = e.domain and m.metric = e.metric group by e.domain, e.metric""")
def b3_poisson(spark, sf):
    right = lambda c: (F.col(c) == F.col("label")).cast("int")
    out = abtest.poisson_bootstrap(view(spark, sf, "graded_v"), "ticket_id", {
        "accuracy_delta": right("treatment_pred") - right("control_pred"),
        "resolved_latency_ms": F.when(F.col("treatment_pred") == "resolved", F.col("latency_ms"))}, ("domain",))
    return _rounded(out, "estimate", "ci_lower", "ci_upper")


@query("b5_required_sample_size", f"""
with {_cells(True)} select domain, ceil({_Z ** 2 * 2 * 0.72 * 0.28!r} / greatest((ta - ca) ** 2, 1e-9))::bigint as required_n from z""")
def b5(spark, sf):
    out = abtest.ab_test(view(spark, sf, "graded_v"), by="domain")
    return out.select("domain", st.required_sample_size(F.col("accuracy_delta"))
                      .alias("required_n"))
