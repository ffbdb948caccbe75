"""Queries of model selection, sweeps, preference data, splits and augmentation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ticketlens.catalog import evaluation
from ticketlens.catalog.base import query
from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqltext as sq
from ticketlens.operators import job, pareto, preference, routing, selection, splits
from ticketlens.plans.views import table, view

_FRONT = """
front as (select p.* from points_v p where not exists (select 1 from points_v q where q.accuracy >= p.accuracy
  and q.latency_ms <= p.latency_ms and q.cost_per_ticket <= p.cost_per_ticket
  and (q.accuracy > p.accuracy or q.latency_ms < p.latency_ms or q.cost_per_ticket < p.cost_per_ticket)))"""


@query("o1_o2_pareto_frontier", f"""
with {_FRONT} select point_id, point_id in (select point_id from front) as is_pareto_optimal from points_v""")
def o2(spark, sf):
    return pareto.pareto_frontier(view(spark, sf, "points_v")).select("point_id",
                                                                      "is_pareto_optimal")


@query("o3_select_best", f"""
with {_FRONT},
f as (select *, latency_ms <= 200 and cost_per_ticket <= 0.2 as fits from front),
c as (select * from f where fits or not exists (select 1 from f where fits)),
l as (select max(accuracy) + 1e-9 as a, min(latency_ms) + 1e-9 as l, min(cost_per_ticket) + 1e-9 as c from c),
b as (select c.*, round((accuracy / l.a * (l.l / latency_ms) * (l.c / cost_per_ticket)) ** (1.0::double / 3.0::double), 12) as g from c, l)
select 'accuracy' as priority, arg_min(point_id, (-accuracy, point_id)) as point_id from b
union all select 'speed', arg_min(point_id, (latency_ms, point_id)) from b
union all select 'cost', arg_min(point_id, (cost_per_ticket, point_id)) from b
union all select 'balanced', arg_min(point_id, (-g, point_id)) from b""")
def o3(spark, sf):
    return pareto.select_best(pareto.pareto_frontier(view(spark, sf, "points_v")), "point_id")


@query("o4_hypervolume", f"""
with {_FRONT},
p as (select distinct accuracy as x, 1 / greatest(latency_ms, 1e-6) as y, 1 / greatest(cost_per_ticket, 1e-6) as z from front),
lv as (select x as lev, x - coalesce(lag(x) over (order by x), 0) as height from (select distinct x from p)),
st as (select lev, height, y, coalesce(lead(y) over (partition by lev order by y desc, z desc), 0) as next_y,
  max(z) over (partition by lev order by y desc, z desc rows between unbounded preceding and current row) as top
  from lv join p on p.x >= lv.lev)
select round(sum(height * (y - next_y) * top), 6) as hypervolume from st""")
def o4(spark, sf):
    return pareto.hypervolume(view(spark, sf, "points_v")).select(
        F.round("hypervolume", 6).alias("hypervolume"))


def _unit(axis: str) -> str:
    return f"('0x' || substr(md5('42-{axis}:' || cast(id as varchar)), 1, 8))::bigint / 4294967296.0::double"


# above a reference point every objective counts from there, and points below it not at all
_REFERENCE = (0.6, 0.004, 5.0)


@query("o4_hypervolume_reference", f"""
with {_FRONT},
p as (select distinct accuracy - 0.6 as x, 1 / greatest(latency_ms, 1e-6) - 0.004 as y, 1 / greatest(cost_per_ticket, 1e-6) - 5.0 as z from front
  where accuracy > 0.6 and 1 / greatest(latency_ms, 1e-6) > 0.004 and 1 / greatest(cost_per_ticket, 1e-6) > 5.0),
lv as (select x as lev, x - coalesce(lag(x) over (order by x), 0) as height from (select distinct x from p)),
st as (select lev, height, y, coalesce(lead(y) over (partition by lev order by y desc, z desc), 0) as next_y,
  max(z) over (partition by lev order by y desc, z desc rows between unbounded preceding and current row) as top
  from lv join p on p.x >= lv.lev)
select round(coalesce(sum(height * (y - next_y) * top), 0), 6) as hypervolume from st""")
def o4_reference(spark, sf):
    return pareto.hypervolume(view(spark, sf, "points_v"), _REFERENCE).select(
        F.round("hypervolume", 6).alias("hypervolume"))


@query("o4_hypervolume_sampled", f"""
with {_FRONT},
p as (select distinct accuracy as x, 1 / greatest(latency_ms, 1e-6) as y, 1 / greatest(cost_per_ticket, 1e-6) as z from front),
top as (select max(x) as tx, max(y) as ty, max(z) as tz from p),
sm as (select id, {_unit('x')} * tx as sx, {_unit('y')} * ty as sy, {_unit('z')} * tz as sz
  from (select unnest(range(10000)) as id) cross join top)
select round((select count(*) from sm where exists (select 1 from p where x >= sx and y >= sy and z >= sz))
  / 10000::double * (select tx * ty * tz from top), 6) as hypervolume""")
def o4_sampled(spark, sf):
    return pareto.hypervolume_sampled(view(spark, sf, "points_v")).select(
        F.round("hypervolume", 6).alias("hypervolume"))


@query("o5_pareto_points", """
select point_id, split_part(run_name, '_', 1) as domain, cast(regexp_extract(run_name, '_r([0-9]+)_', 1) as bigint) as lora_rank,
  accuracy, latency_ms, cost_per_ticket from points_v""")
def o5(spark, sf):
    return pareto.pareto_points(view(spark, sf, "points_v")).drop("run_name")


@query("o6_rank_checkpoints", """
with r as (select *, row_number() over (partition by domain order by eval_loss asc nulls last, checkpoint_id) as r from checkpoints_v)
select checkpoint_id, domain, case when r <= 3 then r end::int as rank, r = 1 as is_best, r <= 3 as kept from r""")
def o6(spark, sf):
    return selection.rank_checkpoints(view(spark, sf, "checkpoints_v"), "eval_loss").select(
        "checkpoint_id", "domain", "rank", "is_best", "kept")


@query("o7_best_checkpoints", """
with r as (select *, row_number() over (partition by domain order by eval_accuracy desc nulls last, checkpoint_id) as r from checkpoints_v)
select domain, checkpoint_id, eval_accuracy from r where r = 1""")
def o7(spark, sf):
    return selection.best_checkpoints(view(spark, sf, "checkpoints_v"), "eval_accuracy",
                                      lower_is_better=False).select(
        "domain", "checkpoint_id", "eval_accuracy")


@query("r17_adapter_registry", """
with r as (select *, row_number() over (partition by domain order by eval_loss asc nulls last, checkpoint_id) as r
  from checkpoints_v where domain <> 'returns')
select d.domain, coalesce('ckpt/' || cast(r.checkpoint_id as varchar), 'outputs/checkpoints/' || d.domain || '_best') as adapter_path,
  (case d.domain when 'technical' then 32 when 'billing' then 24 when 'returns' then 28 else 8 end)::int as lora_rank
from (select unnest(['technical', 'billing', 'returns', 'escalation']) as domain) d left join r on r.domain = d.domain and r.r = 1""")
def r17(spark, sf):
    known = view(spark, sf, "checkpoints_v").where("domain <> 'returns'")
    best = selection.best_checkpoints(known, "eval_loss").withColumn(
        "adapter_path", F.concat(F.lit("ckpt/"), F.col("checkpoint_id").cast("string")))
    return routing.registry(best)


_GRID = ([4, 8, 16], [5e-5, 1e-4, 2e-4], [1, 2], [0.0, 0.05], [0.05, 0.1])


@query("o8_sweep_grid", """
with b as (select distinct lower(replace(p_type, ' ', '-')) || cast(p_size as varchar) as domain from part)
select domain, r as lora_r, lr as learning_rate, a as alpha_mult, r * a as lora_alpha, dr as dropout, w as warmup,
  domain || '_r' || r::varchar || '_lr' || lt || '_a' || a::varchar || '_d' || dt || '_w' || wt as run_name
from b, (select unnest([4, 8, 16])::int as r), (select unnest([5e-5, 1e-4, 2e-4]::double[]) as lr, unnest(['5e-05', '1e-04', '2e-04']) as lt),
  (select unnest([1, 2])::int as a), (select unnest([0.0, 0.05]::double[]) as dr, unnest(['0.0', '0.05']) as dt),
  (select unnest([0.05, 0.1]::double[]) as w, unnest(['0.05', '0.1']) as wt)""")
def o8(spark, sf):
    base = table(spark, sf, "part").select(
        F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))),
                 F.col("p_size").cast("string")).alias("domain")).distinct()
    return selection.sweep_grid(base, *_GRID)


@query("o9_sweep_cells", """
select learning_rate::double as learning_rate, lora_r, round(avg(eval_loss), 6) as mean_loss, count(*) as n_runs
from sweep_v where error is null group by learning_rate, lora_r""")
def o9_cells(spark, sf):
    return selection.sweep_cells(view(spark, sf, "sweep_v")).select(
        F.col("learning_rate").cast("double").alias("learning_rate"), "lora_r",
        F.round("mean_loss", 6).alias("mean_loss"), "n_runs")


@query("o9_sweep_summary", """
with b as (select lora_r, arg_min(run_id, (eval_loss, run_id)) as run_id, min(eval_loss) as eval_loss, max(eval_loss) as hi
  from sweep_v where error is null group by lora_r),
e as (select min(eval_loss) as lo, max(hi) as hi from b)
select lora_r, run_id, eval_loss, round(1 - (eval_loss - e.lo) / (e.hi - e.lo + 1e-8), 6) as accuracy_proxy,
  round(lora_r / 8.0 * 0.03, 6)::double as cost, eval_loss = e.lo as is_best from b, e""")
def o9(spark, sf):
    out = selection.sweep_summary(view(spark, sf, "sweep_v"))
    return out.select("lora_r", "run_id", "eval_loss",
                      F.round("accuracy_proxy", 6).alias("accuracy_proxy"),
                      F.round("cost", 6).alias("cost"), "is_best")


@query("o10_sweep_pivot", """
select lora_r, round(avg(eval_loss) filter (where learning_rate = 0.00005), 6) as lr_0,
  round(avg(eval_loss) filter (where learning_rate = 0.0001), 6) as lr_1,
  round(avg(eval_loss) filter (where learning_rate = 0.0002), 6) as lr_2
from sweep_v where error is null group by lora_r""")
def o10(spark, sf):
    runs = view(spark, sf, "sweep_v").withColumn("learning_rate",
                                                 F.col("learning_rate").cast("double"))
    out = selection.sweep_pivot(runs, [5e-5, 1e-4, 2e-4])
    return out.select("lora_r", *[F.round(f"lr_{i}", 6).alias(f"lr_{i}") for i in range(3)])


@query("o11_param_counts", """
select run_id, lora_r::bigint * 2 * 4096 * 7 * 32 as n_params, round(lora_r::bigint * 2 * 4096 * 7 * 32 / 7.24e9, 9) as share from sweep_v""")
def o11(spark, sf):
    out = selection.param_counts(view(spark, sf, "sweep_v"))
    return out.select("run_id", "n_params", F.round("share", 9).alias("share"))


_PREF = f"""
sc as (select ticket_id, pos, domain, response, {sq.response_score('response', 'domain')} as s from candidates_v),
pp as (select a.ticket_id, a.pos as chosen_pos, b.pos as rejected_pos, a.s as chosen_score, b.s as rejected_score,
  a.response as chosen, b.response as rejected from sc a join sc b on a.ticket_id = b.ticket_id where a.s - b.s >= 0.15)"""


@query("f1_preference_pairs", f"""
with {_PREF} select ticket_id, chosen_pos, rejected_pos, chosen_score, rejected_score from pp""")
def f1(spark, sf):
    return preference.preference_pairs(view(spark, sf, "candidates_v")).select(
        "ticket_id", "chosen_pos", "rejected_pos", "chosen_score", "rejected_score")


@query("p10_dpo_export", f"""
with {_PREF} select t.text as prompt, chosen, rejected from pp join clean_v t on t.ticket_id = pp.ticket_id""")
def p10(spark, sf):
    from ticketlens.operators.clean import to_dpo

    pairs = preference.preference_pairs(view(spark, sf, "candidates_v"))
    return to_dpo(pairs.join(view(spark, sf, "clean_v").select("ticket_id", "text"), "ticket_id"))


def _wins(spark, sf):
    pairs = preference.preference_pairs(view(spark, sf, "candidates_v"))
    return pairs.select(F.col("chosen_pos").alias("winner"), F.col("rejected_pos").alias("loser"))


@query("f2_win_matrix", f"""
with {_PREF} select chosen_pos as winner, rejected_pos as loser, count(*) as n from pp
where chosen_pos <> 6 and rejected_pos <> 6 group by all""")
def f2(spark, sf):
    items = view(spark, sf, "candidates_v").where("response <> ''").select(
        F.col("pos").alias("item"))
    return preference.win_matrix(_wins(spark, sf), items)


_STEPS = 6
_BT = ", ".join(
    f"""s{k} as materialized (select r.i, r.raw / sum(r.raw) over () as p from (select g.i, any_value(w.w) / sum(g.n / (a.p + b.p)) as raw
  from sym g join wn w on w.i = g.i join s{k - 1} a on a.i = g.i join s{k - 1} b on b.i = g.j group by g.i) r)"""
    for k in range(1, _STEPS + 1))


# a fixed number of steps, unrolled in the reference SQL
@query("f3_bradley_terry_steps", f"""
with {_PREF}, eg as materialized (select chosen_pos as i, rejected_pos as j, count(*) as n from pp group by all),
sym as materialized (select i, j, sum(n)::double as n, sum(w)::double as w from
  (select i, j, n, n as w from eg union all select j, i, n, 0 from eg) group by i, j),
wn as (select i, greatest(sum(w), 1e-8) as w from sym group by i),
s0 as (select i, 1.0::double / (select count(*) from wn) as p from wn), {_BT}
select i as item, round(p, 6) as strength from s{_STEPS}""")
def f3(spark, sf):
    out = preference.bradley_terry(preference.win_matrix(_wins(spark, sf)), max_iter=_STEPS,
                                   tol=0.0)
    return out.select("item", F.round("strength", 6).alias("strength"))


def _rank(source, by, seed=42, key="ticket_id"):
    part = f"partition by {by} " if by else ""
    total = f"over (partition by {by})" if by else "over ()"
    return (f"rk as (select *, row_number() over ({part}order by md5('{seed}:' || cast({key} as varchar)), {key}) as r, "
            f"count(*) {total} as total from {source})")


@query("x1_stratified_split", f"""
with {_rank('clean_v', 'label')} select ticket_id, case when r <= round(total * 0.2::double) then 'test' else 'train' end as split from rk""")
def x1(spark, sf):
    return splits.stratified_split(view(spark, sf, "clean_v"), 0.2, "label").select("ticket_id",
                                                                                    "split")


@query("x2_random_split", f"""
with {_rank('clean_v', '')} select ticket_id, case when r <= floor(total * (1.0::double - 0.1::double)) then 'train' else 'test' end as split from rk""")
def x2(spark, sf):
    return splits.stratified_split(view(spark, sf, "clean_v"), 0.1, None).select("ticket_id",
                                                                                 "split")


_THREE = f"""{_rank('clean_v', 'domain')},
sp as (select *, floor(total * (1.0::double - 0.1::double)) as rest from rk),
s3 as (select ticket_id, domain, text, case when r <= floor(rest * (1.0::double - 0.1::double / (1.0::double - 0.1::double))) then 'train'
  when r <= rest then 'val' else 'test' end as split from sp)"""


@query("x3_three_way_split", f"with {_THREE} select ticket_id, domain, split from s3")
def x3(spark, sf):
    return splits.three_way_split(view(spark, sf, "clean_v")).select("ticket_id", "domain",
                                                                     "split")


@query("x6_s7_eval_sample", f"""
with {_THREE}, u as (select * from s3 where split = 'test' and domain <> 'billing' or split = 'val' and domain = 'billing'),
n as (select *, row_number() over (partition by domain order by ticket_id) as k from u)
select ticket_id, domain, split from n where k <= 50""")
def x6(spark, sf):
    parts = splits.three_way_split(view(spark, sf, "clean_v")).where(
        "not (domain = 'billing' and split = 'test')")
    return splits.eval_sample(parts, 50).select("ticket_id", "domain", "split")


@query("x7_seeded_order", f"with {_rank('documents', '', 7, 'doc_id')} select doc_id, r as position from rk")
def x7(spark, sf):
    return splits.seeded_order(table(spark, sf, "documents").select("doc_id"), 7, "doc_id")


@query("s5_merge_domains", f"with {_rank('clean_v', '')} select ticket_id, domain, r as position from rk")
def s5(spark, sf):
    clean = view(spark, sf, "clean_v").select("ticket_id", "domain")
    parts = {d: clean.where(F.col("domain") == d).drop("domain") for d in lx.DOMAINS}
    return splits.merge_domains(parts).select("ticket_id", "domain", "position")


def _duck_template(domain, template, seed=42):
    out = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2 == 0:
            if piece:
                out.append(sq.quote(piece))
        else:
            values = lx.SLOT_VALUES[piece]
            listed = ", ".join(sq.quote(v) for v in values)
            h = f"('0x' || substr(md5('{seed}-{domain}:' || cast(i as varchar) || ':{k}'), 1, 8))::bigint"
            out.append(f"([{listed}])[{h} % {len(values)} + 1]")
    return " || ".join(out)


_TEXTS = "case domain " + " ".join(
    f"when '{d}' then case i % {len(ts)} " + " ".join(
        f"when {t} then {_duck_template(d, x)}" for t, x in enumerate(ts)) + " end"
    for d, ts in lx.TEMPLATES.items()) + " end"

# every domain is lifted to a quarter above the size of the largest one
_TARGET = """
h as (select domain, count(*) as n from clean_v group by domain),
g as (select domain, unnest(range(0, (floor((select max(n) from h) * 1.25::double) - n)::bigint)) as i from h)"""


@query("x4_x5_augment_to_target", f"""
with {_TARGET} select domain || '-' || cast(i as varchar) as example_id, domain, i, {_TEXTS} as text,
  case when domain = 'escalation' then 'escalate' else 'resolved' end as label, 'template' as source, '' as response from g""")
def x5(spark, sf):
    tickets = view(spark, sf, "clean_v")
    sizes = tickets.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    goal = sizes.agg(F.floor(F.max("n") * 1.25).cast("bigint").alias("target")).withColumn(
        "_one", F.lit(1))
    targets = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(goal), "_one").select("domain",
                                                                                        "target")
    return splits.augment_to_target(tickets, targets)


@query("x5_augmented_counts", f"""
with {_TARGET} select domain, source, count(*) as n, count(*) filter (where response = '') as n_empty from (
  select domain, 'seed' as source, '' as response from clean_v union all select domain, 'template', '' from g) group by all""")
def x5_counts(spark, sf):
    tickets = view(spark, sf, "clean_v").drop("source", "response")
    sizes = tickets.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    goal = sizes.agg(F.floor(F.max("n") * 1.25).cast("bigint").alias("target"))
    targets = sizes.withColumn("_one", F.lit(1)).join(
        F.broadcast(goal.withColumn("_one", F.lit(1))), "_one").select("domain", "target")
    rows = splits.augmented_dataset(tickets, targets)
    return rows.groupBy("domain", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("response") == "").alias("n_empty"))


# the parts of the evaluation over the first 50 records of every domain
_JOB = (evaluation._EVAL + "," + evaluation._cells(False)).replace("graded_v", "sampled")
_JOB_ROWS = """
select 'headline' as part, null::varchar as "group", metric, value::double as value from (select unnest(['n', 'auto_resolution_rate', 'sensitivity',
  'false_negative_rate', 'avg_cost', 'p95_ms', 'unsupported_rate', 'composite_score']) as metric,
  unnest([n, arr, sens, fnr, avg_cost, p95, ur, comp]) as value from ec)
union all select 'domain', domain, unnest(['n', 'auto_resolution_rate', 'n_escalated']), unnest([n, arr, nesc]) from m
union all select 'claims', domain, 'unsupported_rate', n_flagged / n_total::double from cl
union all select 'ab', null, unnest(['n', 'accuracy_delta', 'mcnemar_statistic']), unnest([n, ta - ca, stat]) from z
union all select 'pareto', null, unnest(['n_frontier', 'n_runs']), unnest([(select count(*) from front), (select count(*) from points_v)])"""


@query("e11_evaluation_job", f"""
with sampled as (select * from graded_v qualify row_number() over (partition by domain order by ticket_id) <= 50), {_JOB}, {_FRONT},
r as ({_JOB_ROWS})
select part, "group", metric, round(value, 6) as value from r""")
def e11_job(spark, sf):
    wanted = F.struct("part", "metric").isin([F.struct(F.lit(p).alias("part"), F.lit(m).alias("metric")) for p, ms in {
        "headline": ["n", "auto_resolution_rate", "sensitivity", "false_negative_rate", "avg_cost", "p95_ms", "unsupported_rate",
                     "composite_score"],
        "domain": ["n", "auto_resolution_rate", "n_escalated"], "claims": ["unsupported_rate"],
        "ab": ["n", "accuracy_delta", "mcnemar_statistic"], "pareto": ["n_frontier", "n_runs"]}.items() for m in ms])
    report = job.evaluation_job(view(spark, sf, "graded_v"), view(spark, sf, "points_v"), 50)
    return report.where(wanted).withColumn("value", F.round("value", 6))
