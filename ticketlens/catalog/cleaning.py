"""Queries of the cleaning, validation and projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqltext as sq
from ticketlens.operators import clean as op
from ticketlens.plans.views import table, view

_KNOWN = ", ".join(f"'{d}'" for d in lx.DOMAINS)
_LABELS = ", ".join(f"'{x}'" for x in lx.LABELS)


@query("p1_trim_strings", f"""
select ticket_id, {sq.strip('domain')} as domain, {sq.strip('label')} as label,
       {sq.strip('text')} as text from tickets_v""")
def p1(spark, sf):
    return op.trim_strings(view(spark, sf, "tickets_v").select("ticket_id", "domain", "label",
                                                              "text"))


@query("p2_drop_empty_text", f"""
select ticket_id, text from tickets_v where length({sq.strip('text')}) > 0""")
def p2(spark, sf):
    return op.drop_empty_text(view(spark, sf, "tickets_v")).select("ticket_id", "text")


@query("p3_default_label", """
select d.doc_id, coalesce(case when l.quality = 0 then 'escalate' end, 'resolved') as label
from documents d left join labels l on l.doc_id = d.doc_id""")
def p3(spark, sf):
    labels = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "escalate").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id")
    return op.default_label(docs.join(labels, "doc_id", "left"))


@query("p4_normalise_label", f"""
select ticket_id, case when lower({sq.strip('label')}) in ({_LABELS})
  then lower({sq.strip('label')}) else 'resolved' end as label from tickets_v""")
def p4(spark, sf):
    return op.normalise_label(view(spark, sf, "tickets_v").select("ticket_id", "label"))


@query("p5_normalise_domain", f"""
select lower({sq.strip("source || ' '")}) as domain,
  lower({sq.strip("source || ' '")}) in ({_KNOWN}) as domain_known, count(*) as n_rows
from documents group by all
union all select domain, domain in ({_KNOWN}), count(*) from traces_v group by all""")
def p5(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat("source", F.lit(" ")).alias("domain"))
    traces = view(spark, sf, "traces_v").select("domain")
    count = lambda df: (op.normalise_domain(df).groupBy("domain", "domain_known")
                        .agg(F.count(F.lit(1)).alias("n_rows")))
    return count(docs).unionByName(count(traces))


@query("p5_cleaning_report", f"""
select lower({sq.strip('domain')}) as domain, lower({sq.strip('domain')}) in ({_KNOWN}) as domain_known,
  count(*) as n_rows, count(*) filter (where length({sq.strip('text')}) = 0) as n_empty,
  count(*) filter (where length({sq.strip('text')}) > 0
     and lower({sq.strip('label')}) not in ({_LABELS})) as n_invalid_label
from tickets_v group by all""")
def p5_report(spark, sf):
    return op.cleaning_report(view(spark, sf, "tickets_v"))


def _requests(spark, sf):
    """Each turn as a request whose history is the two turns before it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")

    def before(k):
        return turns.select("conv_id", (F.col("turn") + k).alias("turn"),
                            F.struct("role", F.col("text").alias("content")).alias(f"h{k}"))

    return (turns.join(before(1), ["conv_id", "turn"], "left")
            .join(before(2), ["conv_id", "turn"], "left")
            .withColumn("history", F.array_compact(F.array("h2", "h1"))))


@query("p6_validate_requests", f"""
with r as (
  select c.conv_id, c.turn, c.text, a.role as r1, b.role as r2
  from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn = c.turn - 1
  left join conversations b on b.conv_id = c.conv_id and b.turn = c.turn - 2)
select conv_id, turn, {sq.strip('text')} as text,
  concat_ws(',', case when length(text) < 5 then 'text_too_short' end,
    case when length(text) > 4000 then 'text_too_long' end,
    case when r1 not in ('user', 'assistant', 'system') or r2 not in ('user', 'assistant', 'system')
      then 'history_role' end) as reasons,
  length(text) between 5 and 4000 and coalesce(r1 in ('user', 'assistant', 'system'), true)
    and coalesce(r2 in ('user', 'assistant', 'system'), true) as valid
from r""")
def p6(spark, sf):
    out = op.validate_requests(_requests(spark, sf), history="history")
    return out.select("conv_id", "turn", "text", F.array_join("reasons", ",").alias("reasons"),
                      "valid")


@query("p7_build_context", """
with h as (select *, row_number() over (partition by conv_id order by turn desc) as r
           from conversations),
c as (select conv_id, string_agg(role || ': ' || text, ' | ' order by turn) as recent
      from h where r <= 2 group by conv_id)
select t.ticket_id, case when c.recent is null then t.text
  else c.recent || ' | user: ' || t.text end as context
from clean_v t left join c on c.conv_id = t.ticket_id""")
def p7(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("conv_id", "ticket_id")
    tickets = view(spark, sf, "clean_v").select("ticket_id", "text")
    return op.build_context(tickets, turns, "ticket_id").select("ticket_id", "context")


def _duck_prompt(response):
    about = sq.case_map("domain", {k: sq.quote(v) for k, v in lx.DOMAIN_DESCRIPTIONS.items()},
                        "domain")
    return sq.filled(lx.PROMPT, {"domain": about, "ticket": sq.strip("text"), "response": response})


@query("p8_format_prompts", f"""
select ticket_id, {_duck_prompt(sq.strip('response'))} as prompt from graded_v""")
def p8(spark, sf):
    return op.format_prompts(view(spark, sf, "graded_v")).select("ticket_id", "prompt")


@query("p9_supervised_examples", f"""
with e as (select ticket_id, {_duck_prompt("''")} as p, {_duck_prompt(sq.strip('response'))} as f
           from graded_v)
select ticket_id, least({sq.words('p')}, 48)::bigint as n_prompt_tokens,
  least({sq.words('f')}, 48)::bigint as n_tokens, {sq.words('f')} > 48 as truncated,
  greatest(least({sq.words('f')}, 48) - least({sq.words('p')}, 48), 0)::bigint as n_loss_tokens
from e""")
def p9(spark, sf):
    out = op.sft_examples(view(spark, sf, "graded_v"), max_len=48)
    return out.select("ticket_id", "n_prompt_tokens", "n_tokens", "truncated",
                      F.size(F.filter("labels", lambda x: x >= 0)).cast("bigint")
                      .alias("n_loss_tokens"))


@query("p11_format_eval", """
select domain, case when domain = 'returns' then 0.0::double else
    round(avg((treatment_pred = label)::int), 6) end as auto_resolution_rate,
  0.0::double as unsupported_rate,
  case when domain = 'returns' then 0.0::double else round(avg((control_pred = label)::int), 6) end
    as composite_score,
  case when domain = 'returns' then 0.0::double else round(max(latency_ms), 6) end as p95_ms
from graded_v group by domain""")
def p11(spark, sf):
    measured = view(spark, sf, "graded_v").groupBy("domain").agg(
        F.round(F.avg((F.col("treatment_pred") == F.col("label")).cast("int")), 6).alias("a"),
        F.round(F.avg((F.col("control_pred") == F.col("label")).cast("int")), 6).alias("c"),
        F.round(F.max("latency_ms"), 6).alias("p"))
    entry = F.struct(F.col("a").alias("auto_resolution_rate"),
                     F.lit(None).cast("double").alias("unsupported_rate"),
                     F.col("c").alias("composite_score"), F.col("p").alias("p95_ms"))
    kind = "array<struct<auto_resolution_rate:double,unsupported_rate:double," \
           "composite_score:double,p95_ms:double>>"
    reports = measured.select(
        "domain",
        F.when(F.col("domain") == "returns", F.array().cast(kind)).otherwise(F.array(entry))
        .alias("results"))
    return op.format_eval(reports)


@query("p12_log_records", """
select trace_id, round(routing_confidence, 4) as routing_confidence,
  round(generation_ms, 1) as generation, round(router_ms + lora_load_ms + generation_ms + safety_ms, 1)
  as total, domain, cache_hit from traces_v""")
def p12(spark, sf):
    return op.to_log(view(spark, sf, "traces_v")).select(
        "trace_id", "routing_confidence", F.col("latency_ms.generation").alias("generation"),
        F.col("latency_ms.total").alias("total"), "domain", "cache_hit")


@query("p13_parse_run_name", """
select point_id, split_part(run_name, '_', 1) as domain,
  cast(regexp_extract(run_name, '_r([0-9]+)_', 1) as bigint) as lora_rank from points_v""")
def p13(spark, sf):
    domain, rank = op.parse_run_name(F.col("run_name"))
    return view(spark, sf, "points_v").select("point_id", domain.alias("domain"),
                                              rank.alias("lora_rank"))


@query("p14_total_latency", """
select trace_id, round(router_ms + lora_load_ms + generation_ms + safety_ms, 6) as total_ms
from traces_v""")
def p14(spark, sf):
    return view(spark, sf, "traces_v").select(
        "trace_id", F.round(op.total_latency(), 6).alias("total_ms"))


@query("p15_finalise_traces", f"""
select trace_id, case when escalation_detected then 'escalated' else 'resolved' end as status,
  cast({sq.case_map('domain', lx.COST_PER_TICKET, '0.10')} as double) as cost,
  round(router_ms + lora_load_ms + generation_ms + safety_ms, 6) as total_ms from traces_v""")
def p15(spark, sf):
    out = op.finalise_traces(view(spark, sf, "traces_v"))
    return out.select("trace_id", "status", "cost", F.round("total_ms", 6).alias("total_ms"))
