"""Queries of the text scores and safety filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqltext as sq
from ticketlens.functions import text as tx
from ticketlens.operators import safety as op
from ticketlens.plans.views import table, view


def R():
    return F.col("response")


def D():
    return F.col("domain")


def TXT():
    return F.col("text")


def _graded(spark, sf):
    return view(spark, sf, "graded_v")


@query("t1_escalation_score", f"""
select ticket_id, {sq.escalation_score('text')} as escalation_score from tickets_v""")
def t1(spark, sf):
    return view(spark, sf, "tickets_v").select(
        "ticket_id", tx.escalation_score(TXT()).alias("escalation_score"))


@query("t2_escalation_signals", f"""
select ticket_id, concat_ws(',', case when {sq.has_word('text', lx.ROUTER_ANGER)} then 'anger' end,
  case when {sq.has_word('text', lx.ROUTER_THREAT)} then 'threat' end,
  case when {sq.has_word('text', lx.ROUTER_URGENCY)} then 'urgency' end) as signals
from tickets_v""")
def t2(spark, sf):
    return view(spark, sf, "tickets_v").select(
        "ticket_id", F.array_join(tx.escalation_signals(TXT()), ",").alias("signals"))


@query("t3_keyword_domain", f"""
select ticket_id, {sq.keyword_domain('text')} as keyword_domain from tickets_v""")
def t3(spark, sf):
    return view(spark, sf, "tickets_v").select(
        "ticket_id", tx.keyword_domain(TXT()).alias("keyword_domain"))


@query("t4_t8_response_subscores", f"""
select ticket_id, {sq.empathy_score('response')} as empathy, {sq.action_score('response')} as action,
  round({sq.clarity_score('response')}, 6) as clarity,
  round({sq.length_score('response')}, 6) as length_score,
  round({sq.policy_score('response', 'domain')}, 6) as policy
from graded_v""")
def t4_t8(spark, sf):
    return _graded(spark, sf).select(
        "ticket_id", tx.empathy_score(R()).alias("empathy"), tx.action_score(R()).alias("action"),
        F.round(tx.clarity_score(R()), 6).alias("clarity"),
        F.round(tx.length_score(R()), 6).alias("length_score"),
        F.round(tx.policy_score(R(), D()), 6).alias("policy"))


@query("t9_response_score", f"""
select ticket_id, {sq.response_score('response', 'domain')} as response_score from graded_v""")
def t9(spark, sf):
    return _graded(spark, sf).select("ticket_id",
                                     tx.response_score(R(), D()).alias("response_score"))


@query("t10_tone_score", f"""
select ticket_id, round({sq.tone_score('response')}, 6) as tone_score from graded_v""")
def t10(spark, sf):
    return _graded(spark, sf).select("ticket_id",
                                     F.round(tx.tone_score(R()), 6).alias("tone_score"))


_FLAGS = sq.compliance_flags("response")
_NON_EMPTY = f"length({sq.strip('response')}) > 0"
_FAILED = "concat_ws(',', case when not (" + _NON_EMPTY + ") then 'non_empty' end, " + ", ".join(
    f"case when domain = '{d}' and not {cond} then '{rule}' end"
    for d, rules in _FLAGS.items() for rule, cond in rules.items()) + ")"
_N_RULES = sq.case_map("domain", {d: 1 + len(r) for d, r in _FLAGS.items()}, "1")


@query("t11_compliance_rules", f"""
select ticket_id, {_FAILED} as failed, cast({_N_RULES} as bigint) as n_rules from graded_v""")
def t11(spark, sf):
    rules = tx.compliance_rules(R(), D())
    return _graded(spark, sf).select(
        "ticket_id", F.array_join(tx.failed_rules(rules), ",").alias("failed"),
        F.size(rules).cast("bigint").alias("n_rules"))


_UPSTREAM = "cast((ticket_id * 13) % 100 as double) / 100"
_CASE = "'ESC-' || upper(substr(md5(cast(ticket_id as varchar)), 1, 6))"
_REPLY = sq.filled(lx.ESCALATION_REPLY, {"case": _CASE})


def _upstream(df):
    return df.withColumn("escalation_score",
                         ((F.col("ticket_id") * 13) % 100).cast("double") / 100.0)


@query("t12_escalation_guard", f"""
with g as (select *, {_UPSTREAM} as up, {sq.guard_score('text')} as scan from graded_v)
select ticket_id, not (up >= 0.6 or scan >= 0.6) as passed,
  round(case when up >= 0.6 or scan >= 0.6 then 0.95 else 1 - greatest(up, scan) end::double, 6)
    as confidence,
  case when up >= 0.6 then printf('upstream score %.3f reaches 0.6', up)
       when scan >= 0.6 then printf('words of the ticket score %.3f', scan)
       else 'nothing asks for a person' end as reason,
  case when up >= 0.6 or scan >= 0.6 then {_REPLY} end as override
from g""")
def t12(spark, sf):
    guard = op.escalation_guard(TXT(), F.col("escalation_score"), op.case_id(F.col("ticket_id")))
    return (_upstream(_graded(spark, sf)).select("ticket_id", guard.alias("g"))
            .select("ticket_id", "g.passed", F.round("g.confidence", 6).alias("confidence"),
                    "g.reason", "g.override"))


@query("t13_scrub_pii", f"""
select ticket_id, {sq.scrub_pii('response')} as scrubbed,
  {sq.scrub_pii('response')} <> response as modified from responses_v""")
def t13(spark, sf):
    clean = tx.scrub_pii(R())
    return view(spark, sf, "responses_v").select(
        "ticket_id", clean.alias("scrubbed"), (clean != R()).alias("modified"))


@query("t13_pii_counts_documents", "select doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, {sq.quote(p)}))::bigint as n_{n}"
    for n, p, _ in lx.PII_PATTERNS) + " from documents")
def t13_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[c.cast("bigint").alias(f"n_{n}") for n, c in tx.pii_counts(TXT()).items()])


def _duck_tone(col):
    n = sq.words(col)
    least = "case when domain = 'escalation' then 15 else 20 end"
    rude, defl = sq.has_word(col, lx.RUDE_WORDS), sq.has_word(col, lx.DEFLECTION_WORDS)
    return (f"case when {n} < {least} then printf('%d words where %d are needed', {n}, {least})"
            f" when {rude} then 'rude wording'"
            f" when {defl} and {n} < 30 then 'deflects without an action'"
            f" else 'tone in order' end")


@query("t14_tone_check", f"""
with t as (select ticket_id, {_duck_tone('response')} as reason from graded_v)
select ticket_id, reason, reason = 'tone in order' as passed,
  cast(case when reason like '%words where%' then 0.9
     when reason like 'Response appears%' then 0.8 else 0.95 end as double) as confidence from t""")
def t14(spark, sf):
    return (_graded(spark, sf).select("ticket_id", op.tone_check(R(), D()).alias("t"))
            .select("ticket_id", "t.reason", "t.passed", "t.confidence"))


@query("t15_t16_unsupported_claims", f"""
with u as (select ticket_id, {sq.unsupported_score('text', 'response')} as s from graded_v)
select ticket_id, s as unsupported_score, s >= 0.6 as unsupported_eval,
  s >= 0.5 as unsupported_serving from u""")
def t15(spark, sf):
    eval_flag = op.flag_unsupported(_graded(spark, sf))
    return eval_flag.select(
        "ticket_id", "unsupported_score", F.col("unsupported").alias("unsupported_eval"),
        (F.col("unsupported_score") >= lx.UNSUPPORTED_SERVING_THRESHOLD)
        .alias("unsupported_serving"))


@query("t17_blend_judge", f"""
with u as (select ticket_id, {sq.unsupported_score('text', 'response')} as s,
   case when ticket_id % 3 <> 0 then cast((ticket_id * 7) % 101 as double) / 100 end as j from graded_v)
select ticket_id, round(coalesce(0.7::double * j + 0.3::double * s, s), 3) as confidence,
  coalesce(0.7::double * j + 0.3::double * s, s) >= 0.6 as unsupported,
  case when j is null then 'heuristic' else 'judge' end as method from u""")
def t17(spark, sf):
    judged = op.flag_unsupported(_graded(spark, sf)).withColumn(
        "judge_score", F.when(F.col("ticket_id") % 3 != 0,
                              ((F.col("ticket_id") * 7) % 101).cast("double") / 100.0))
    return op.blend_judge(judged).select("ticket_id", "confidence", "unsupported", "method")


@query("t18_compliance_check", f"""
with c as (select ticket_id, {_FAILED} as failed, {_N_RULES} as n from graded_v)
select ticket_id, failed = '' as passed,
  round(1 - (case when failed = '' then 0 else len(string_split(failed, ',')) end)
    / n::double, 6) as confidence,
  case when failed = '' then 'no rule broken'
    else 'broken: ' || replace(failed, ',', ', ') end as reason from c""")
def t18(spark, sf):
    return (_graded(spark, sf).select("ticket_id", op.compliance_check(R(), D()).alias("c"))
            .select("ticket_id", "c.passed", F.round("c.confidence", 6).alias("confidence"),
                    "c.reason"))


_FINAL_FLAGS = sq.compliance_flags("fin")
_FINAL_FAILED = " + ".join(
    [f"(not (length({sq.strip('fin')}) > 0))::int"]
    + [f"(domain = '{d}' and not {cond})::int"
       for d, rules in _FINAL_FLAGS.items() for cond in rules.values()])


@query("t19_run_filters", f"""
with g as (select *, {_UPSTREAM} as up, {sq.guard_score('text')} as scan from graded_v),
d as (select *, (up >= 0.6 or scan >= 0.6) as esc,
   case when up >= 0.6 or scan >= 0.6 then {_REPLY} else response end as draft from g),
f as (select *, {sq.scrub_pii('draft')} as fin from d),
s as (select *, {sq.unsupported_score('text', 'fin')} as us, {_duck_tone('fin')} as tone,
   {_FINAL_FAILED} as n_failed from f)
select ticket_id, fin as final_response, esc as escalation_triggered, fin <> draft as pii_scrubbed,
  (not esc and us >= 0.5) as unsupported_flagged,
  (not esc and us < 0.5 and tone = 'tone in order' and n_failed = 0) as quality_passed,
  (case when esc then 2 else 5 end)::bigint as n_filters,
  case when esc then {_CASE} end as case_id
from s""")
def t19(spark, sf):
    out = op.run_filters(_upstream(_graded(spark, sf)))
    return out.select("ticket_id", "final_response", "escalation_triggered", "pii_scrubbed",
                      "unsupported_flagged", "quality_passed",
                      F.size("filter_results").cast("bigint").alias("n_filters"), "case_id")


@query("t20_judge_scores", f"""
select ticket_id, coalesce(round(case when ticket_id % 4 <> 0 then (1 + ticket_id % 10)::double end / 10, 4),
  {sq.response_score('response', 'domain')}) as score from graded_v""")
def t20(spark, sf):
    judged = _graded(spark, sf).withColumn(
        "judge_raw", F.when(F.col("ticket_id") % 4 != 0, 1 + F.col("ticket_id") % 10))
    return op.normalise_judge_scores(judged).select("ticket_id", "score")
