"""Input views over the given tables; one SQL text serves Spark and the reference SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEW_SQL = {
    "tickets_v": """
select o_orderkey as ticket_id, o_custkey as customer_id, o_orderdate as ts,
  case o_orderkey % 4 when 0 then 'technical' when 1 then 'billing' when 2 then 'returns' else 'escalation' end as domain,
  case when o_orderkey % 37 = 0 then ' Escalate ' when o_orderkey % 41 = 0 then 'maybe'
       when o_orderkey % 4 = 3 then 'escalate' else 'resolved' end as label,
  case when o_orderkey % 211 = 0 then '  '
       when o_orderkey % 97 = 0 then 'hi'
       when o_orderkey % 4 = 0 then case cast(floor(o_orderkey / 4) as bigint) % 3
            when 0 then 'Sync between hub and router stopped, the firmware update did not finish.'
            when 1 then 'Unit with a bluetooth crash: no. ' || cast(o_custkey as varchar(20)) || ', it began with a driver update.'
            else 'Screen freezing, device ' || cast(o_orderkey as varchar(20)) || ', mostly before noon.' end
       when o_orderkey % 4 = 1 then case cast(floor(o_orderkey / 4) as bigint) % 3
            when 0 then 'Two bookings were billed, order #' || cast(100000 + o_orderkey as varchar(20)) || ' needs a refund of one of them.'
            when 1 then 'Please explain the charge of $' || cast(cast(floor(o_totalprice) as bigint) as varchar(20)) || '.99 on the last invoice.'
            else 'Which plan is charged once the trial is over?' end
       when o_orderkey % 4 = 2 then case cast(floor(o_orderkey / 4) as bigint) % 3
            when 0 then 'Item damaged on arrival, I would like to return order #' || cast(100000 + o_orderkey as varchar(20)) || '.'
            when 1 then 'A return label and a replacement are needed for parcel ' || cast(o_custkey as varchar(20)) || '.'
            else 'Delivery problem: the parcel was not received here.' end
       else case cast(floor(o_orderkey / 4) as bigint) % 3
            when 0 then 'UNACCEPTABLE service, the bank has been told to start a chargeback.'
            when 1 then 'Contacted ' || cast(2 + o_custkey % 5 as varchar(20)) || ' times in a week and each answer was useless.'
            else 'My mails are ignored, a lawyer will sue over ticket ' || cast(o_orderkey as varchar(20)) || '.' end
  end as text
from orders""",
    "responses_v": """
select o_orderkey as ticket_id,
  case o_orderkey % 8
    when 0 then 'I understand your concern. I have arranged a replacement and you can check the status of it in your account. Please try to restart the device first and update the firmware.'
    when 1 then 'I am sorry. I will refund order #' || cast(200000 + o_orderkey as varchar(20)) || ' to your card 4532 0151 1283 0366 today, which should show in your account within five business days.'
    when 2 then 'Please contact our team.'
    when 3 then 'As discussed previously, no charge was made, so there is nothing to refund on this account, and we will close the case now unless you reply to us by mail.'
    when 4 then 'Write to agent' || cast(o_custkey as varchar(20)) || '@example.com or call 555-867-5309 and we will ship a return label for the exchange to you as soon as we can, thank you for your patience.'
    when 5 then 'That is a stupid question and it is really not my problem at all, but you can always read the manual again and try each of the steps in it one after another.'
    when 6 then ''
    else 'I apologise for this. I have escalated your case to a senior specialist with priority, your reference id is 123-45-6789 and your password: hunter2 was reset on 2024-01-31.' end as response
from orders""",
    "predictions_v": """
select o_orderkey as ticket_id,
  case when (o_orderkey * 7919) % 100 < 72 then 'resolved' else 'escalate' end as control_pred,
  case when o_orderkey % 4 = 3 and (o_orderkey * 104729) % 1000 < 990 then 'escalate'
       when (o_orderkey * 104729) % 100 < 93 then 'resolved' else 'escalate' end as treatment_pred,
  cast(50 + (o_orderkey * 31) % 200 as double) as latency_ms
from orders""",
    "traces_v": """
select event_id as trace_id, ts, user_id as customer_id,
  case event_type when 'click' then 'technical' when 'purchase' then 'billing' when 'view' then 'returns' when 'error' then 'escalation' else 'unknown' end as domain,
  case when event_id % 9 = 0 then 'keyword' else 'semantic' end as routing_method,
  cast(regexp_extract(props, '[0-9]+', 0) as double) / 100.0 as routing_confidence,
  event_type = 'error' as escalation_detected,
  cast((event_id * 13) % 100 as double) / 100.0 as escalation_score,
  event_id % 7 <> 0 as cache_hit, event_id % 11 = 0 as unsupported_flagged,
  cast(5 + event_id % 15 as double) as router_ms, cast(event_id % 10 as double) as lora_load_ms,
  value as generation_ms, cast(1 + event_id % 6 as double) as safety_ms
from events""",
    # tickets cleaned of blank rows with a label in the allowed set
    "clean_v": """
select ticket_id, customer_id, ts, domain, text,
  case when lower(trim(label)) in ('resolved', 'escalate') then lower(trim(label)) else 'resolved' end as label
from tickets_v where length(trim(text)) > 0""",
    # predictions with their ground truth
    "graded_v": """
select t.ticket_id, t.domain, t.label, t.text, p.control_pred, p.treatment_pred, p.latency_ms, r.response
from clean_v t join predictions_v p on p.ticket_id = t.ticket_id
join responses_v r on r.ticket_id = t.ticket_id""",
    # vectors as doubles with a domain derived from the class label
    "vectors_v": """
select vec_id, label as class_id, cast(embedding as DOUBLE_ARRAY) as v,
  case label % 4 when 0 then 'technical' when 1 then 'billing' when 2 then 'returns' else 'escalation' end as domain
from embeddings""",
    # every cleaned ticket with the vector its key points at
    "ticket_vectors_v": """
select t.ticket_id, t.domain, t.label, t.text, e.v
from (select *, ticket_id % (select count(*) from embeddings) as vec_ref from clean_v) t
join vectors_v e on e.vec_id = t.vec_ref""",
    # vectors mixed with those of the next key: a "current" state to compare with the base
    "current_vectors_v": """
select a.vec_id, a.domain, a.v as base_v, b.v as next_v,
  case when a.vec_id % 5 = 0 then 0.5 else 0.1 end as mix
from (select *, (vec_id + 1) % (select count(*) from embeddings) as next_ref from vectors_v) a
join vectors_v b on b.vec_id = a.next_ref""",
    # one checkpoint per supplier and step
    "checkpoints_v": """
select case l_suppkey % 4 when 0 then 'technical' when 1 then 'billing' when 2 then 'returns' else 'escalation' end as domain,
  l_suppkey * 10 + l_linenumber as checkpoint_id, l_linenumber as step,
  case when l_suppkey % 50 = 7 then null else round(avg(l_discount), 6) end as eval_loss,
  round(avg(l_tax), 6) as eval_accuracy
from lineitem group by l_suppkey, l_linenumber""",
    # one measured run per part
    "points_v": """
select p_partkey as point_id,
  case p_partkey % 4 when 0 then 'technical' when 1 then 'billing' when 2 then 'returns' else 'escalation' end
    || '_r' || cast(8 * (1 + p_size % 8) as varchar(20)) || '_lr2e-04' as run_name,
  round(0.5 + p_size / 104.0 + (p_partkey * 37 % 1000) / 50000.0, 6) as accuracy,
  round(40.0 + p_retailprice / 10.0, 6) as latency_ms,
  round(0.02 + (p_partkey * 7 % 100) / 400.0, 6) as cost_per_ticket
from part""",
    # one finished hyper-parameter run per part
    "sweep_v": """
select p_partkey as run_id, 8 * (1 + p_size % 4) as lora_r,
  case p_partkey % 3 when 0 then 0.00005 when 1 then 0.0001 else 0.0002 end as learning_rate,
  round(0.4 + (p_partkey * 37 % 997) / 1000.0 + p_size / 500.0, 6) as eval_loss,
  case when p_partkey % 23 = 0 then 'failed' end as error
from part""",
    # alert metrics per hour of the trace stream
    "hourly_v": """
select date_trunc('hour', ts) as ts,
  round(1.0 - avg(case when escalation_detected then 1.0 else 0.0 end), 6) as auto_resolution_rate,
  round(avg(case when unsupported_flagged then 1.0 else 0.0 end), 6) as unsupported_rate,
  round(avg(case when cache_hit then 1.0 else 0.0 end), 6) as cache_hit_rate,
  round(max(generation_ms), 6) as p95_ms,
  round(avg(case when unsupported_flagged and not escalation_detected then 1.0 else 0.0 end), 6) as false_negative_rate,
  case when avg(routing_confidence) < 0.48 then 1.0 else 0.0 end as drift_detected,
  round(abs(avg(routing_confidence) - 0.5) * 4, 6) as kl_divergence,
  case when avg(routing_confidence) < 0.48 then 'billing' else '' end as drifted_domains
from traces_v group by date_trunc('hour', ts)""",
    # candidate replies, eight per ticket group
    "candidates_v": """
select cast(floor(r.ticket_id / 8) as bigint) as ticket_id, r.ticket_id % 8 as pos, r.response,
  case cast(floor(r.ticket_id / 8) as bigint) % 4 when 0 then 'technical' when 1 then 'billing' when 2 then 'returns' else 'escalation' end as domain
from responses_v r""",
}

_DEPENDS = re.compile(r"\b([a-z_]+_v)\b")


def needed_views(sql: str) -> list[str]:
    """View names used by a SQL text, dependencies first."""
    found: list[str] = []

    def visit(text):
        for name in _DEPENDS.findall(text):
            if name in VIEW_SQL and name not in found:
                visit(VIEW_SQL[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _with_clause(sql: str, array_type: str) -> str:
    names = needed_views(sql)
    if not names:
        return sql
    body = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in names)
    rest = sql.lstrip()
    if rest[:15].lower() == "with recursive ":
        text = f"with recursive {body},\n{rest[15:]}"
    elif rest[:5].lower() == "with ":
        text = f"with {body},\n{rest[5:]}"
    else:
        text = f"with {body}\n{rest}"
    return text.replace("DOUBLE_ARRAY", array_type)


def reference_sql(sql: str) -> str:
    """Complete reference SQL text: the needed views as CTEs, then the query."""
    return _with_clause(sql, "double[]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **replace: DataFrame) -> DataFrame:
    """A view of this module as a DataFrame over the tables in sf_dir.

    A table can be replaced by a DataFrame of the same columns, for example a stream.
    """
    text = _with_clause(f"select * from {name}", "array<double>")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(
        text, **{t: replace[t] if t in replace else table(spark, sf_dir, t) for t in used})


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(
        sf_dir)
