"""Queries of the streaming forms, the file sources and the SQL functions.

A stream query drains the table as a file stream into a fresh folder and reads the result back;
its reference SQL is that of the batch operator, since both must agree.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.catalog import monitoring as mon
from ticketlens.catalog.base import query
from ticketlens.catalog.routing import _PROBS, _protos
from ticketlens.functions import sqlfuncs
from ticketlens.functions import sqltext as sq
from ticketlens.operators import routing
from ticketlens.plans.scale import new_path
from ticketlens.plans.views import table, table_stream, view
from ticketlens.sources import stores, tickets
from ticketlens.streaming import monitors as st


def _traces(spark, sf):
    return view(spark, sf, "traces_v", events=table_stream(spark, sf, "events"))


def _drained(spark, start, read=st.latest_version):
    path = new_path(spark, "stream")
    start(path).awaitTermination()
    return read(spark, path)


@query("w1_stream_trace_counters", f"""
select 'requests' as metric, domain as label_1, case when escalation_detected then 'escalated' else 'resolved' end as label_2,
  null::varchar as label_3, count(*)::double as value from traces_v group by all
union all select 'routing', domain, routing_method, (routing_confidence >= 0.7)::varchar, count(*) from traces_v group by all
union all select 'cache', cache_hit::varchar, null, null, count(*) from traces_v group by all
union all select 'unsupported', domain, unsupported_flagged::varchar, null, count(*) from traces_v group by all
union all select 'cost', domain, null, null, round(sum({mon._COST}), 6) from traces_v group by all
union all select 'escalations', case when escalation_score > 0.5 then 'keyword' else 'model' end, null, null, count(*)
  from traces_v where escalation_detected group by all""")
def w1_stream(spark, sf):
    out = _drained(spark, lambda p: st.counters_stream(_traces(spark, sf), p))
    return mon._rounded(out, "value")


@query("w4_stream_rolling_resolution", """
with x as (select time_bucket(interval 5 minutes, ts) - to_minutes(5 * k) as window_start, domain, escalation_detected
  from traces_v, (select unnest(range(0, 12)) as k))
select window_start, domain, round(avg((not escalation_detected)::int), 6) as auto_resolution_rate, count(*) as n
from x group by window_start, domain""")
def w4_stream(spark, sf):
    out = _drained(spark, lambda p: st.rolling_resolution_stream(_traces(spark, sf), p))
    return mon._rounded(out.withColumn("window_start", F.col("window_start")
                                       .cast("timestamp_ntz")), "auto_resolution_rate")


@query("w3_w5_stream_series", """
select time_bucket(interval 1 hour, ts) as bucket, count(*) as n, round(avg(escalation_detected::int), 6) as escalation_rate,
  round(avg(cache_hit::int), 6) as cache_hit_rate from traces_v group by bucket""")
def w5_stream(spark, sf):
    out = _drained(spark, lambda p: st.series_stream(_traces(spark, sf), p))
    return mon._rounded(out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n",
                                   "escalation_rate", "cache_hit_rate"),
                        "escalation_rate", "cache_hit_rate")


@query("d9_stream_rolling_probe", """
with r as (select trace_id, domain, row_number() over (partition by domain order by ts desc, trace_id desc) as r from traces_v)
select trace_id, domain from r where r <= 50""")
def d9_stream(spark, sf):
    out = _drained(spark, lambda p: st.rolling_probe_stream(_traces(spark, sf), p, 50))
    return out.select("trace_id", "domain")


@query("d10_stream_drift_check", f"""
with {mon._CHECK} select window_start, n_domains, n_probes, round(min_mean_sim, 6) as min_mean_sim, drifted_domains,
  round(kl, 6) as kl_divergence, (drifted_domains <> '' or kl > 0.15) as drift_detected from ck""")
def d10_stream(spark, sf):
    sims = mon._pairs(spark, sf).select(F.col("vec_id").alias("ref"), "sim")
    n = table(spark, sf, "embeddings").count()
    probes = _traces(spark, sf).withColumn("ref", F.col("trace_id") % n).join(sims, "ref").select(
        "ts", "domain", "sim")
    out = _drained(spark, lambda p: st.drift_check_stream(probes, p, "6 hours"))
    return mon._rounded(out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_domains", "n_probes",
        "min_mean_sim", F.array_join("drifted_domains", ",").alias("drifted_domains"),
        "kl_divergence", "drift_detected"), "min_mean_sim", "kl_divergence")


@query("w8_w10_stream_alerts", f"with {mon._EVALUATED} select rule_name, level, ts from ev where breach")
def w8_stream(spark, sf):
    source = new_path(spark, "snapshots")
    snapshots = view(spark, sf, "hourly_v").withColumn("ts", F.col("ts").cast("timestamp"))
    snapshots.write.parquet(source)
    stream = spark.readStream.schema(snapshots.schema).parquet(source)
    path = new_path(spark, "alerts")
    st.dispatch_alerts(st.alert_stream(stream), path).awaitTermination()
    out = spark.read.schema("rule_name string, level string, ts timestamp, message string").json(
        f"{path}/data")
    return out.select("rule_name", "level", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("r18_stream_repeated_contact", """
select trace_id, count(*) over w as n_contacts, count(*) over w >= 3 as repeated_contact
from traces_v window w as (partition by customer_id order by ts
  range between interval 48 hours preceding and current row)""")
def r18_stream(spark, sf):
    counted = st.repeated_contact_stream(_traces(spark, sf))
    return _drained(spark, lambda p: st.append_files(counted, p),
                    lambda s, p: s.read.parquet(f"{p}/data"))


@query("r19_stream_process_tickets", f"""
with {_PROBS} select ticket_id, primary_domain, primary_score, method as routing_method from routed""")
def r19_stream(spark, sf):
    orders = table_stream(spark, sf, "orders")
    rows = view(spark, sf, "ticket_vectors_v", orders=orders)
    reply = F.concat(F.lit("I will check this for you. "), F.col("text"))
    done = routing.process_tickets(rows.withColumn("response", reply), _protos(spark, sf))
    done = done.select("ticket_id", "primary_domain", "primary_score", "routing_method", "status",
                       "final_response")
    out = _drained(spark, lambda p: st.append_files(done, p),
                   lambda s, p: s.read.parquet(f"{p}/data"))
    return out.select("ticket_id", "primary_domain", "primary_score", "routing_method")


_CLEAN = f"""
select ticket_id, {sq.strip('text')} as text, lower({sq.strip('domain')}) as domain,
  case when lower({sq.strip('label')}) in ('resolved', 'escalate') then lower({sq.strip('label')}) else 'resolved' end as label
from tickets_v where length({sq.strip('text')}) > 0"""


@query("s1_csv_scan", _CLEAN)
def s1(spark, sf):
    path = new_path(spark, "csv")
    raw = view(spark, sf, "tickets_v").select(
        "ticket_id", F.col("text").alias(" Body"), F.col("domain").alias("Domain "), "label")
    raw.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = tickets.read_tickets_csv(spark, path, "body")
    return out.select(F.col("ticket_id").cast("bigint").alias("ticket_id"), "text", "domain",
                      "label")


@query("s2_jsonl_scan", _CLEAN)
def s2(spark, sf):
    path = new_path(spark, "jsonl")
    view(spark, sf, "tickets_v").select("ticket_id", "text", "domain", "label").write.json(path)
    return tickets.read_tickets_jsonl(spark, path)[0].select("ticket_id", "text", "domain",
                                                             "label")


@query("s3_s4_s9_split_store", """
select ticket_id, domain, label, text, case when ticket_id % 10 = 0 then 'test' else 'train' end as split
from clean_v""")
def s3(spark, sf):
    path = new_path(spark, "splits")
    rows = view(spark, sf, "clean_v").select("ticket_id", "text", "domain", "label").withColumn(
        "split", F.when(F.col("ticket_id") % 10 == 0, "test").otherwise("train"))
    tickets.write_splits(rows, path)
    return tickets.read_all_domains(spark, path).select(
        "ticket_id", "domain", "label", "text", "split")


@query("s8_sweep_scan", """
select 'run-' || cast(run_id as varchar) as run_name, lora_r::int as lora_r, eval_loss::double as eval_loss from sweep_v where error is null""")
def s8(spark, sf):
    path = new_path(spark, "sweep")
    view(spark, sf, "sweep_v").select(
        F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("run_name"), "lora_r",
        F.create_map(F.lit("eval_loss"), F.col("eval_loss").cast("double")).alias("metrics"),
        "error").write.json(path)
    return stores.read_sweep(spark, path).select("run_name", "lora_r", "eval_loss")


@query("s12_registry_store", """
select domain, checkpoint_id, step, eval_loss::double as eval_loss from checkpoints_v""")
def s12(spark, sf):
    path = new_path(spark, "registry")
    stores.save_registry(view(spark, sf, "checkpoints_v"), path)
    return stores.load_registry(spark, path).select(
        "domain", "checkpoint_id", "step", F.col("eval_loss").cast("double").alias("eval_loss"))


@query("s13_s14_report_store", """
select domain, count(*) as n, round(avg(latency_ms), 6) as mean_ms from graded_v group by domain""")
def s13(spark, sf):
    path = new_path(spark, "report")
    report = view(spark, sf, "graded_v").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
    stores.write_report(report.select("domain", F.struct("n", "mean_ms").alias("latency")), path)
    return stores.read_report(
        spark, path, "domain string, latency struct<n:bigint,mean_ms:double>").select(
        "domain", "latency.n", "latency.mean_ms")


@query("s15_prototype_store", "select domain, count(*) as n, 0.1::double as temperature, 0.7::double as threshold from vectors_v group by domain")
def s15(spark, sf):
    from ticketlens.operators.vectors import prototypes

    path = new_path(spark, "prototypes")
    stores.save_prototypes(prototypes(view(spark, sf, "vectors_v")), path, 0.1, 0.7)
    return stores.load_prototypes(spark, path).select("domain", "n", "temperature", "threshold")


@query("sql_functions", f"""
select ticket_id, {sq.escalation_score('text')} as escalation, {sq.keyword_domain('text')} as keyword_domain,
  {sq.response_score('response', 'domain')} as response_score, round({sq.tone_score('response')}, 6) as tone,
  {sq.scrub_pii('response')} as scrubbed, {sq.unsupported_score('text', 'response')} as unsupported from graded_v""")
def sql_functions(spark, sf):
    sqlfuncs.register(spark)
    return spark.sql(
        "select ticket_id, escalation_score(text) as escalation, keyword_domain(text) as "
        "keyword_domain, response_score(response, domain) as response_score, "
        "round(tone_score(response), 6) as tone, scrub_pii(response) as scrubbed, "
        "unsupported_score(text, response) as unsupported from {graded}",
        graded=view(spark, sf, "graded_v"))


@query("s3_domain_splits", """
select split, count(*) as n from (
  select case when ticket_id % 7 = 0 then 'val' when ticket_id % 7 = 1 then 'test' else 'train' end as split
  from clean_v where domain = 'billing') group by split""")
def s3(spark, sf):
    path = new_path(spark, "domain-splits")
    part = F.when(F.col("ticket_id") % 7 == 0, "val").when(F.col("ticket_id") % 7 == 1, "test").otherwise("train")
    tickets.write_splits(view(spark, sf, "clean_v").select("ticket_id", "text", "domain", "label", part.alias("split")), path)
    return tickets.read_domain_splits(spark, path, "billing").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s6_seed_scan", """
select domain, count(*) as n, 'seed' as source, sum(length(text)) as chars from clean_v group by domain""")
def s6(spark, sf):
    # seed objects of some thousand tickets, each read by several tasks
    path = new_path(spark, "seeds")
    tickets_v = view(spark, sf, "clean_v")
    parts = max(1, math.ceil(tickets_v.count() / 4000))
    rows = tickets_v.select("domain", F.pmod("ticket_id", F.lit(parts)).alias("part"), F.struct("text", "label").alias("r"))
    lists = rows.groupBy("domain", "part").agg(F.collect_list("r").alias("rs"))
    whole = lists.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("domain", "rs"))).alias("m"))
    whole.select(F.to_json("m").alias("value")).repartition(parts).write.option("maxRecordsPerFile", 1).text(path)
    return tickets.read_seed_json(spark, path, size=1 << 16).groupBy("domain", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s2_rejected_lines", """
with x as (select ticket_id, ticket_id // 4000 as part, row_number() over (partition by ticket_id // 4000 order by ticket_id) as line_no from clean_v)
select part, line_no, '{"ticket_id": ' || ticket_id || ', "text": ' as line from x where ticket_id % 50 = 3""")
def s2_rejects(spark, sf):
    path = new_path(spark, "jsonl")
    rows = view(spark, sf, "clean_v").select("ticket_id", "text", "domain", "label")
    broken = F.concat(F.lit('{"ticket_id": '), F.col("ticket_id").cast("string"), F.lit(', "text": '))
    lines = rows.select(F.floor(F.col("ticket_id") / 4000).alias("part"), "ticket_id", F.when(
        F.col("ticket_id") % 50 == 3, broken).otherwise(F.to_json(F.struct("*"))).alias("value"))
    # a file per part, its lines in order
    lines.repartition("part").sortWithinPartitions("part", "ticket_id").drop("ticket_id").write.partitionBy("part").text(path)
    rejects = tickets.read_tickets_jsonl(spark, path)[1]
    return rejects.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"), "line_no", "line")


_STORED = "select 'written' as part, count(*) as n from clean_v union all select 'read', count(*) from clean_v"


@query("s10_example_store", _STORED)
def s10(spark, sf):
    return _store_counts(spark, view(spark, sf, "clean_v").select("text", "domain", "label"),
                         "text string, domain string, label string")


@query("s11_pair_store", _STORED)
def s11(spark, sf):
    pairs = view(spark, sf, "clean_v").select(
        F.col("text").alias("prompt"), F.col("domain").alias("chosen"), F.col("label").alias("rejected"))
    return _store_counts(spark, pairs, "prompt string, chosen string, rejected string")


def _store_counts(spark, rows, schema):
    """Rows written and rows that a plain count of the loaded store gives."""
    path = new_path(spark, "examples")
    tickets.save_examples(rows, path)
    loaded = tickets.load_examples(spark, path, T.StructType.fromDDL(schema))
    counted = spark.range(1).select(F.lit("read").alias("part"), F.lit(loaded.count()).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written").alias("part"), "n").union(counted)
