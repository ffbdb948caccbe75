"""Queries of the quality gates and duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog import learning
from ticketlens.catalog.base import query
from ticketlens.functions import text as tx
from ticketlens.operators import neardup, quality as op
from ticketlens.plans.views import table, view


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("q1_length_bounds", """
select doc_id from documents where length(text) between 10 and 2000""")
def q1(spark, sf):
    return op.length_bounds(_docs(spark, sf)).select("doc_id")


_FENCE = """
f as (select domain, quantile_cont(length(text), 0.25) as q1, quantile_cont(length(text), 0.75) as q3
      from tickets_v group by domain)"""


@query("q2_iqr_fence", f"""
with {_FENCE}
select ticket_id, t.domain from tickets_v t join f on f.domain = t.domain
where length(text) between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""")
def q2(spark, sf):
    return op.iqr_fence(view(spark, sf, "tickets_v"), ["domain"]).select("ticket_id", "domain")


@query("q2_iqr_fence_documents", """
with f as (select lang, quantile_cont(length(text), 0.25) as q1, quantile_cont(length(text), 0.75) as q3
  from documents group by lang)
select f.lang, round(q1 - 1.5 * (q3 - q1), 6) as fence_lo, round(q3 + 1.5 * (q3 - q1), 6) as fence_hi
from f""")
def q2_docs(spark, sf):
    limits = op.iqr_limits(_docs(spark, sf), ["lang"])
    return limits.select("lang", F.round("fence_lo", 6).alias("fence_lo"),
                         F.round("fence_hi", 6).alias("fence_hi"))


@query("q3_filter_outliers", f"""
with {_FENCE},
g as (select t.domain, length(text) not between 10 and 2000 as b,
  length(text) not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as o
  from tickets_v t join f on f.domain = t.domain)
select domain, count(*) filter (where b) as n_bounds, count(*) filter (where o) as n_fence,
  count(*) as n_flagged from g where b or o group by domain""")
def q3(spark, sf):
    _, flagged = op.filter_outliers(view(spark, sf, "tickets_v"))
    return flagged.groupBy("domain").agg(
        F.count_if("fails_bounds").alias("n_bounds"), F.count_if("fails_fence").alias("n_fence"),
        F.count(F.lit(1)).alias("n_flagged"))


@query("q4_drop_exact_duplicates", """
select min(doc_id) as doc_id, text from documents group by text""")
def q4(spark, sf):
    return op.drop_exact_duplicates(_docs(spark, sf), "doc_id").select("doc_id", "text")


@query("q4_drop_exact_duplicate_tickets", """
select min(ticket_id) as ticket_id, text from tickets_v group by text""")
def q4_tickets(spark, sf):
    return op.drop_exact_duplicates(view(spark, sf, "tickets_v")).select("ticket_id", "text")


_GRAMS = """
g as materialized (select distinct doc_id, substr(lower(text), i, 3) as gram
      from (select doc_id, text, unnest(range(1, length(text) - 1)) as i from documents
            where length(text) >= 3))"""


@query("q5_trigrams", f"""
with {_GRAMS}
select doc_id, count(*) as n_grams, min(gram) as first_gram, max(gram) as last_gram
from g group by doc_id""")
def q5(spark, sf):
    grams = _docs(spark, sf).select("doc_id", tx.trigrams(F.col("text")).alias("g"))
    return grams.where(F.size("g") > 0).select(
        "doc_id", F.size("g").cast("bigint").alias("n_grams"),
        F.array_min("g").alias("first_gram"), F.array_max("g").alias("last_gram"))


@query("q6_jaccard", """
with p as (select a.doc_id as doc_id, a.text as ta, b.text as tb
  from documents a join documents b on b.doc_id = a.doc_id + 1),
g as (select doc_id,
  list_distinct(list_transform(range(1, length(ta) - 1), lambda i: substr(lower(ta), i, 3))) as ga,
  list_distinct(list_transform(range(1, length(tb) - 1), lambda i: substr(lower(tb), i, 3))) as gb from p)
select doc_id, case when len(ga) = 0 or len(gb) = 0 then 0.0::double else
  round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::double, 6) end as sim
from g""")
def q6(spark, sf):
    # texts move, and the trigrams of a pair are built where it is compared
    docs = _docs(spark, sf).select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").select(
        "doc_id", F.round(tx.jaccard(F.col("text"), F.col("next")), 6).alias("sim"))


# brute force over all distinct trigram sets: shared trigrams counted by an equi-join
_PAIRS = f"""{_GRAMS},
s as (select doc_id, count(*) as n, md5(string_agg(gram, chr(1) order by gram)) as h from g group by doc_id),
r as (select h, min(doc_id) as rep, any_value(n) as n from s group by h),
rg as (select g.doc_id as rep, g.gram, r.n from g join r on r.rep = g.doc_id),
o as (select a.rep as ra, b.rep as rb, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
      from rg a join rg b on a.gram = b.gram and a.rep < b.rep
        and a.n >= 0.95 * b.n and b.n >= 0.95 * a.n group by 1, 2),
pairs as materialized (select ra, rb, c / (na + nb - c)::double as sim from o where c / (na + nb - c)::double >= 0.95 - 1e-9)"""


@query("q7_near_duplicate_pairs", f"""
with {_PAIRS}
select ra as id_a, rb as id_b, round(sim, 6) as sim from pairs
union all select r.rep, s.doc_id, 1.0::double from s join r on r.h = s.h where s.doc_id <> r.rep""")
def q7(spark, sf):
    pairs = neardup.near_duplicate_pairs(_docs(spark, sf), key="doc_id")
    return pairs.withColumn("sim", F.round("sim", 6))


# greedy in key order: one recursion step per set that has a smaller similar set
_GREEDY = """
late as materialized (select rb as node, list(ra) as before, row_number() over (order by rb) as step
         from pairs group by rb),
walk as (select 0::bigint as step, []::bigint[] as gone
  union all
  select w.step + 1, case when len(list_filter(l.before, lambda x: not list_contains(w.gone, x))) > 0
      then list_append(w.gone, l.node) else w.gone end
  from walk w join late l on l.step = w.step + 1),
gone as (select unnest(gone) as rep from (select gone from walk order by step desc limit 1))"""


@query("q8_drop_near_duplicates", f"""
with recursive {_PAIRS}, {_GREEDY}
select d.doc_id from documents d left join s on s.doc_id = d.doc_id left join r on r.h = s.h
where s.doc_id is null or (s.doc_id = r.rep and r.rep not in (select rep from gone))""")
def q8(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    return neardup.drop_near_duplicates(docs, key="doc_id").select("doc_id")


_GATED_DOCS = """
f as (select source, quantile_cont(length(text), 0.25) as q1, quantile_cont(length(text), 0.75) as q3
  from documents group by source),
outl as (select d.doc_id, d.source, d.text, (length(text) not between 10 and 2000
    or length(text) not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as is_out
  from documents d join f on f.source = d.source),
firsts as (select min(doc_id) as doc_id, text from outl where not is_out group by text),
g as materialized (select distinct doc_id, substr(lower(text), i, 3) as gram
      from (select doc_id, text, unnest(range(1, length(text) - 1)) as i from firsts where length(text) >= 3))"""
_GATED_PAIRS = _PAIRS.replace(_GRAMS, _GATED_DOCS)
_GATED = f"""{_GATED_PAIRS}, {_GREEDY},
gated as (select o.doc_id, o.source, case when is_out then 'outlier'
    when fi.doc_id is null then 'exact_duplicate'
    when s.doc_id is not null and (s.doc_id <> r.rep or r.rep in (select rep from gone)) then 'near_duplicate'
    when o.doc_id in (select doc_id from labels where toxic = 1) then 'label_noise' end as reason
  from outl o left join firsts fi on fi.doc_id = o.doc_id
  left join s on s.doc_id = o.doc_id left join r on r.h = s.h)"""


def _gated(spark, sf):
    noisy = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    docs = _docs(spark, sf).select("doc_id", "source", "text")
    return op.run_quality_gates(docs, noisy, key="doc_id", by=["source"])


@query("q13_quality_gates", f"""
with recursive {_GATED} select doc_id, reason from gated""")
def q13(spark, sf):
    return _gated(spark, sf).select("doc_id", "reason")


_BEFORE_NOISE = _GATED.replace("gated as (", "gated_before as (").replace(
    "    when o.doc_id in (select doc_id from labels where toxic = 1) then 'label_noise' end as reason", "    end as reason")
_SURVIVORS = learning._OOF.replace(
    "end as label from vectors_v)", "end as label from vectors_v where vec_id in (select doc_id from gated_before where reason is null))")


@query("q13_all_gates", f"""
with recursive {_BEFORE_NOISE},{_SURVIVORS},{learning._ISSUES},
noisy as (select distinct vec_id from mg where r <= n_prune and predicted <> given)
select doc_id, coalesce(reason, case when doc_id in (select vec_id from noisy) then 'label_noise' end) as reason from gated_before""")
def q13_all(spark, sf):
    """Every document; those with an embedding of their key have its shifted label."""
    vectors = learning._noisy(spark, sf).withColumnRenamed("vec_id", "doc_id")
    docs = _docs(spark, sf).select("doc_id", "source", "text").join(vectors.select("doc_id", "label"), "doc_id", "left")
    return op.run_all_gates(docs, vectors, "doc_id", by=["source"]).select("doc_id", "reason")


_REPORT = """
select {by} as source, count(*) as n_input, count(*) filter (where reason is null) as n_output,
  count(*) filter (where reason = 'outlier') as n_outliers,
  count(*) filter (where reason in ('exact_duplicate', 'near_duplicate')) as n_duplicates,
  count(*) filter (where reason = 'label_noise') as n_noise,
  round(count(*) filter (where reason = 'label_noise') / count(*)::double, 6) as noise_rate
from gated group by {by}"""


@query("q14_quality_report", f"with recursive {_GATED} " + _REPORT.format(by="source"))
def q14(spark, sf):
    return op.quality_report(_gated(spark, sf), ["source"]).withColumn(
        "noise_rate", F.round("noise_rate", 6))


@query("q15_quality_warnings", f"""
with recursive {_GATED}, rep as ({_REPORT.format(by='source')})
select source, 'noise_rate' as warning from rep where noise_rate > 0.10
union all select source, 'too_few_rows' from rep where n_output < 500""")
def q15(spark, sf):
    report = op.quality_report(_gated(spark, sf), ["source"])
    return op.quality_warnings(report).select("source", "warning")


@query("q16_dataset_stats", """
select domain, label, count(*) as n_rows, round(avg(length(text)), 1) as len_mean,
  round(quantile_cont(length(text), 0.5), 1) as len_median,
  round(quantile_cont(length(text), 0.95), 1) as len_p95
from clean_v group by domain, label""")
def q16(spark, sf):
    return op.dataset_stats(view(spark, sf, "clean_v"), ["domain", "label"])


@query("q16_document_stats", """
select lang, count(*) as n_rows, round(avg(length(text)), 1) as len_mean,
  round(quantile_cont(length(text), 0.5), 1) as len_median,
  round(quantile_cont(length(text), 0.95), 1) as len_p95
from documents group by lang""")
def q16_docs(spark, sf):
    return op.dataset_stats(_docs(spark, sf), ["lang"])
