"""Queries of label-noise detection and text classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.functions.text import seeded_index
from ticketlens.operators import classify, noise
from ticketlens.plans.views import table, view


def _noisy(spark, sf):
    """Vectors with every tenth label shifted."""
    return view(spark, sf, "vectors_v").select(
        "vec_id", "v",
        F.when(F.col("vec_id") % 10 == 0, (F.col("class_id") + 1) % 10)
        .otherwise(F.col("class_id")).alias("label"))


_OOF = """
nl as (select vec_id, v, case when vec_id % 10 = 0 then (class_id + 1) % 10 else class_id end as label from vectors_v),
fo as (select *, (row_number() over (partition by label order by md5('42:' || cast(vec_id as varchar)), vec_id) - 1) % 5 as fold from nl),
ds as (select a.vec_id, b.label as nb, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as r
  from fo a join fo b on a.fold <> b.fold),
vt as (select vec_id, nb, count(*) / 5.0::double as share from ds where r <= 5 group by vec_id, nb),
cls as (select distinct label as c from nl),
cp as (select nl.vec_id, nl.label as given, cls.c, least(greatest(coalesce(vt.share, 0), 1e-6), 1 - 1e-6) as p
  from nl, cls left join vt on vt.vec_id = nl.vec_id and vt.nb = cls.c),
pr as materialized (select vec_id, cast(given as varchar) as given, cast(c as varchar) as class, p / sum(p) over (partition by vec_id) as prob from cp)"""


@query("q9_out_of_fold_probs", f"""
with {_OOF} select vec_id, given, class, round(prob, 6) as prob from pr""")
def q9(spark, sf):
    return noise.oof_knn_probs(_noisy(spark, sf)).withColumn("prob", F.round("prob", 6))


_ISSUES = """
th as (select class, avg(prob) as t, count(*) as n_given from pr where class = given group by class),
ab as (select pr.*, row_number() over (partition by vec_id order by round(prob, 9) desc, pr.class) as r from pr
  join th on th.class = pr.class where prob >= t - 1e-12),
ce as (select given, class, count(*) as c from ab where r = 1 group by given, class),
jo as (select ce.given, ce.class, round(c / sum(c) over (partition by ce.given)::double * n_given)::bigint as n_prune
  from ce join th on th.class = ce.given),
be as (select vec_id, arg_min(class, (-round(prob, 9), class)) as predicted, max(prob) filter (where class = given) as own from pr group by vec_id),
mg as (select pr.vec_id, pr.given, pr.class, predicted, own, n_prune, row_number() over (partition by pr.given, pr.class
    order by round(prob - own, 9) desc, md5('0:' || cast(pr.vec_id as varchar)), pr.vec_id) as r
  from pr join jo on jo.given = pr.given and jo.class = pr.class join be on be.vec_id = pr.vec_id where pr.class <> pr.given)"""


@query("q10_label_issues", f"""
with {_OOF},{_ISSUES}
select distinct vec_id, given, predicted as suggested, round(own, 6) as self_confidence from mg
where r <= n_prune and predicted <> given""")
def q10(spark, sf):
    return noise.label_issues(noise.oof_knn_probs(_noisy(spark, sf))).withColumn(
        "self_confidence", F.round("self_confidence", 6))


@query("q11_centroid_outliers", """
with nl as (select vec_id, v, case when vec_id % 10 = 0 then (class_id + 1) % 10 else class_id end as label from vectors_v),
un as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from nl),
x as (select label, unnest(u) as val, unnest(range(1, 65)) as pos from un),
m as (select label, pos, avg(val) as val from x group by label, pos),
c as (select label, list(val order by pos) as c from m group by label)
select vec_id, un.label, round(list_cosine_similarity(u, c), 6) as similarity from un join c on c.label = un.label
where list_cosine_similarity(u, c) < 0.8""")
def q11(spark, sf):
    return noise.centroid_outliers(_noisy(spark, sf)).withColumn(
        "similarity", F.round("similarity", 6))


@query("q12_noisy_keys_small_input", f"""
with {_OOF},{_ISSUES} select distinct vec_id from mg where r <= n_prune and predicted <> given""")
def q12(spark, sf):
    return noise.noisy_keys(_noisy(spark, sf))


@query("q12_small_input_passes", "select count(*) as n_rows, 0::bigint as n_noisy from region")
def q12_small(spark, sf):
    """Five rows are too few for out-of-fold neighbours, so none is called noisy."""
    rows = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("vec_id"), F.col("r_name").alias("label"), F.array(F.length("r_name").cast("double"), F.lit(1.0)).alias("v"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(noise.noisy_keys(rows).agg(F.count(F.lit(1)).alias("n_noisy")))


_TERMS = r"""
tk as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') as t from documents),
tm as (select doc_id, unnest(list_concat(t, case when len(t) > 1 then
   list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) else [] end)) as term from tk),
tf as (select doc_id, term, count(*) as tf from tm group by all),
vo as (select term, sum(tf) as total, count(*) as df from tf group by term order by total desc, term limit 50000),
w as (select doc_id, (1 + ln(tf)) * (ln((1 + (select count(*) from documents))::double / (1 + df)) + 1) as w from tf join vo on vo.term = tf.term)"""


@query("m1_tfidf", f"""
with {_TERMS} select doc_id, count(*) as n_terms, round(sum(w) / sqrt(sum(w * w)), 6) as weight_sum,
 round(max(w) / sqrt(sum(w * w)), 6) as weight_max from w group by doc_id""")
def m1(spark, sf):
    weights = classify.tfidf(table(spark, sf, "documents"), "doc_id")
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"))


def _held_out(spark, sf):
    """(training rows, held-out rows): a fifth of the tickets is held out by a hash of the key."""
    rows = view(spark, sf, "clean_v").select("ticket_id", "domain", "text")
    held_out = F.pmod(seeded_index(7, F.col("ticket_id")), F.lit(5)) == 0
    return rows.where(~held_out), rows.where(held_out)


@query("m2_m3_linear_classifier")
def m2(spark, sf):
    train, held = _held_out(spark, sf)
    model = classify.train_classifier(train, "svm", key="ticket_id")
    return model.predict_proba(held).groupBy("domain", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m2_held_out_accuracy", """
select domain, count(*) as n, true as beats_largest_class from clean_v
where ('0x' || substr(md5('7:' || cast(ticket_id as varchar)), 1, 8))::bigint % 5 = 0 group by domain""")
def m2_accuracy(spark, sf):
    """Held-out rows per domain, and whether more of them are right than the largest class has rows."""
    train, held = _held_out(spark, sf)
    model = classify.train_classifier(train, "svm", key="ticket_id")
    found = model.predict_proba(held).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("domain")).alias("right"))
    # one row per domain
    return found.join(found.agg(F.sum("right").alias("all_right"), F.max("n").alias("largest"))).select(
        "domain", "n", (F.col("all_right") > F.col("largest")).alias("beats_largest_class"))
