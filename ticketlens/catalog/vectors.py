"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.catalog.base import query
from ticketlens.functions import vectors as vx
from ticketlens.operators import vectors as op
from ticketlens.plans.views import view


def V():
    return F.col("v")


def _pairs(spark, sf):
    base = view(spark, sf, "vectors_v").select("vec_id", "v")
    after = base.select((F.col("vec_id") - 1).alias("vec_id"), V().alias("w"))
    return base.join(after, "vec_id")


@query("v1_dot_norm_cosine", """
select a.vec_id, round(list_dot_product(a.v, b.v), 6) as dot,
  round(sqrt(list_dot_product(a.v, a.v)), 6) as norm,
  round(list_cosine_similarity(a.v, b.v), 6) as cosine
from vectors_v a join vectors_v b on b.vec_id = a.vec_id + 1""")
def v1(spark, sf):
    w = F.col("w")
    return _pairs(spark, sf).select(
        "vec_id", F.round(vx.dot(V(), w), 6).alias("dot"), F.round(vx.l2_norm(V()), 6).alias("norm"),
        F.round(vx.cosine(V(), w), 6).alias("cosine"))


@query("v2_l2_normalise", """
select vec_id, round(v[1] * 3 / (sqrt(list_dot_product(v, v)) * 3), 6) as first_value,
  round(v[64] * 3 / (sqrt(list_dot_product(v, v)) * 3), 6) as last_value from vectors_v""")
def v2(spark, sf):
    unit = vx.l2_normalise(F.transform(V(), lambda x: x * 3.0))
    return view(spark, sf, "vectors_v").select("vec_id", unit.alias("u")).select(
        "vec_id", F.round(F.element_at("u", 1), 6).alias("first_value"),
        F.round(F.element_at("u", -1), 6).alias("last_value"))


_MEANS = """
x as (select domain, unnest(v) as val, unnest(range(1, 65)) as pos from vectors_v),
m as (select domain, pos, avg(val) as val from x group by domain, pos),
n as (select domain, sqrt(sum(val * val)) + 1e-9 as norm from m group by domain),
protos as (select m.domain, list(val / norm order by pos) as proto from m join n on n.domain = m.domain group by m.domain)"""


@query("v3_prototypes", f"""
with {_MEANS}
select domain, pos, round(val, 6) as value from (select domain, unnest(proto) as val, unnest(range(1, 65)) as pos from protos)""")
def v3(spark, sf):
    protos = op.prototypes(view(spark, sf, "vectors_v"))
    return protos.select("domain", F.posexplode("prototype").alias("pos", "value")).select(
        "domain", (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.round("value", 6).alias("value"))


@query("v4_encode_text", "select ticket_id, 256::bigint as dim, 1.0::double as norm from clean_v")
def v4(spark, sf):
    out = op.encode(view(spark, sf, "clean_v").select("ticket_id", "text"))
    return out.select("ticket_id", F.size("v").cast("bigint").alias("dim"),
                      F.round(vx.l2_norm(V()), 6).alias("norm"))


_NEAR = """
near as (select q.vec_id as query_id, t.vec_id as train_id, t.class_id as label,
    list_dot_product(q.v, t.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v))) as sim
  from vectors_v q join vectors_v t on t.vec_id <> q.vec_id),
top as (select * from near qualify row_number() over (partition by query_id order by sim desc, train_id) <= 5)"""


@query("v5_knn_classify", f"""
with {_NEAR},
classes as (select distinct class_id as label from vectors_v),
means as (select query_id, label, avg(sim) as m from top group by query_id, label),
grid as (select q.query_id, c.label, coalesce(m.m, 0) as m
  from (select distinct query_id from top) q, classes c
  left join means m on m.query_id = q.query_id and m.label = c.label),
soft as (select *, exp((m - max(m) over (partition by query_id)) / 0.1) as e from grid)
select query_id, cast(label as varchar) as label, round(m, 6) as mean_sim,
  round(e / sum(e) over (partition by query_id), 6) as prob,
  first_value(cast(label as varchar)) over (partition by query_id order by e desc, cast(label as varchar)) as predicted
from soft""")
def v5(spark, sf):
    vectors = view(spark, sf, "vectors_v").withColumn("fold", F.col("vec_id"))
    out = op.knn_classify(vectors, vectors, label="class_id", fold="fold")
    return out.select("query_id", "label", F.round("mean_sim", 6).alias("mean_sim"),
                      F.round("prob", 6).alias("prob"), "predicted")


def _sets(spark, sf):
    """Vector sets named by class, keys shared between the classes."""
    return view(spark, sf, "vectors_v").select(
        F.concat(F.lit("set"), F.col("class_id").cast("string")).alias("vec_set"),
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("key"), V().alias("values"))


_SETS = """
one as (select 'set' || cast(class_id as varchar) as vec_set, cast(floor(vec_id / 10) as bigint) as key, v as val, vec_id from vectors_v),
sets as (select vec_set, key, unnest(val) as x, unnest(range(1, 65)) as pos, vec_id from one)"""


@query("v6_blend_vectors", f"""
with {_SETS}
select key, pos, round(sum(x * case vec_set when 'set0' then 0.7 else 0.3 end::double), 6) as x from sets
where vec_set in ('set0', 'set1') and key in (select key from one where vec_set = 'set0')
group by key, pos""")
def v6(spark, sf):
    out = op.blend_vectors(_sets(spark, sf), {"set0": 0.7, "set1": 0.3})
    return out.select("key", F.posexplode("values").alias("pos", "x")).select(
        "key", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("v7_vector_arithmetic", f"""
with {_SETS}
select key, pos, round(sum(x * case vec_set when 'set0' then 1.0 when 'set1' then 0.5 else -0.5 end::double), 6) as x
from sets where vec_set in ('set0', 'set1', 'set2') and key in (select key from one where vec_set = 'set0')
group by key, pos""")
def v7(spark, sf):
    out = op.vector_arithmetic(_sets(spark, sf), "set0", ["set1"], ["set2"])
    return out.select("key", F.posexplode("values").alias("pos", "x")).select(
        "key", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_INTERFERENCE = """
inter as (select round(coalesce(1 - avg(list_cosine_similarity(a.val, b.val)), 1.0::double), 4) as interference,
  count(*) as n_keys from one a join one b on a.key = b.key and a.vec_set = 'set0' and b.vec_set = 'set1')"""


@query("v8_interference", f"with {_SETS}, {_INTERFERENCE} select * from inter")
def v8(spark, sf):
    return op.interference(_sets(spark, sf), "set0", "set1")


@query("v9_ablation", f"""
with {_SETS}, {_INTERFERENCE},
a as (select avg((control_pred = label)::int) as p, avg((treatment_pred = label)::int) as s,
  avg((case when ticket_id % 2 = 0 then control_pred else treatment_pred end = label)::int) as c, count(*) as n from graded_v)
select round(p, 6) as primary_accuracy, round(s, 6) as secondary_accuracy, round(c, 6) as composed_accuracy,
  n, interference, round(c - greatest(p, s), 6) as composition_benefit from a, inter""")
def v9(spark, sf):
    preds = view(spark, sf, "graded_v").select(
        "label", F.col("control_pred").alias("primary_pred"),
        F.col("treatment_pred").alias("secondary_pred"),
        F.when(F.col("ticket_id") % 2 == 0, F.col("control_pred"))
        .otherwise(F.col("treatment_pred")).alias("composed_pred"))
    out = op.ablation(preds, op.interference(_sets(spark, sf), "set0", "set1"))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("accuracy", "benefit")) else c
                        for c in out.columns])
