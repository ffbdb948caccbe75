"""Exact top-k by inner product: pivot distances bound every score, bounds decide what is read."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import table, written

PIVOTS = 24  # rows with the smallest hash of their key
K, SCALE, EVERY = 5, 256, 50
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
CHUNK = 128  # candidates evaluated between two looks at the bound
EXACT = 1 << 52  # vectors whose products may reach this leave the exact range of doubles: integers multiply them


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of every component; rows that take no part are left out.

    Those are rows without key and vectors that are null or hold a null, NaN or infinite part.
    """
    part = F.col("embedding")
    bad = F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & part.isNotNull() & ~bad).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(part, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _fits(*vectors: np.ndarray) -> bool:
    """Whether every inner product of the vectors, and so every norm, is exact as a double."""
    peak = max(int(np.abs(v.astype(object)).max(initial=0)) for v in vectors)
    return peak * peak * max(v.shape[-1] for v in vectors) < EXACT


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def pivot_table(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds a row number, the number of components and the distances to the pivots, written once.

    Only pivots with as many components as the row count; the others have distance 0, which
    bounds nothing.
    """
    chosen = [np.array(r["v"], np.float64) for r in
              rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(pivots).collect()]
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def distances(batches):
        for batch in batches:
            v = batch.column("v").to_pylist()
            sizes = np.array([len(x) for x in v], np.int64)
            out = np.zeros((len(v), len(shared.value)))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = np.array([v[i] for i in at], np.float64).reshape(len(at), n)
                for k, p in enumerate(shared.value):
                    if len(p) == n and _fits(p):  # rounding of longer distances could pass for a bound
                        out[at, k] = np.sqrt(_norms(x - p))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(sizes),
                 pa.array(list(out), pa.list_(pa.float64()))], names=["vec_id", "v", "size", "d"])

    return written(
        rows.mapInArrow(distances, "vec_id bigint, v array<bigint>, size bigint, d array<double>")
        .withColumn("row", F.monotonically_increasing_id()), "pivot-table")


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for every query of another."""
    names = ["query_row", "query_id", "vec_id", "row", "score"]
    if not len(q) or not len(c):
        return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
    c = c.sort_values(["vec_id", "row"], ignore_index=True)  # earlier wins among equal scores
    whole = [np.array(list(x["v"]), np.int64).reshape(len(x), -1) for x in (q, c)]
    small = _fits(*whole)
    qv, cv = (x.astype(np.float64 if small else object) for x in whole)
    out = []
    if small:
        far = np.zeros((len(q), len(c)))
        dq, dc = np.stack(list(q["d"])), np.stack(list(c["d"]))
        for p in range(dq.shape[1]):
            np.maximum(far, np.abs(dq[:, p, None] - dc[None, :, p]), out=far)
        nq, nc = _norms(qv), _norms(cv)
        slack = 1e-9 * (nq.max(initial=1) + nc.max(initial=1)) + 1e-6
        # |q-x| >= far, hence <q,x> = (|q|^2 + |x|^2 - |q-x|^2) / 2 <= bound
        bound = (nq[:, None] + nc[None, :] - far * far) / 2 + slack
    ids, rows = c["vec_id"].to_numpy(), c["row"].to_numpy()
    for i, (row, key) in enumerate(zip(q["row"], q["vec_id"])):
        if small:
            order = np.argsort(-bound[i], kind="stable")
            at, score = np.zeros(0, np.int64), np.zeros(0)
            for lo in range(0, len(order), CHUNK):
                if len(score) == k and bound[i, order[lo]] < score[-1]:
                    break
                more = order[lo:lo + CHUNK]
                more = more[rows[more] != row]
                at = np.concatenate([at, more])
                score = np.concatenate([score, cv[more] @ qv[i]])
                top = np.lexsort((at, -score))[:k]
                at, score = at[top], score[top]
        else:
            every = [(-int(sum(a * b for a, b in zip(x, qv[i]))), j)
                     for j, x in enumerate(cv) if rows[j] != row]
            top = sorted(every)[:k]
            at, score = [j for _, j in top], [-s for s, _ in top]
        out += [(row, key, ids[j], rows[j], int(s)) for j, s in zip(at, score)]
    return pd.DataFrame(out, columns=names)


def search(rows: DataFrame, query_every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row.

    Queries are the rows whose key is divisible by `query_every`.  Queries and rows are cut into
    blocks of bounded size by a hash of their row number, so equal vectors do not meet in one
    task; every block of queries meets every block of rows, and within such a pair candidates are
    evaluated in the order of their bounds until no bound reaches the k-th score.  Only vectors
    with equally many components are compared.  Repeated rows are rows of their own; a query's
    own row is left out by its row number.
    """
    base = pivot_table(rows)
    asked = base.where(F.col("vec_id") % query_every == 0)
    n_rows, n_queries = base.count(), asked.count()
    row_blocks = max(1, math.ceil(n_rows / ROW_BLOCK))
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))

    def block(n):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = asked.withColumn("qb", block(query_blocks)).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = base.withColumn("cb", block(row_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["size", "qb", "cb"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(
        lambda q, c: _best(q, c, k),
        "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op7_pivot_search(spark, sf_dir: str) -> DataFrame:
    return search(scaled(table(spark, sf_dir, "embeddings")))


ORACLE = """
with v as (
  select vec_id::bigint as vec_id, row_number() over () as r,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.r as query_row, q.vec_id as query_id, c.vec_id, c.r,
         list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.r <> c.r and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_row order by score desc, vec_id, r) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
