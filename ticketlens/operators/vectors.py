"""Vector tables: prototypes, nearest neighbours, blends, interference (V3-V9)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.vectors import as_double, cosine, l2_norm, l2_normalise
from ticketlens.plans.scale import at_most

# One broadcast matrix holds at most this many values (doubles), whatever the dimension.
MATRIX_VALUES = 8_000_000
EPS = 1e-9


def prototypes(df: DataFrame, by: str = "domain", vector: str = "v", normalise: bool = True):
    """V3: mean vector per group; unit length when asked.

    The summarizer adds vectors inside each map task, so a group of any size sends one partial
    vector per task.
    """
    mean = df.groupBy(by).agg(
        Summarizer.mean(array_to_vector(as_double(F.col(vector)))).alias("_m"),
        F.count(F.lit(1)).alias("n"),
    )
    out = mean.select(by, vector_to_array("_m").alias("prototype"), "n")
    if normalise:
        out = out.withColumn("prototype", l2_normalise(F.col("prototype"), EPS))
    return out


_ENCODERS: dict = {}  # of this Python worker


def encode(df: DataFrame, text: str = "text", features: int = 256, encoder=None, load=None) -> DataFrame:
    """V4: text to vector column ``v``.

    Default: hashed term frequencies, inverse document frequency, unit length.  A user encoder
    is a function from a pandas Series of texts to a list of vectors and runs on Arrow batches.
    load is a function that makes one, for encoders that are costly to make: every Python worker
    calls it once, whatever the number of tasks and batches, and none is sent to the workers.
    """
    if encoder is not None or load is not None:
        name = uuid.uuid4().hex

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from ticketlens.operators import vectors

            if load is not None and name not in vectors._ENCODERS:
                vectors._ENCODERS[name] = load()
            own = encoder or vectors._ENCODERS[name]
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in own(texts)])

        return df.withColumn("v", run(F.col(text)))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df).withColumn("v", vector_to_array("_unit"))
    return out.drop("_tok", "_tf", "_idf", "_unit")


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col])


PAIRS = 1 << 20  # similarities that a task holds at once
TASK_PAIRS = 200_000_000  # pairs that a task of the broadcast form compares, about
GROUPS = 96  # pairs of blocks, at least, so that there is work for every core


def _similarities(query, train, euclid: bool) -> np.ndarray:
    """Products, or minus the squared distances, row by row: the same whatever stands in the block."""
    if euclid:
        gap = query - train
        return -(gap * gap).sum(axis=1)
    return (query * train).sum(axis=1)


def _block_topk(query_ids, query, train_ids, train, labels, k, folds=None, euclid=False):
    """Best k training rows per query by similarity, ties to the smaller id.

    folds are those of the queries and of the training rows; equal ones do not count.  Tiles of
    the block are multiplied out and only what comes near a query's k-th best so far is looked at
    again, with its similarity worked out alone, so that equal vectors tie in every block.
    """
    k = min(k, len(train))
    lengths = (query**2).sum(axis=1), (train**2).sum(axis=1)
    longest = lengths[1].max(initial=0.0, where=np.isfinite(lengths[1]))
    odd = not (np.isfinite(lengths[0]).all() and np.isfinite(lengths[1]).all())
    step = 4096
    rows_at_once = max(1, PAIRS // step)
    parts = []
    for a in range(0, len(query) if k else 0, rows_at_once):
        q = query[a : a + rows_at_once]
        # error of a product in double, for the look again
        slack = 1e-12 * (1.0 + np.nan_to_num(lengths[0][a : a + rows_at_once], posinf=0.0) + longest)
        best_sim = np.full((len(q), k), -np.inf)
        best = np.full((len(q), k), -1, np.int64)  # places of training rows
        for b in range(0, len(train), step):
            t = train[b : b + step]
            sims = q @ t.T
            if euclid:
                sims *= 2.0
                sims -= lengths[1][b : b + step]
                sims -= lengths[0][a : a + rows_at_once, None]
            if odd:
                sims[~np.isfinite(sims)] = -np.inf
            floor = best_sim[:, -1]
            if sims.shape[1] > k and not np.isfinite(floor).all():
                seen = sims
                if folds is not None:
                    own = folds[0][a : a + rows_at_once, None] == folds[1][None, b : b + step]
                    seen = np.where(own, -np.inf, sims)
                floor = np.maximum(floor, np.partition(seen, -k, axis=1)[:, -k])
            floor = np.maximum(floor - slack, np.finfo(float).min)
            row, col = np.divmod(np.flatnonzero(sims >= floor[:, None]), sims.shape[1])
            if folds is not None:
                other = folds[0][a + row] != folds[1][b + col]
                row, col = row[other], col[other]
            if not len(row):
                continue
            found = np.concatenate([_similarities(q[row[i : i + 65536]], t[col[i : i + 65536]], euclid)
                                    for i in range(0, len(row), 65536)])
            old_row, old_col = np.nonzero(best >= 0)
            row = np.concatenate([old_row, row])
            place = np.concatenate([best[old_row, old_col], col + b])
            found = np.concatenate([best_sim[old_row, old_col], found])
            order = np.lexsort((train_ids[place], -found, row))
            row, place, found = row[order], place[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            best_sim[row[top], rank[top]], best[row[top], rank[top]] = found[top], place[top]
        row, col = np.nonzero(best >= 0)
        place = best[row, col]
        parts.append(pd.DataFrame({
            "query_id": np.asarray(query_ids)[a + row], "train_id": train_ids[place],
            "label": np.asarray(labels, dtype=object)[place], "sim": best_sim[row, col]}))
    if not parts:
        return pd.DataFrame({"query_id": [], "train_id": [], "label": [], "sim": []})
    return pd.concat(parts)


_TOPK_SCHEMA = "query_id bigint, train_id bigint, label string, sim double"


def top_neighbours(
    query: DataFrame,
    train: DataFrame,
    k: int,
    query_id: str = "vec_id",
    train_id: str = "vec_id",
    label: str = "label",
    vector: str = "v",
    metric: str = "cosine",
    fold: str | None = None,
    matrix_values: int = MATRIX_VALUES,
) -> DataFrame:
    """Exact k nearest training rows of every query: (query_id, train_id, label, sim).

    sim is the cosine, or minus the squared distance for metric "euclidean".  With ``fold`` a
    training row of the query's own fold does not count.  A training side proven small is
    broadcast as one matrix.  Otherwise both sides are cut into blocks of bounded size and each
    pair of blocks is one group; partial results are merged by the final ranking.
    """
    unit = (lambda c: l2_normalise(c)) if metric == "cosine" else (lambda c: c)
    extra = [F.col(fold).cast("bigint").alias("f")] if fold else []
    q = query.select(F.col(query_id).cast("bigint").alias("id"),
                     unit(as_double(F.col(vector))).alias("v"), *extra)
    t = train.select(F.col(train_id).cast("bigint").alias("id"), F.col(label).cast("string")
                     .alias("label"), unit(as_double(F.col(vector))).alias("v"), *extra)
    with_fold = fold is not None
    euclid = metric == "euclidean"

    def search(qp: pd.DataFrame, ids, mat, labels, folds) -> pd.DataFrame:
        both = (qp["f"].to_numpy(), folds) if with_fold else None
        return _block_topk(qp["id"].to_numpy(), _matrix(qp["v"]), ids, mat, labels, k, both, euclid)

    def unpack(tp: pd.DataFrame):
        folds = tp["f"].to_numpy() if with_fold else None
        return tp["id"].to_numpy(), _matrix(tp["v"]), tp["label"].to_numpy(), folds

    first = train.select(F.size(vector).alias("d")).first()
    dim = max(first["d"], 1) if first else 1
    bound = max(matrix_values // dim, 1)
    if at_most(t, bound):
        ids, mat, labels, folds = unpack(t.toPandas()) if first else (None, None, None, None)
        shared = query.sparkSession.sparkContext.broadcast((ids, mat, labels, folds))

        def scan(batches):
            ids, mat, labels, folds = shared.value
            if mat is None:
                return
            for part in batches:
                if len(part):
                    yield search(part, ids, mat, labels, folds)

        # a small file would be one task whatever its rows have to meet
        tasks = math.ceil(q.count() * (len(ids) if first else 0) / TASK_PAIRS)
        if tasks > 1:
            q = q.repartition(tasks, "id")
        return q.mapInPandas(scan, _TOPK_SCHEMA)

    t_blocks = math.ceil(t.count() / bound * 1.2)
    q_blocks = max(math.ceil(q.count() / bound * 1.2), math.ceil(GROUPS / t_blocks))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q_side = q.withColumn("qb", block(q_blocks)).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))))
    t_side = t.withColumn("tb", block(t_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def pair(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        if not len(qp) or not len(tp):
            return pd.DataFrame({"query_id": [], "train_id": [], "label": [], "sim": []})
        ids, mat, labels, folds = unpack(tp)
        return search(qp, ids, mat, labels, folds)

    partial = (q_side.groupBy("qb", "tb").cogroup(t_side.groupBy("qb", "tb"))
               .applyInPandas(pair, _TOPK_SCHEMA))
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "train_id"))
    return partial.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def knn_classify(
    query: DataFrame, train: DataFrame, k: int = 5, temperature: float = 0.1, **options
) -> DataFrame:
    """V5: softmax over the mean similarity per class among the k nearest rows overall.

    Result: (query_id, label, mean_sim, prob, predicted) with one row per query and class of the
    training side; a class without neighbours has similarity 0.
    """
    label = options.get("label", "label")
    near = top_neighbours(query, train, k, **options)
    classes = [r[0] for r in train.select(F.col(label).cast("string")).distinct()
               .orderBy(label).limit(10_001).collect()]
    if len(classes) > 10_000:
        raise ValueError("more than 10000 classes")
    means = near.groupBy("query_id", "label").agg(F.avg("sim").alias("m"))
    # at most k classes per query
    found = means.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("found"))
    scores = found.withColumn(
        "scores",
        F.transform(
            F.array(*[F.lit(c) for c in classes]),
            lambda c: F.struct(c.alias("label"),
                               F.coalesce(F.try_element_at("found", c), F.lit(0.0)).alias("m")),
        ),
    )
    peak = F.array_max(F.transform("scores", lambda s: s["m"]))
    weighted = scores.withColumn("peak", peak).withColumn(
        "total",
        F.aggregate("scores", F.lit(0.0),
                    lambda acc, s: acc + F.exp((s["m"] - F.col("peak")) / temperature)),
    ).withColumn(
        "predicted",
        F.element_at(F.filter("scores", lambda s: s["m"] == F.col("peak")), 1)["label"],
    )
    return weighted.select("query_id", "predicted", "total", "peak",
                           F.explode("scores").alias("s")).select(
        "query_id", F.col("s.label").alias("label"), F.col("s.m").alias("mean_sim"),
        (F.exp((F.col("s.m") - F.col("peak")) / temperature) / F.col("total")).alias("prob"),
        "predicted")


def combine_vectors(vectors: DataFrame, weights: DataFrame, keys_of: str) -> DataFrame:
    """Weighted sum per key of vector sets, restricted to the keys of one set.

    vectors (vec_set, key, values), weights (vec_set, weight).  Sums run element-wise on
    (key, position) with map-side combination.  The weights are a short list of the caller.
    """
    wanted = vectors.where(F.col("vec_set") == keys_of).select("key")
    exploded = (
        vectors.join(F.broadcast(weights), "vec_set")
        .join(wanted, "key", "left_semi")
        .select("key", "weight", F.posexplode(as_double(F.col("values"))).alias("pos", "x"))
    )
    summed = exploded.groupBy("key", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return summed.groupBy("key").agg(
        # bounded by the vector dimension
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_p")
    ).select("key", F.transform("_p", lambda p: p["x"]).alias("values"))


def blend_vectors(vectors: DataFrame, weights: dict[str, float]) -> DataFrame:
    """V6: normalised weighted mean over the keys of the first set."""
    total = sum(weights.values())
    rows = [(s, w / total) for s, w in weights.items()]
    table = vectors.sparkSession.createDataFrame(rows, "vec_set string, weight double")
    return combine_vectors(vectors, table, next(iter(weights)))


def vector_arithmetic(vectors, base: str, add=(), subtract=(), lam: float = 0.5) -> DataFrame:
    """V7: base + lam * sum(add) - lam * sum(subtract) over the keys of the base."""
    rows = [(base, 1.0)] + [(s, lam) for s in add] + [(s, -lam) for s in subtract]
    table = vectors.sparkSession.createDataFrame(rows, "vec_set string, weight double")
    return combine_vectors(vectors, table, base)


def interference(vectors: DataFrame, set_a: str, set_b: str) -> DataFrame:
    """V8: one minus the mean cosine over comparable common keys; 1 when there is none."""
    side = lambda s, name: vectors.where(F.col("vec_set") == s).select(
        "key", as_double(F.col("values")).alias(name))
    common = side(set_a, "a").join(side(set_b, "b"), "key").where(
        (F.size("a") == F.size("b")) & (l2_norm(F.col("a")) > 0) & (l2_norm(F.col("b")) > 0))
    return common.agg(
        F.round(F.coalesce(1.0 - F.avg(cosine(F.col("a"), F.col("b"))), F.lit(1.0)), 4)
        .alias("interference"), F.count(F.lit(1)).alias("n_keys"))


def ablation(predictions: DataFrame, interference_row: DataFrame) -> DataFrame:
    """V9: accuracy of primary, secondary and composed predictions with the interference."""
    share = lambda c: F.avg((F.col(c) == F.col("label")).cast("int"))
    acc = predictions.agg(
        share("primary_pred").alias("primary_accuracy"),
        share("secondary_pred").alias("secondary_accuracy"),
        share("composed_pred").alias("composed_accuracy"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("_one", F.lit(1))
    single = interference_row.select("interference").withColumn("_one", F.lit(1))
    return acc.join(single, "_one").drop("_one").withColumn(
        "composition_benefit",
        F.col("composed_accuracy") - F.greatest("primary_accuracy", "secondary_accuracy"))
