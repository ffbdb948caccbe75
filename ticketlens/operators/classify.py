"""TF-IDF weights and linear text classifiers (M1-M3)."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.text import bind, seeded_index
from ticketlens.operators import linear
from ticketlens.plans.scale import cut_lineage, stored

MAX_FEATURES = 50_000


def strip_accents(c: Column) -> Column:
    """Base letters for composed letters of any script; the table follows from Unicode
    decomposition.  Combining marks that stand alone are dropped."""
    pairs = {}
    for code in (*range(0xC0, 0x2000), *range(0xF900, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code))
                       if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return F.regexp_replace(F.translate(c, "".join(pairs), "".join(pairs.values())), r"\p{M}+", "")


def tokens(c: Column) -> Column:
    """Words of two letters or more of an accent-stripped, lower-cased text."""
    # a text of as many bytes as characters is ASCII and has no accents
    low = bind(F.lower(c), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(strip_accents(t)))
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def terms(c: Column) -> Column:
    """Word 1-grams and 2-grams of an accent-stripped, lower-cased text."""
    n = lambda t: F.size(t) - 1
    bigrams = lambda t: F.when(
        n(t) > 0,
        F.zip_with(F.slice(t, F.lit(1), n(t)), F.slice(t, F.lit(2), n(t)),
                   lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))
    # the words are found once, however often the bigrams refer to them
    return bind(tokens(c), lambda t: F.concat(t, bigrams(t)))


def tfidf(df: DataFrame, key: str, text: str = "text", max_features: int = MAX_FEATURES):
    """M1: (key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length.

    The vocabulary is the max_features most frequent terms, which bounds the broadcast.  The words
    are found once and saved; two words become a term where they are counted, as a pair of numbers.
    """
    n_docs = df.count()
    # rows of one key are one document; the words of a document stay in its row
    texts = df.groupBy(key).agg(F.collect_list(text).alias("_texts"))
    rows = stored(texts.select(key, F.array_join(F.transform(
        "_texts", lambda t: F.array_join(tokens(t), " ")), f" {BREAK} ").alias("_words")), "words")
    top = _frequent(rows, max_features).orderBy(F.desc("total"), "term").limit(max_features).collect()
    idf = np.log((1.0 + n_docs) / (1.0 + np.array([r["docs"] for r in top], float))) + 1.0
    shared = df.sparkSession.sparkContext.broadcast(_pairs_of([r["term"] for r in top], idf))

    def weigh(batches):
        names, words, codes, idf = shared.value
        names, words = pa.array(names, pa.string()), pa.array(words, pa.string())
        for batch in batches:
            for begin, texts in _pieces(batch.column("_words"), PIECE // 16):
                found, first, second, owner = _pairs(texts)
                place = pc.fill_null(pc.index_in(found, value_set=words), -1).to_numpy()
                place = np.append(place, -1).astype(np.int64)  # the last stands for no second word
                known = (place[first] >= 0) & ((place[second] >= 0) | (second < 0))
                code = place[first[known]] * (len(words) + 1) + place[second[known]] + 1
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                hit = codes[at] == code if len(codes) else np.zeros(0, bool)
                cell, n = np.unique(owner[known][hit].astype(np.int64) * len(codes) + at[hit], return_counts=True)
                row, term = np.divmod(cell, max(len(codes), 1))
                w = (1.0 + np.log(n)) * idf[term]
                w /= np.sqrt(np.bincount(row, w * w, len(texts)))[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(begin + row)), names.take(pa.array(term)), pa.array(w, pa.float64())],
                    names=[key, "term", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(weigh, f"`{key}` {kind}, term string, weight double")


BREAK = "\n"  # between the words of two texts of one document; no word has it
PIECE = 8 << 20  # bytes of text that are worked on at once
BUCKETS, SLICE = 1 << 22, 1 << 12  # of counts by hash, and how many of them are in one row


def _pieces(texts: pa.StringArray, size: int):
    """(first row, texts) of slices of about that many bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, side="right"))
        end = max(end, begin + 1)
        yield begin, texts.slice(begin, end - begin)
        begin = end


def _pairs(texts: pa.StringArray):
    """(words, first, second, row): every term of the texts by the numbers of its words, second -1 if it has one."""
    lists = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    row, code = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy()
    words = coded.dictionary.cast(pa.string())
    own = ~pc.is_in(words, value_set=pa.array(["", BREAK])).to_numpy(zero_copy_only=False)
    own = own[code]
    next_to = own[:-1] & own[1:] & (row[:-1] == row[1:])
    first = np.concatenate([code[own], code[:-1][next_to]])
    second = np.concatenate([np.full(own.sum(), -1, code.dtype), code[1:][next_to]])
    return words, first, second, np.concatenate([row[own], row[:-1][next_to]])


def _names(words: pa.StringArray, first: np.ndarray, second: np.ndarray) -> pa.StringArray:
    """The terms with these words."""
    one = words.take(pa.array(first))
    # a null second word makes the joined name null
    two = words.take(pa.array(np.maximum(second, 0), mask=second < 0))
    return pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)


def _pairs_of(vocabulary: list[str], idf: np.ndarray):
    """(terms, words, codes, idf): the terms in the order of their codes, which name their two words."""
    split = [t.split(" ") for t in vocabulary]
    words = sorted({w for t in split for w in t})
    place = {w: i for i, w in enumerate(words)}
    codes = np.array([place[t[0]] * (len(words) + 1) + (place[t[1]] + 1 if len(t) > 1 else 0) for t in split], np.int64)
    order = np.argsort(codes)
    return [vocabulary[i] for i in order], words, codes[order], idf[order]


def _bucket(words: pa.StringArray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bucket of every term, alike in all tasks."""
    worth = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    worth = np.append(worth, np.uint64(0))
    x = worth[first] * np.uint64(0x9E3779B97F4A7C15) + worth[second]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """(term, total, docs) of the `most` most frequent terms of the column _words, and of a few more.

    A first pass counts all terms by the bucket of their hash, which never counts a term too low,
    and the frequent ones of each task by name, which never counts one too high.  No more than the
    `most`-th of the latter is needed of a bucket whose terms are counted by name in a second pass.
    """
    def first_look(batches):
        sums, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for _, texts in _pieces(batch.column("_words"), PIECE):
                words, first, second, _ = _pairs(texts)
                code, n = np.unique(first.astype(np.int64) * (len(words) + 1) + second + 1, return_counts=True)
                first, second = np.divmod(code, len(words) + 1)
                np.add.at(sums, _bucket(words, first, second - 1), n)
                large = _largest(n, 2 * most)
                held.append(pa.table({"term": _names(words, first[large], second[large] - 1), "total": n[large]}))
                size += held[-1].num_rows
                if size > 8 * most:
                    held = [_heads(held, 2 * most)]
                    size = held[0].num_rows
        if held:
            heads = _heads(held, 2 * most)
            blank = pa.nulls(heads.num_rows, pa.int32()), pa.nulls(heads.num_rows, pa.binary())
            yield from pa.table([heads["term"], heads["total"], *blank], names=["term", "total", "slice", "sums"]).to_batches()
            used = [i for i in range(BUCKETS // SLICE) if sums[i * SLICE:(i + 1) * SLICE].any()]
            packed = [pa.compress(sums[i * SLICE:(i + 1) * SLICE].tobytes(), codec="zstd", asbytes=True) for i in used]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()),
                 pa.array(packed, pa.binary())], names=["term", "total", "slice", "sums"])

    seen = stored(rows.select("_words").mapInArrow(first_look, "term string, total bigint, slice int, sums binary"), "counts")
    heads = seen.where("term is not null").groupBy("term").agg(F.sum("total").alias("total"))
    # few totals are different, a row for each
    least = 1
    for total, n in sorted(heads.groupBy("total").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        most -= n
        if most <= 0:
            least = total
            break

    def add(batches):
        sums = {}
        for batch in batches:
            for i, packed in zip(batch.column("slice").to_pylist(), batch.column("sums")):
                n = np.frombuffer(pa.decompress(packed.as_buffer(), SLICE * 8, codec="zstd"), np.int64)
                sums[i] = sums[i] + n if i in sums else n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([np.packbits(n >= least).tobytes() for n in sums.values()], pa.binary())],
            names=["slice", "bits"])

    # a bit for every bucket
    bits = seen.where("slice is not null").select("slice", "sums").repartition("slice").mapInArrow(add, "slice int, bits binary")
    full = np.zeros(BUCKETS, bool)
    for r in bits.collect():
        full[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(full))

    def count(batches):
        full, held, size = np.unpackbits(shared.value).astype(bool), [], 0
        for batch in batches:
            for _, texts in _pieces(batch.column("_words"), PIECE):
                words, first, second, row = _pairs(texts)
                keep = full[_bucket(words, first, second)]
                first, second, row = first[keep], second[keep], row[keep]
                code, at, n = np.unique(first.astype(np.int64) * (len(words) + 1) + second + 1, return_inverse=True, return_counts=True)
                docs = np.unique(row.astype(np.int64) * len(code) + at) % max(len(code), 1)
                first, second = np.divmod(code, len(words) + 1)
                held.append(pa.table({"term": _names(words, first, second - 1), "total": n, "docs": np.bincount(docs, minlength=len(code))}))
                size += held[-1].num_rows
                if size > 500_000:
                    held = [_added(held)]
                    size = held[0].num_rows
                    if size > 250_000:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    parts = rows.select("_words").mapInArrow(count, "term string, total bigint, docs bigint")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).where(F.col("total") >= least)


def _largest(n: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest numbers."""
    return np.arange(len(n)) if len(n) <= most else np.argpartition(n, len(n) - most)[len(n) - most:]


def _heads(parts: list[pa.Table], most: int) -> pa.Table:
    """(term, total): the most frequent terms of all parts, by what the parts have of them."""
    total = pa.concat_tables(parts).group_by("term").aggregate([("total", "sum")])
    return total.take(pa.array(_largest(total["total_sum"].to_numpy(), most))).rename_columns({"total_sum": "total"}).select(["term", "total"])


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, total, docs) from the column _terms, added up in tasks before the shuffle."""
    def count(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 10_000):
                held.append(_counted(batch.column("_terms").slice(a, 10_000)))
                size += held[-1].num_rows
                if size > 500_000:
                    held = [_added(held)]
                    size = held[0].num_rows
                    if size > 250_000:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    parts = rows.select("_terms").mapInArrow(count, "term string, total bigint, docs bigint")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))


def _counted(lists: pa.ListArray) -> pa.Table:
    """(term, total, docs) of the lists of terms of some rows."""
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    docs = np.unique(owner * n + code) % max(n, 1)
    return pa.table({"term": coded.dictionary.cast(pa.string()), "total": np.bincount(code, minlength=n).astype(np.int64),
                     "docs": np.bincount(docs, minlength=n).astype(np.int64)})


def _added(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("term").aggregate([("total", "sum"), ("docs", "sum")])
    return total.rename_columns({"total_sum": "total", "docs_sum": "docs"}).select(["term", "total", "docs"])


def _with_terms(df: DataFrame, text: str) -> DataFrame:
    """Adds the terms of M1; a null text has none."""
    return df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit(""))))


def _weighted(shared):
    """Pandas UDF terms -> (idx, val): M1's weights, logarithmic in the count, of unit length."""
    @F.pandas_udf("struct<idx:binary,val:binary>")
    def weigh(found: pd.Series) -> pd.DataFrame:
        place, idf = shared.value
        out = []
        for words in found:
            counts = Counter(w for w in words if w in place)
            idx = np.array([place[w] for w in counts], np.int32)
            val = (1.0 + np.log(np.array(list(counts.values()), float))) * idf[idx]
            size = np.sqrt((val * val).sum())
            out.append((idx.tobytes(), (val / (size or 1.0)).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["idx", "val"])

    return weigh


class LinearClassifier:
    """M2: class-balanced linear SVM, one against the rest, probabilities by out-of-fold margins.

    Terms, idf, weights and calibration are plain arrays of a bounded vocabulary.  A null text
    has no terms and gets what the intercepts say.
    """

    def __init__(self, vocabulary: list[str], idf: np.ndarray, labels: list[str], weights: np.ndarray,
                 calibration: np.ndarray, text: str = "text", passes: int = 0):
        self.vocabulary, self.idf, self.labels, self.text = vocabulary, idf, labels, text
        self.weights, self.calibration, self.passes = weights, calibration, passes

    @staticmethod
    def fit(df: DataFrame, key: str, label: str = "domain", text: str = "text", max_features: int = MAX_FEATURES,
            max_iter: int = 40, folds: int = 3, c: float = 1.0, tol: float = 1e-3) -> "LinearClassifier":
        """Trains on the rows with a label; no such row is an error.

        The rows become blocks of sparse vectors once, on a saved table; all classes and folds descend
        together, at most max_iter passes over it.
        """
        rows = _with_terms(df.where(F.col(label).isNotNull()), text)
        # as many rows as classes
        sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().collect()}
        if not sizes:
            raise ValueError("no row has a label")
        labels, n = sorted(sizes), sum(sizes.values())
        top = _term_counts(rows).orderBy(F.desc("total"), "term").limit(max_features).collect()
        vocabulary = [r["term"] for r in top]
        idf = np.log((1.0 + n) / (1.0 + np.array([r["docs"] for r in top], float))) + 1.0
        vectors = _weighted(_vocabulary(df, vocabulary, idf))
        number = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, i)])
        weight = F.create_map(*[F.lit(x) for name in labels for x in (name, n / (len(labels) * sizes[name]))])
        name = F.col(label).cast("string")
        data = cut_lineage(linear.blocks(rows.select(
            number[name].alias("y"), F.pmod(seeded_index(42, F.col(key)), F.lit(folds)).cast("int").alias("fold"),
            weight[name].alias("weight"), vectors("_terms").alias("v")).select("y", "fold", "weight", "v.idx", "v.val")))
        weights, passes = linear.fit_margins(data, len(vocabulary), len(labels), folds, c, max_iter, tol)
        held = cut_lineage(linear.out_of_fold_margins(data, weights, len(labels), folds))
        calibration = linear.fit_calibration(held, len(labels), max_iter, tol)
        return LinearClassifier(vocabulary, idf, labels, weights[:, folds * len(labels):], calibration, text, passes)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds probability (array in class order) and prediction."""
        context = df.sparkSession.sparkContext
        vectors = _weighted(_vocabulary(df, self.vocabulary, self.idf))
        probability = linear.probabilities(context.broadcast((self.weights, self.calibration)))
        out = _with_terms(df, self.text).withColumn("_v", vectors("_terms")).withColumn(
            "probability", probability(F.col("_v.idx"), F.col("_v.val")))
        names = F.array(*[F.lit(x) for x in self.labels])
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.select(*df.columns, "probability", F.element_at(names, best).alias("prediction"))

    def save(self, path: str) -> None:
        """One row per term and one for the rest, as Parquet below the path."""
        spark = SparkSession.getActiveSession()
        terms_of = list(zip(self.vocabulary, range(len(self.vocabulary)), self.idf.tolist(), self.weights[:-1].tolist()))
        spark.createDataFrame(terms_of, "term string, idx int, idf double, weights array<double>").write.mode(
            "overwrite").parquet(f"{path}/terms")
        rest = [(self.labels, self.weights[-1].tolist(), self.calibration.ravel().tolist(), self.text, self.passes)]
        spark.createDataFrame(rest, "labels array<string>, intercept array<double>, calibration array<double>, "
                                    "text string, passes int").write.mode("overwrite").parquet(f"{path}/rest")

    @staticmethod
    def load(path: str) -> "LinearClassifier":
        spark = SparkSession.getActiveSession()
        rest = spark.read.parquet(f"{path}/rest").first()
        # as many rows as the vocabulary has terms
        rows = spark.read.parquet(f"{path}/terms").orderBy("idx").collect()
        n = len(rest["labels"])
        weights = np.array([r["weights"] for r in rows] + [rest["intercept"]], float).reshape(-1, n)
        return LinearClassifier([r["term"] for r in rows], np.array([r["idf"] for r in rows]), list(rest["labels"]), weights,
                                np.array(rest["calibration"]).reshape(n + 1, n), rest["text"], rest["passes"])


def _vocabulary(df: DataFrame, vocabulary: list[str], idf: np.ndarray):
    return df.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(vocabulary)}, idf))


class EmbeddingClassifier:
    """V5 as a classifier: the labelled vectors are the model, kept as a table."""

    def __init__(self, train: DataFrame, options: dict):
        self.train, self.options = train, options

    @staticmethod
    def fit(df: DataFrame, key: str, label: str = "label", vector: str = "v", **options) -> "EmbeddingClassifier":
        """Keeps the rows with a label and a vector."""
        known = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
        return EmbeddingClassifier(known.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label")),
                                   options)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from ticketlens.operators.vectors import knn_classify

        return knn_classify(df, self.train, **self.options)

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/vectors")
        spark = self.train.sparkSession
        spark.createDataFrame([(json.dumps(self.options),)], "options string").write.mode("overwrite").parquet(f"{path}/rest")

    @staticmethod
    def load(path: str) -> "EmbeddingClassifier":
        spark = SparkSession.getActiveSession()
        options = json.loads(spark.read.parquet(f"{path}/rest").first()[0])
        return EmbeddingClassifier(spark.read.parquet(f"{path}/vectors"), options)


KINDS = {"svm": LinearClassifier, "embedding": EmbeddingClassifier}


def train_classifier(df: DataFrame, kind: str = "svm", **options):
    """M3: a fitted classifier of the kind; both can be saved and loaded."""
    if kind not in KINDS:
        raise ValueError(f"unknown classifier kind {kind!r}")
    return KINDS[kind].fit(df, **options)
