"""Quality rules: counts of bad signs, and a calibrated n-gram regression behind them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_sample, fold, table, written
from ticketlens.llm.features import by_size, codes_of, mix, slot, trigram_ids, words_of
from ticketlens.llm.logistic import calibrate, fit_sparse, sigmoid

BITS = 15  # character trigrams take ids below 2**BITS, words and word pairs the 2**BITS above
SAMPLE_ROWS = 3_000  # bound on the labelled rows that the regression is fitted on
SCALE = 25.0  # n-gram shares are small; this sets the strength of the ridge
KEEP_AT = 0.5  # fixed threshold on the calibrated probability of quality 1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_PAIR = np.uint32(0xD6E8FEB9)
_BLANKS, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"  # fixed by the contract


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    repeated = 0
    n = len(words)
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    covered[i:i + WINDOW] = covered[j:j + WINDOW] = b"\1" * WINDOW
            repeated = sum(covered)
    return n, chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def _blank(codes):
    return (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0)


def _grams(texts: list[str]):
    """Ids of all trigrams and of all words and word pairs, each with the bounds per text."""
    codes, starts = codes_of(texts)
    chars = trigram_ids(codes, BITS)
    char_bounds = np.minimum(starts - 1, len(chars))
    begin, _, hashes = words_of(codes, _blank(codes))
    word_at = np.searchsorted(begin, starts)
    pairs = np.append(mix(hashes[:-1] * _PAIR + hashes[1:]), hashes[:1])[:len(hashes)]
    ids = np.stack([slot(hashes, BITS), slot(pairs, BITS)], axis=1) + (1 << BITS)
    last = word_at[1:][word_at[1:] > word_at[:-1]] - 1
    ids[last, 1] = ids[last, 0]  # the last word of a text has no partner: it counts twice
    return chars, char_bounds, ids, word_at


def _shares(batches):
    """Hashed n-gram shares of the sampled rows, one row per text."""
    for batch in by_size(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        chars, char_at, words, word_at = _grams(texts)
        ids, values = [], []
        for d in range(len(texts)):
            a, n = np.unique(chars[char_at[d]:char_at[d + 1] - 1], return_counts=True)
            b, m = np.unique(words[word_at[d]:word_at[d + 1]].ravel(), return_counts=True)
            ids.append(np.concatenate([a, b]).astype(np.int32))
            values.append(np.concatenate([n / max(1, n.sum()), m / max(1, m.sum())]).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("part"),
             pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["label", "part", "ids", "vals"])


def labelled(docs: DataFrame, labels: DataFrame, name: str, rows: int, extra=None) -> DataFrame:
    """A bounded sample (doc_id, text, label) of the rows that carry a label.

    The sample is drawn from the keys before the join, so whole texts are moved for it alone.
    Rows without key, text or label are left out; several labels of a key count as their maximum.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    if extra is not None:
        marks = marks.where(extra)
    marks = bounded_sample(marks.groupBy("doc_id").agg(F.max(name).alias("label")), "doc_id", rows)
    keys = written(marks, "labelled-keys")  # a bounded number of keys
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(keys), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """Weights, bias, slope and offset; None if the labels do not hold both classes."""
    rows = labelled(docs, labels, "quality", sample_rows)
    shares = rows.select("text", F.col("label").cast("int").alias("label"),
                         fold(F.col("doc_id")).alias("part"))
    # flat buffers: a bounded number of rows
    found = shares.mapInArrow(_shares, "label int, part int, ids array<int>, vals array<float>").toArrow().combine_chunks()
    y = (found.column("label").to_numpy() > 0).astype(int)
    if len(set(y.tolist())) < 2:
        return None
    own = found.column("part").to_numpy() != 0
    if len(set(y[own].tolist())) < 2:
        own = np.ones(len(y), bool)
    lists = found.column("ids").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    ids = lists.flatten().to_numpy()
    values = found.column("vals").combine_chunks().flatten().to_numpy() * np.float32(SCALE)
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    used = own[row]
    renumbered = np.cumsum(own) - 1
    w, b = fit_sparse(renumbered[row[used]], ids[used], values[used], y[own], 2 << BITS)
    z = np.bincount(row, values * w[ids], minlength=len(y)) + b
    rest = ~own if (~own).any() else own
    return w, b, *calibrate(z[rest], y[rest])


def probabilities(texts: list[str], model) -> np.ndarray:
    """Calibrated probability of quality 1 for every whole text."""
    w, b, slope, offset = model
    chars, char_at, words, word_at = _grams(texts)

    def mean(values, at, less):
        total = np.concatenate([[0.0], np.cumsum(values)])
        lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - less)
        return (total[hi] - total[lo]) / np.maximum(1, hi - lo)

    z = mean(w[chars], char_at, 1) + mean(w[words].mean(axis=1), word_at, 0)
    return sigmoid(slope * (SCALE * z + b) + offset)


_SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
           "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
           "probability double, kept boolean")


def judge(docs: DataFrame, model) -> DataFrame:
    """Counts, probability of good quality and verdict of every row (doc_id, text).

    A null or empty text has no words and fails the base rule.  Repeated rows are judged one by
    one.  Other columns do not take part.  Without a model the probability is null and the base
    rule decides alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in by_size(batches):
            texts = batch.column("text").to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            if shared.value is None:
                p, kept = pa.nulls(len(texts), pa.float64()), ~failed
            else:
                p = probabilities([t or "" for t in texts], shared.value)
                kept = ~failed & (p >= KEEP_AT)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5)),
                 pa.array(failed), pa.array(p), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "probability", "kept"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, _SCHEMA)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
