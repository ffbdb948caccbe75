"""Toxicity: a learned lexicon, matched through edits, weighed by what stands around a match."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import fold, table, written
from ticketlens.llm.features import by_size, codes_of, mix, words_of
from ticketlens.llm.fuzzy import Matcher
from ticketlens.llm.logistic import fit_dense, sigmoid
from ticketlens.llm.quality_rules import labelled

SAMPLE_ROWS = 12_000  # bound on the labelled rows that lexicon and weights are learned from
TERMS = 1_000  # bound on the lexicon
WINDOW = 4  # tokens on either side of a match
SLOTS = 1 << 12  # hashed context words
#: quotation marks, opening or closing (fixed value)
QUOTES = "\"'“”„‚‘’«»‹›`"
#: weights that thin data fall back to: bias, exact, one edit, two edits, density, quoted, context
PRIOR = np.array([-2.5, 3.0, 1.5, 0.5, 0.5, -1.0, 0.5])



@lru_cache(maxsize=1)
def _token_table() -> np.ndarray:
    """Characters of tokens: letters, digits and the at sign that often stands for a letter."""
    return np.fromiter((chr(i).isalnum() or i == 64 for i in range(0x110000)), bool, 0x110000)


def tokenized(texts: list[str]):
    """Lower-cased texts, their code points, bounds of texts and of tokens among these."""
    lower = [t.lower() for t in texts]
    codes, starts = codes_of(lower)
    edge = np.diff(_token_table()[codes].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return lower, codes, starts, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _distinct_tokens(text: str) -> set[str]:
    lower, _, starts, begin, end = tokenized([text])
    return {lower[0][a - 1:b - 1] for a, b in zip(begin, end)}


def _term_counts(batches):
    """(term, toxic texts, other texts) of one task, added up before they leave it."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[int(label > 0)].update(_distinct_tokens(text))
    terms = sorted(set(counts[0]) | set(counts[1]))
    yield pa.RecordBatch.from_pydict(
        {"term": terms, "toxic": [counts[1][t] for t in terms], "other": [counts[0][t] for t in terms]},
        schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())]))


def _signed(batches):
    """Adds the smallest hash of three tokens in a row, which copies with few edits share."""
    for batch in batches:
        marks = []
        for text in batch.column("text").to_pylist():
            _, codes, _, begin, end = tokenized([text])
            h = words_of(codes, ~_token_table()[codes])[2]
            h = mix(mix(h[:-2] + h[1:-1] * np.uint32(31)) + h[2:]) if len(h) > 2 else h
            marks.append(int(h.min()) if len(h) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())],
                                         names=["text", "label", "mark"])


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Term -> weight: log-odds between toxic and other texts, less their standard error.

    Copies of a text, and most of those with few edits, count once.  A term must be so uneven
    that chance would not produce one such among all terms: its log-likelihood ratio must exceed
    the log of their number.
    """
    texts = (sample.select("text", "label").mapInArrow(_signed, "text string, label int, mark bigint")
             .groupBy("mark").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    sizes = dict(texts.groupBy((F.col("label") > 0).alias("t")).count().collect())
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return {}
    terms = written(
        texts.select("text", "label").mapInArrow(_term_counts, "term string, toxic bigint, other bigint")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where("toxic > 1"), "toxicity-terms")
    total, share = terms.count(), bad / (bad + good)
    t, n = F.col("toxic"), F.col("other")

    def part(k, of):
        return F.when(k > 0, k * F.log(k / (t + n) / F.lit(of))).otherwise(F.lit(0.0))

    odds = F.log((t + 0.5) / (F.lit(bad + 1.0) - t)) - F.log((n + 0.5) / (F.lit(good + 1.0) - n))
    rows = (
        terms.where((t / (t + n) > share) & (part(t, share) + part(n, 1 - share) > math.log(total + 1.0)))
        .select("term", (odds - F.sqrt(1.0 / (t + 0.5) + 1.0 / (n + 0.5))).alias("weight"))
        .where("weight > 1.0").orderBy(F.desc("weight"), "term").limit(TERMS).collect())
    return {r["term"]: float(r["weight"]) for r in rows}


def matches(texts: list[str], matcher: Matcher):
    """For every text its number of tokens and its matches: (term, edits, quoted, neighbours)."""
    lower, codes, starts, begin, end = tokenized(texts)
    bounds = np.searchsorted(begin, starts)
    found: list[list] = [[] for _ in texts]
    near = matcher.candidates(codes, begin, end)
    owner = np.searchsorted(starts, begin[near], side="right") - 1
    for i, d in zip(near.tolist(), owner.tolist()):
        shift, text = int(starts[d]), lower[d]
        m = matcher.match(text[begin[i] - shift:end[i] - shift])
        if m is None:
            continue
        lo, hi = max(i - WINDOW, int(bounds[d])), min(i + WINDOW + 1, int(bounds[d + 1]))
        before = text[max(0, begin[lo] - shift - 1):begin[i] - shift]
        after = text[end[i] - shift:end[hi - 1] - shift + 1]
        around = [text[begin[j] - shift:end[j] - shift] for j in range(lo, hi) if j != i]
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        found[d].append((*m, quoted, around))
    return np.diff(bounds), found


def _slots(around: list[str]) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in around]


def signals(texts: list[str], matcher: Matcher, weights: dict[str, float], context) -> np.ndarray:
    """Features of whole texts: bias, strength by edits, density, quotation, context."""
    x = np.zeros((len(texts), len(PRIOR)))
    sizes, found = matches(texts, matcher)
    x[:, 0] = 1.0
    for d, hits in enumerate(found):
        if not hits:
            continue
        strength = [0.0, 0.0, 0.0]
        around = quoted = 0.0
        for term, edits, inside, near in hits:
            strength[edits] += weights[term]
            quoted += inside
            around += float(context[_slots(near)].mean()) if near else 0.0
        x[d, 1:] = [*np.minimum(4.0, np.log1p(strength)), min(2.0, 20 * len(hits) / sizes[d]),
                    quoted / len(hits), around / len(hits)]
    return x


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """Lexicon, context scores and feature weights from rows outside the held-out fold.

    The lexicon comes from three parts of the training rows, context and weights from the
    fourth, so that terms are weighed on texts that did not choose them.
    """
    sample = written(
        labelled(docs, labels, "toxic", sample_rows, fold(F.col("doc_id")) != 0)
        .select(fold(F.col("doc_id")).alias("part"), "text", F.col("label").cast("int").alias("label")),
        "toxicity-sample")  # bounded
    weights = learn_terms(sample.where("part < 4"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def contexts(batches):
        matcher = Matcher(shared.value)
        seen = np.zeros((2, SLOTS), np.int64)
        for batch in by_size(batches):
            labels_of = batch.column("label").to_pylist()
            for d, hits in enumerate(matches(batch.column("text").to_pylist(), matcher)[1]):
                for _, _, _, near in hits:
                    seen[int(labels_of[d] > 0), list(set(_slots(near)))] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"slot": at, "toxic": seen[1, at], "other": seen[0, at]})

    rest = sample.where("part = 4")
    counts = (rest.select("label", "text").mapInArrow(contexts, "slot bigint, toxic bigint, other bigint")
              .groupBy("slot").agg(F.sum("toxic"), F.sum("other")).collect()) if weights else []
    context = np.zeros(SLOTS)
    bad, good = sum(r[1] for r in counts), sum(r[2] for r in counts)
    for slot, t, n in counts:
        context[slot] = np.log((t + 2.0) / (bad + 4.0)) - np.log((n + 2.0) / (good + 4.0))
    if not bad or not good:
        context[:] = 0.0  # nothing to compare with

    def features(batches):
        matcher = Matcher(shared.value)
        for batch in by_size(batches):
            x = list(signals(batch.column("text").to_pylist(), matcher, shared.value, context))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    found = rest.select("label", "text").mapInArrow(
        features, "label int, x array<double>").toPandas()
    w = PRIOR
    if len(found):
        w = fit_dense(np.array(list(found["x"])), found["label"].to_numpy() > 0, PRIOR)
    return weights, context, w


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of lexicon matches of every row.

    A null or empty text has no match and gets the score of the bias.  Repeated rows are scored
    one by one, a null key counts as held out, other columns do not take part.  If no term could
    be learned, every row gets the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, context, w = shared.value
        matcher = Matcher(weights)
        for batch in by_size(batches):
            x = signals([t or "" for t in batch.column("text").to_pylist()], matcher, weights, context)
            p = sigmoid(x @ w)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p),
                 pa.array((p >= 0.5).astype(np.int32)), pa.array(x[:, 4] > 0)],
                names=["doc_id", "held_out", "score", "predicted", "has_term"])

    return docs.select(
        F.col("doc_id").cast("bigint"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text"
    ).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, has_term boolean")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
