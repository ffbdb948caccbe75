"""Language ID: mixture of languages per document, fitted by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import bounded_sample, fold, fresh
from ticketlens.llm.features import by_size, codes_of, letter_table, trigram_ids

BITS = 16  # hashed trigrams; the model has 2**BITS rows of one value per language
SAMPLE_DOCS = 12_000  # bound on the labelled documents that the n-gram tables are fitted on
SMOOTHING = 0.2
PENALTY = 3.0  # nats per added language, times log of the number of words
EM_STEPS = 12
UNKNOWN = "und"


def _letters(texts: list[str]):
    """Hashed trigram, text number and word start of every letter of every text."""
    codes, starts = codes_of([t.lower() for t in texts])
    letter = letter_table()[codes]
    shown = np.where(letter, codes, np.uint32(32))
    ids = trigram_ids(shown, BITS)
    at = np.flatnonzero(letter[1:-1])
    first = ~letter[at]  # the position before it holds no letter
    doc = np.searchsorted(starts, at + 1, side="right") - 1
    return ids[at], doc, first


def _count(batches):
    """Trigram counts of one task, added up over its batches before they leave it."""
    seen: dict[str, np.ndarray] = {}
    for batch in by_size(batches):
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            ids, _, _ = _letters(list(texts))
            if lang not in seen:
                seen[lang] = np.zeros(1 << BITS, np.int64)
            seen[lang] += np.bincount(ids, minlength=1 << BITS)
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"lang": [lang] * len(at), "gram": at, "n": counts[at]},
            schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """Languages and their log-likelihood tables from a bounded sample of labelled rows.

    Only rows outside the held-out fold with a text and a language count.  The tables are
    bounded by the number of languages times 2**BITS.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = (
        bounded_sample(rows, "doc_id", sample_docs)
        .select("text", "lang")
        .mapInArrow(_count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .toPandas())
    langs = sorted(counts["lang"].unique())
    tables = np.full((1 << BITS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        tables[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    tables = np.log(tables / tables.sum(axis=0)) if langs else tables
    return langs, tables.astype(np.float32)


def _em(likelihood: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions that EM finds for the words of one text."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    for _ in range(EM_STEPS):
        joint = likelihood * share
        share = (1.0 / joint.sum(axis=1)) @ joint / len(joint)
    return float(np.log(likelihood @ share).sum()), share


def mixture(relative: np.ndarray, chosen: int, value: float) -> np.ndarray:
    """Proportions of one text; starts from its best single language.

    `relative` has the words' log-likelihoods less the best language's.  The language that
    raises the likelihood most is added as long as the gain exceeds the penalty; it is tried
    only if even a free choice word by word could gain that much.
    """
    words, langs = relative.shape
    scaled = np.exp(np.maximum(relative, -60.0))
    chosen, share = [chosen], np.ones(1)
    price = PENALTY * np.log(words + 1.0)
    while len(chosen) < langs:
        best = None
        for k in range(langs):
            if k in chosen:
                continue
            wanted = [*chosen, k]
            if float(relative[:, wanted].max(axis=1).sum()) - value <= price:
                continue
            got, mixed = _em(scaled[:, wanted])
            if got - value > price and (best is None or got > best[0]):
                best = (got, mixed, wanted)
        if best is None:
            break
        value, share, chosen = best
    full = np.zeros(langs)
    full[chosen] = share
    return full


def _predict(texts: list[str | None], langs: list[str], tables: np.ndarray):
    """Language, its proportion and the number of languages of every text."""
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    sizes = np.zeros(len(texts), np.int32)
    ids, doc, first = _letters([t or "" for t in texts])
    if not langs or not len(ids):
        return names, scores, sizes
    begin = np.flatnonzero(first)
    relative = np.add.reduceat(tables[ids], begin, axis=0).astype(np.float64)
    relative -= relative.max(axis=1, keepdims=True)
    cut = np.flatnonzero(np.diff(doc[begin], prepend=-1))
    ends = np.append(cut[1:], len(begin))
    rows = doc[begin][cut]
    single = np.add.reduceat(relative, cut, axis=0)
    lead = single.argmax(axis=1)  # ties go to the first language
    value = single[np.arange(len(cut)), lead]
    names[rows], scores[rows], sizes[rows] = np.array(langs, object)[lead], 1.0, 1
    own = relative[np.arange(len(begin)), np.repeat(lead, ends - cut)]
    reach = np.stack([np.add.reduceat(np.maximum(own, relative[:, k]), cut)
                      for k in range(len(langs))], axis=1).max(axis=1)
    # languages are added one by one, so the first must be able to pay for itself
    for i in np.flatnonzero(reach - value > PENALTY * np.log(ends - cut + 1.0)):
        share = mixture(relative[cut[i]:ends[i]], int(lead[i]), float(value[i]))
        k, d = int(np.argmax(share)), rows[i]
        names[d], scores[d], sizes[d] = langs[k], min(1.0, share[k]), int((share > 0).sum())
    return names, scores, sizes


def identify(docs: DataFrame, model, prefix: str = "") -> DataFrame:
    """The input's columns with lang_pred, score and n_langs behind them.

    Letters are what str.isalpha says; a word is a run of letters, its likelihood under a
    language the product over the trigrams around its letters.  Null texts and texts
    without a letter get `und`, score 0 and no language; so does every text if nothing
    could be learned.  Clashing input columns stay: the new ones get underscores in front.
    """
    langs, tables = model
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    names = [fresh(docs.columns, prefix + c) for c in ("lang_pred", "score", "n_langs")]
    schema = T.StructType([*docs.schema.fields,
                           T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType()),
                           T.StructField(names[2], T.IntegerType())])

    def score(batches):
        for batch in by_size(batches):
            lang, value, size = _predict(batch.column("text").to_pylist(), langs, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(value, pa.float64()),
                 pa.array(size, pa.int32())],
                names=[*batch.schema.names, *names])

    return docs.mapInArrow(score, schema)


def op10_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text")
    found = identify(rows, fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"),
                        "lang_pred", "score", "n_langs")
