"""Corpus pipeline: language, near copies, personal data, mix, packing; a Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import jaccard, langid, mixing, packing, pii
from ticketlens.llm.common import table, written


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null texts and texts without a letter.

    A null lang becomes the predicted one; without any labelled text nothing is predicted, and
    lang stays as it is.
    """
    rows = docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(rows, langid.fit(docs), prefix="_found_")
    lang = F.nullif(F.col(found.columns[len(docs.columns)]), F.lit(langid.UNKNOWN))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of near copies."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, disguised or not, by its kind in brackets."""
    return _measured(pii.scrub(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the targets of their sources, in training order."""
    return _measured(mixing.scheduled(docs))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_packing", token_packing),
]

#: language models and token ids are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
