"""Ticket sources and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import lexicon as lx
from ticketlens.operators.clean import clean_tickets
from ticketlens.operators.splits import stratified_split
from ticketlens.sources import jsonobject

TICKETS = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("response", T.StringType()),
])
CORRUPT = "_corrupt_record"


def read_tickets_csv(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """CSV with header; names are trimmed and lower-cased, then rows are cleaned."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        path)
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    wanted = text_col.strip().lower()
    if wanted not in named.columns:
        raise ValueError(f"column {text_col!r} not found; columns are {named.columns}")
    if wanted != "text":
        named = named.withColumnRenamed(wanted, "text")
    return clean_tickets(named)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = TICKETS) -> DataFrame:
    """JSON lines with malformed ones kept in the corrupt-record column."""
    # parsed from lines of text: the file reader refuses to count rows by the corrupt column
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.from_json("value", _full(schema), _PERMISSIVE).alias("r")).select("r.*")


_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _full(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType = TICKETS) -> DataFrame:
    """(file, line_no, line) of the malformed lines; lines count from 1 in their file, blank ones too.

    A file is read in blocks, so a task does not know how many lines come before its own.  Lines
    are numbered inside their block, the lines of all blocks counted, and rejects alone get the
    sum over the blocks before; both scans cut files at the same places.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    # lines of a block follow each other in one task
    lines = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # as many rows as blocks
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    bad = lines.where(F.length(F.trim("value")) > 0).withColumn(
        "bad", F.from_json("value", _full(schema), _PERMISSIVE)[CORRUPT]).where(F.col("bad").isNotNull())
    return bad.join(blocks, ["file", "block"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line"))


def read_tickets_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clean tickets, rejected lines with file and line number); no valid record at all is an error."""
    good = scan_jsonl(spark, path).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if good.isEmpty():
        raise ValueError(f"no valid records in {path}")
    return clean_tickets(good), rejected_lines(spark, path)


def write_splits(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per split and domain."""
    df.write.mode("overwrite").partitionBy("split", "domain").format(fmt).save(path)


def read_all_domains(
    spark: SparkSession, path: str, domains=None, fmt: str = "json", schema=TICKETS,
) -> DataFrame:
    """One scan of the partitioned folder; only wanted partitions are listed and read."""
    # partition columns stay strings whatever their values look like
    parts = T.StructType([f for f in schema.fields if f.name not in ("split", "domain")] + [
        T.StructField("split", T.StringType()), T.StructField("domain", T.StringType())])
    rows = spark.read.schema(parts).format(fmt).load(path)
    rows = rows.where(F.col("domain").isin(list(domains or lx.DOMAINS)))
    if rows.isEmpty():
        raise ValueError(f"no domain data below {path}")
    return rows


def missing_domains(df: DataFrame, domains=None) -> list[str]:
    """Domains without rows; there are as many values as domains."""
    wanted = list(domains or lx.DOMAINS)
    known = df.where(F.col("domain").isin(wanted)).select("domain").distinct()
    found = {r[0] for r in known.collect()}
    return [d for d in wanted if d not in found]


def read_domain_splits(
    spark: SparkSession, path: str, domain: str, val_frac: float = 0.1, fmt: str = "json",
    key: str = "ticket_id",
) -> DataFrame:
    """S3: splits of one domain; the train part is divided only when no val part is stored."""
    rows = read_all_domains(spark, path, [domain], fmt)
    if not rows.where("split = 'val'").isEmpty():
        return rows
    train = stratified_split(rows.where("split = 'train'").drop("split"), val_frac, "label",
                             key=key, names=("train", "val"))
    return train.unionByName(rows.where("split <> 'train'"))


def read_seed_json(spark: SparkSession, path: str, size: int = jsonobject.RANGE) -> DataFrame:
    """JSON objects, domain -> records; defaults filled in.  A file is read by a task per `size` bytes."""
    rows = jsonobject.read_records(
        spark, path, "text string, domain string, label string, source string, response string", 2, size=size)
    return rows.select(
        "record.text", F.coalesce("record.domain", F.col("keys")[0]).alias("domain"), "record.label",
        F.coalesce("record.source", F.lit("seed")).alias("source"),
        F.coalesce("record.response", F.lit("")).alias("response"))


def save_examples(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON-lines store."""
    df.write.mode("append" if append else "overwrite").json(path)


def load_examples(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return scan_jsonl(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
