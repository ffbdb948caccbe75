"""Sweep results, registries, prototypes and reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.sources import jsonobject

SWEEP = ("run_name string, lora_r int, learning_rate double, lora_dropout double, "
         "metrics map<string,double>, error string")
CHECKPOINT = "step int, epoch double, metrics map<string,double>, adapter_path string, is_best boolean"


def read_sweep(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Finished runs with their evaluation loss."""
    rows = spark.read.schema(SWEEP).option("multiLine", multi_line).json(path)
    return rows.where(F.col("error").isNull()).withColumn(
        "eval_loss", F.try_element_at("metrics", F.lit("eval_loss"))).drop("error")


def save_registry(df: DataFrame, path: str, config: dict | None = None) -> None:
    """Checkpoint rows, partitioned by domain, and the settings they were ranked by beside them."""
    df.write.mode("overwrite").partitionBy("domain").parquet(path)
    settings = [(name, json.dumps(value)) for name, value in (config or {}).items()]
    df.sparkSession.createDataFrame(settings, "name string, value string").coalesce(1).write.mode("overwrite").json(
        f"{path.rstrip('/')}.config")


def load_registry(spark: SparkSession, path: str, size: int = jsonobject.RANGE) -> DataFrame:
    """A table written by save_registry, or a nested JSON registry file, read by a task per `size` bytes."""
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    rows = jsonobject.read_records(spark, path, CHECKPOINT, 3, ("checkpoints",), size)
    return rows.select(F.col("keys")[1].alias("domain"), "record.*")


def load_registry_config(spark: SparkSession, path: str) -> dict:
    """The settings of either form of the registry; none if it has none."""
    if not path.endswith(".json"):
        try:
            rows = spark.read.schema("name string, value string").json(f"{path.rstrip('/')}.config").collect()
        except AnalysisException:
            return {}
        return {r["name"]: json.loads(r["value"]) for r in rows}
    found = jsonobject.read_records(spark, path, "map<string,string>", 1, ("config",)).first()
    return {} if found is None else {k: _plain(v) for k, v in found["record"].items()}


def _plain(text: str):
    """The JSON value of a text, or the text itself."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


def write_report(df: DataFrame, path: str) -> None:
    """Report rows with nested structs as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report rows; an absent or unreadable report gives no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    full = schema + ", _corrupt_record string"
    rows = lines.select(F.from_json("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def save_prototypes(df: DataFrame, path: str, temperature: float, threshold: float) -> None:
    """One row per domain with vector, count and router settings."""
    df.withColumn("temperature", F.lit(temperature)).withColumn(
        "threshold", F.lit(threshold)).write.mode("overwrite").parquet(path)


def load_prototypes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
