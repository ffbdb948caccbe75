"""Helpers that the operators of this package share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.plans.scale import new_path

#: ASCII white space ends a word; everything else belongs to one (fixed by the contracts)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, lineage cut.

    With `scratch` the path goes to that list, for remove_tables when nothing reads the table any more.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that `written` made for this list; every frame kept must be written itself."""
    context = spark.sparkContext
    while scratch:
        path = context._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that the input does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 5; 0 is the held-out part.  A null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key; the same rows in every run.

    Fewer rows than the bound are all kept.  The share is worked out from a count, so the
    expected size has a bound that does not depend on the input.
    """
    total = df.count()
    share = min(1.0, rows / max(1, total))
    limit = math.ceil(share * 1_000_000)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(77)), F.lit(1_000_000)) < limit)


def spread(df: DataFrame, total: int, per_slice: int = 4096) -> int:
    """Width of one of two levels of slices that hold about per_slice rows each."""
    return max(2, math.ceil(math.sqrt(total / per_slice + 1)))
