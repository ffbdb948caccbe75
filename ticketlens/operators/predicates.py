"""Alert rules whose check and message are SQL expressions over a snapshot."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSI = "spark.sql.ansi.enabled"


@dataclass(frozen=True)
class PredicateRule:
    """A rule that fires where check is true; message is an expression, description its fallback."""

    name: str
    level: str
    check: str
    description: str
    message: str | None = None
    cooldown_s: int = 300


@contextmanager
def _lenient(spark: SparkSession):
    """Expressions read inside give null where they would fail: division by zero, bad casts, overflow.

    Whether an expression fails is fixed when it is read, so queries keep this after the block.
    """
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(ANSI, before)


def _readable(df: DataFrame, text: str | None, kind: str) -> Column | None:
    """The expression, or None if it cannot be read on the frame or has no value of the kind."""
    if text is None:
        return None
    column = F.expr(text).cast(kind)
    try:
        df.select(column)
    except AnalysisException:  # also where the text is no expression at all
        return None
    return column


def unusable_rules(snapshots: DataFrame, rules: Iterable[PredicateRule]) -> list[str]:
    """Names of the rules whose check cannot be read on these snapshots; they never fire."""
    with _lenient(snapshots.sparkSession):
        return [r.name for r in rules if _readable(snapshots, r.check, "boolean") is None]


def evaluate_predicates(snapshots: DataFrame, rules: Iterable[PredicateRule], ts: str = "ts") -> DataFrame:
    """(ts, rule_name, level, cooldown_s, breach, message) of every snapshot and rule, in one projection.

    A check that fails, is null or cannot be read does not fire; a message that does so is the
    rule's description.  The result goes into the episodes, fires, active alerts and streams of W8
    and W9 like that of evaluate_rules; works on batch and streaming frames.
    """
    with _lenient(snapshots.sparkSession):
        rows = []
        for r in rules:
            check = _readable(snapshots, r.check, "boolean")
            breach = F.lit(False) if check is None else F.coalesce(check, F.lit(False))
            message = _readable(snapshots, r.message, "string")
            text = F.lit(r.description) if message is None else F.coalesce(message, F.lit(r.description))
            rows.append(F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.level).alias("level"),
                                 F.lit(r.cooldown_s).alias("cooldown_s"), breach.alias("breach"),
                                 F.when(breach, text).alias("message")))
        if not rows:
            raise ValueError("no rules")
        return snapshots.select(ts, F.inline(F.array(*rows)))
