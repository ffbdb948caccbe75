"""Table functions for SQL: arguments are tables dealt by key, columns follow from the arguments.

Registered by register_udtfs; each reads its table argument row by row inside one key, in the
order that it asks for itself, and keeps no more than its docstring says.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException, udtf
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, StringType, StructField, StructType,
)


def _column(table: AnalyzeArgument, name: AnalyzeArgument, what: str) -> StructField:
    """The column of the table argument that a constant names."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    if not isinstance(name.value, str) or name.value not in table.dataType.names:
        raise ValueError(f"{what} must name a column of the table, not {name.value!r}")
    return table.dataType[name.value]


@udtf
class RankedScores:
    """R4 in SQL: ranked_scores(table, key, label, score, k) gives the k best labels of every key.

    Rows come ordered, so a key of any size is read up to k rows and keeps a counter.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, label: AnalyzeArgument, score: AnalyzeArgument,
                k: AnalyzeArgument) -> AnalyzeResult:
        fields = [_column(rows, c, w) for c, w in ((key, "key"), (label, "label"), (score, "score"))]
        if not isinstance(k.value, int) or k.value < 1:
            raise ValueError("k must be a positive constant")
        return AnalyzeResult(
            StructType([fields[0], fields[1], StructField(fields[2].name, DoubleType()), StructField("rank", IntegerType())]),
            partitionBy=[PartitioningColumn(key.value)],
            orderBy=[OrderingColumn(score.value, ascending=False, overrideNullsFirst=False), OrderingColumn(label.value)])

    def __init__(self):
        self.rank = 0

    def eval(self, rows, key, label, score, k):
        value = rows[score]
        if self.rank == k or value is None:  # nulls come last
            raise SkipRestOfInputTableException()
        self.rank += 1
        yield rows[key], rows[label], float(value), self.rank


@udtf
class EvaluateRules:
    """W7 in SQL: evaluate_rules(table, time, rules) with rules as a JSON array of name, level, metric, comparison, threshold.

    Every snapshot gives a row per rule whose metric it has; nothing is kept.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, time: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        at = _column(rows, time, "time")
        for rule in json.loads(rules.value):
            if len(rule) != 5 or rule[3] not in ("<", ">"):
                raise ValueError(f"a rule is name, level, metric, < or >, threshold, not {rule}")
        return AnalyzeResult(StructType([
            at, StructField("rule_name", StringType()), StructField("level", StringType()),
            StructField("value", DoubleType()), StructField("breach", BooleanType())]))

    def eval(self, rows, time, rules):
        held = rows.asDict()
        for name, level, metric, comparison, threshold in json.loads(rules):
            if metric in held:
                value = None if held[metric] is None else float(held[metric])
                breach = value is not None and (value < threshold if comparison == "<" else value > threshold)
                yield held[time], name, level, value, breach


@udtf
class PreferencePairs:
    """F1 in SQL: preference_pairs(table, key, item, score, gap) gives the pairs of a key's items at least gap apart.

    Rows come with the score falling, so a key's better items so far are what is kept.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, item: AnalyzeArgument, score: AnalyzeArgument,
                gap: AnalyzeArgument) -> AnalyzeResult:
        fields = [_column(rows, c, w) for c, w in ((key, "key"), (item, "item"), (score, "score"))]
        kind = fields[1].dataType
        return AnalyzeResult(
            StructType([fields[0], StructField("chosen", kind), StructField("rejected", kind),
                        StructField("chosen_score", DoubleType()), StructField("rejected_score", DoubleType())]),
            partitionBy=[PartitioningColumn(key.value)],
            orderBy=[OrderingColumn(score.value, ascending=False, overrideNullsFirst=False), OrderingColumn(item.value)])

    def __init__(self):
        self.better: list = []

    def eval(self, rows, key, item, score, gap):
        value = rows[score]
        if value is None:
            raise SkipRestOfInputTableException()
        value, gap = float(value), float(gap)
        for other, high in self.better:
            if high - value < gap:
                break
            yield rows[key], other, rows[item], high, value
        self.better.append((rows[item], value))


def register_udtfs(spark: SparkSession) -> list[str]:
    """Register the table functions and return their names."""
    names = {"ranked_scores": RankedScores, "evaluate_rules": EvaluateRules, "preference_pairs": PreferencePairs}
    for name, function in names.items():
        spark.udtf.register(name, function)
    return list(names)
