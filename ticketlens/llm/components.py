"""Connected components of an edge table by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ticketlens.llm.common import remove_tables, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that the edges (a, b) reach, for every node of an edge.

    Each round takes the smallest label among a node, its neighbours and the node that its label
    names, so long chains shorten by half a round.  Labels only fall and stay inside their
    component; when none falls, neighbours have equal ones.  Minima are aggregated before the
    shuffle; a round is one written table, which goes after the next, and the driver sees a count
    of changes alone.
    """
    spark, around, before = edges.sparkSession, [], []
    real = edges.where("a <> b")
    both = written(real.select("a", "b").union(real.select("b", "a")).distinct(), "edges", around)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")),
                     "labels", before)
    if both.isEmpty():
        remove_tables(spark, around)
        return labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        falls = labels.join(near, "node").join(jump, "comp").select(
            "node", F.least("near", "over").alias("to"), F.col("comp").alias("old"))
        moved, old = Observation(), before[:]
        before.clear()
        labels = written(falls.select("node", F.least("to", "old").alias("comp"), (F.col("to") < F.col("old")).alias("moved"))
                         .observe(moved, F.count_if("moved").alias("n")).drop("moved"), "labels", before)
        remove_tables(spark, old)
        if not moved.get.get("n"):
            remove_tables(spark, around)
            return labels
