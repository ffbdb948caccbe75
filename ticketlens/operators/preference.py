"""Preference pairs, win counts and Bradley-Terry ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import response_score
from ticketlens.plans.scale import BROADCAST_ROWS, broadcast_checked, cut_lineage, evaluate_once

HOT_CANDIDATES = 1000


def preference_pairs(
    candidates: DataFrame, gap: float = lx.PREFERENCE_GAP, key: str = "ticket_id",
    hot: int = HOT_CANDIDATES,
) -> DataFrame:
    """F1: ordered pairs of candidates of a ticket whose scores differ by at least the gap.

    candidates (key, pos, response, domain).  A ticket with very many candidates is split into
    salted slices on one side and repeated over the slices on the other, so its pairs are formed
    by many tasks; only pairs that pass the gap are produced.
    """
    scored = evaluate_once(
        candidates.withColumn("score", response_score(F.col("response"), F.col("domain"))),
        ["score"])
    big = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    salts = big.select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    sized = scored.join(broadcast_checked(salts), key, "left").withColumn(
        "_salts", F.coalesce("_salts", F.lit(1)))
    better = sized.select(
        key, "domain", F.col("response").alias("chosen"), F.col("score").alias("chosen_score"),
        F.col("pos").alias("chosen_pos"), F.pmod(F.xxhash64("pos"), F.col("_salts")).cast("int")
        .alias("_salt"))
    worse = sized.select(
        key, F.col("response").alias("rejected"), F.col("score").alias("rejected_score"),
        F.col("pos").alias("rejected_pos"),
        F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return better.join(worse, [key, "_salt"]).where(
        F.col("chosen_score") - F.col("rejected_score") >= gap).drop("_salt")


def win_matrix(pairs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(winner, loser, n); with ``items`` only known ones count."""
    edges = pairs.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))
    if items is None:
        return edges
    known = broadcast_checked(items.select("item").distinct())
    return edges.join(known, edges["winner"] == known["item"], "left_semi").join(
        known, edges["loser"] == known["item"], "left_semi")


def bradley_terry(
    edges: DataFrame, max_iter: int = 100, tol: float = 1e-6, floor: float = 1e-8
) -> DataFrame:
    """strength per item by minorise-maximise steps on (winner, loser, n).

    Games are aggregated to one symmetric edge table before the loop.  Each step reads the
    current strengths twice, so its result is checkpointed; the loop ends on the largest change.
    """
    both = edges.select(F.col("winner").alias("i"), F.col("loser").alias("j"), "n",
                        F.col("n").alias("w"))
    both = both.unionByName(edges.select(F.col("loser").alias("i"), F.col("winner").alias("j"),
                                         "n", F.lit(0).cast("bigint").alias("w")))
    games = cut_lineage(both.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    wins = games.groupBy("i").agg(F.greatest(F.sum("w").cast("double"), F.lit(floor)).alias("w"))
    n_items = wins.count()
    hint = F.broadcast if n_items <= BROADCAST_ROWS else (lambda x: x)
    scores = wins.select("i", "w", F.lit(1.0).alias("raw"), F.lit(0.0).alias("old"))
    total = float(max(n_items, 1))
    pair_games = games.select("i", "j", "n")
    for _ in range(max_iter):
        # the update scales with its input, so the last total normalises as a plain literal
        current = scores.select("i", "w", (F.col("raw") / F.lit(total)).alias("p"))
        theirs = hint(current.select(F.col("i").alias("j"), F.col("p").alias("q")))
        scores = (
            pair_games.join(hint(current), "i").join(theirs, "j")
            .groupBy("i").agg(
                F.max("w").alias("w"),
                F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("d"), F.max("p").alias("old"))
            .select("i", "w", (F.col("w") / F.greatest("d", F.lit(1e-12))).alias("raw"), "old")
        )
        scores = cut_lineage(scores)
        total = scores.agg(F.sum("raw")).first()[0]
        change = scores.agg(F.max(F.abs(F.col("raw") / F.lit(total) - F.col("old")))).first()[0]
        if change is None or change < tol:
            break
    return scores.select(F.col("i").alias("item"), (F.col("raw") / F.lit(total)).alias("strength"))
