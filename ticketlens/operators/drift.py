"""Embedding drift, contamination, vocabulary and distribution shift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import NOT_SPACE
from ticketlens.functions.vectors import as_double, cosine
from ticketlens.operators.routing import MAX_PROTOTYPES
from ticketlens.operators.vectors import prototypes
from ticketlens.plans.scale import broadcast_checked, evaluate_once

EPS = 1e-9


def paired_cosine(base: DataFrame, current: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """Cosine of the base and current vector of every key."""
    cur = current.select(key, as_double(F.col(vector)).alias("_cur"))
    joined = base.join(cur, key)
    return evaluate_once(
        joined.withColumn("sim", cosine(as_double(F.col(vector)), F.col("_cur"))), ["sim"]
    ).drop("_cur")


def drift_stats(pairs: DataFrame, threshold: float = lx.DRIFT_COSINE, by=("domain",)):
    """D1 (D2 without groups): mean, spread and flag of the cosines in ``sim``."""
    return pairs.groupBy(*by).agg(
        F.avg("sim").alias("mean_sim"), F.stddev_pop("sim").alias("std_sim"),
        F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("distance", 1.0 - F.col("mean_sim")).withColumn(
        "drifted", F.col("mean_sim") < threshold)


def drift_levels(history: DataFrame, distance: str = "distance") -> DataFrame:
    """D3."""
    d = F.col(distance)
    return history.withColumn("is_drifting", d > lx.EPOCH_DRIFT).withColumn(
        "level", F.when(d > lx.EPOCH_SEVERE, "severe").when(d > lx.EPOCH_DRIFT, "drifting")
        .otherwise("stable"))


def drift_history(pairs: DataFrame, by: str = "domain", step: str = "step") -> DataFrame:
    """Drift per checkpoint step with the latest step of a group marked."""
    stats = drift_levels(drift_stats(pairs, by=(by, step)))
    last = stats.groupBy(by).agg(F.max(step).alias("_last"))
    return stats.join(last, by).withColumn("is_latest", F.col(step) == F.col("_last")).drop("_last")


def drift_trend(history: DataFrame, by: str = "domain", step: str = "step") -> DataFrame:
    """Least-squares slope of the distance over the checkpoint sequence.

    The input has one row per group and step, so the ranking window is as small as the history.
    """
    order = F.row_number().over(Window.partitionBy(by).orderBy(step))
    return history.withColumn("_i", order.cast("double")).groupBy(by).agg(
        F.when(F.count(F.lit(1)) >= 2, F.regr_slope("distance", "_i")).alias("slope"),
        F.count(F.lit(1)).alias("n_points"))


def contamination(df: DataFrame, by: str = "domain", vector: str = "v") -> DataFrame:
    """Cosine of group prototypes, at least 0, one row per unordered pair.

    Only the prototypes, one row per group, meet each other.
    """
    protos = prototypes(df, by, vector)
    a = protos.select(F.col(by).alias("domain_a"), F.col("prototype").alias("a"),
                      F.lit(1).alias("_one"))
    b = protos.select(F.col(by).alias("domain_b"), F.col("prototype").alias("b"),
                      F.lit(1).alias("_one"))
    pairs = a.join(broadcast_checked(b, MAX_PROTOTYPES), (a["_one"] == b["_one"])
                   & (F.col("domain_a") < F.col("domain_b")))
    return pairs.select(
        "domain_a", "domain_b",
        F.greatest(F.lit(0.0), cosine(F.col("a"), F.col("b"))).alias("similarity"))


def tokens(text: str = "text"):
    return F.regexp_extract_all(F.lower(text), F.lit(NOT_SPACE + "+"), 0)


def _shares(df: DataFrame, text: str, name: str) -> DataFrame:
    counts = df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias(name))
    return counts


def vocabulary_shift(base: DataFrame, current: DataFrame, k: int = 20, text: str = "text"):
    """(summary, top tokens): KL(current || base) of token shares and the largest shifts."""
    joined = _shares(base, text, "nb").join(_shares(current, text, "nc"), "token", "full").na.fill(
        0, ["nb", "nc"])
    totals = joined.agg(F.sum("nb").alias("tb"), F.sum("nc").alias("tc")).withColumn(
        "_one", F.lit(1))
    shares = joined.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one").select(
        "token", (F.col("nb") / F.col("tb")).alias("base_share"),
        (F.col("nc") / F.col("tc")).alias("current_share"))
    shift = F.abs(F.col("current_share") - F.col("base_share"))
    kl = F.col("current_share") * F.log(
        (F.col("current_share") + EPS) / (F.col("base_share") + EPS))
    summary = shares.agg(F.sum(kl).alias("kl_divergence"), F.max(shift).alias("max_shift"),
                         F.count(F.lit(1)).alias("n_tokens"))
    top = shares.withColumn("shift", shift).orderBy(
        F.round("shift", 12).desc(), "token").limit(k)
    return summary, top


def distribution_shift(
    df: DataFrame, by: str = "domain", reference: dict | None = None,
    threshold: float = lx.DISTRIBUTION_SHIFT,
) -> DataFrame:
    """KL(training mix || current mix) over the union of keys."""
    reference = reference or lx.TRAINING_MIX
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return _kl(counts.withColumn("_w", F.lit(1)), by, reference, ["_w"], threshold).drop("_w")


def _kl(counts: DataFrame, by: str, reference: dict, window: list[str], threshold: float):
    """KL per window from (window, by, n) rows; keys absent from a window get the floor."""
    q = F.greatest(F.col("n") / F.col("_t"), F.lit(EPS))
    # one row per window and key: a few rows
    sized = counts.withColumn("_t", F.sum("n").over(Window.partitionBy(*window)))
    per = sized.groupBy(*window).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(by), q))).alias("_q"),
        F.sum(F.when(~F.col(by).isin(list(reference)), F.lit(EPS) * F.log(F.lit(EPS) / q))
              .otherwise(0.0)).alias("_extra"))
    total = F.col("_extra")
    for d, share in reference.items():
        p = max(share, EPS)
        total = total + F.lit(p) * (
            F.lit(math.log(p)) - F.log(F.coalesce(F.try_element_at("_q", F.lit(d)), F.lit(EPS))))
    return per.withColumn("kl_divergence", total).withColumn(
        "distribution_shift", F.col("kl_divergence") > threshold).drop("_q", "_extra")


def rolling_probe(df: DataFrame, n: int, by: str = "domain", ts: str = "ts", key: str = "trace_id"):
    """The latest n rows per group; the limit applies before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(ts).desc(), F.col(key).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def drift_check(
    pairs: DataFrame, every: str = "30 minutes", by: str = "domain", ts: str = "ts",
    threshold: float = lx.DRIFT_COSINE, shift: float = lx.DISTRIBUTION_SHIFT,
    reference: dict | None = None,
) -> DataFrame:
    """One report per time window from rows (ts, domain, sim)."""
    return checks_from_stats(probe_stats(pairs, every, by, ts), by, threshold, shift, reference)


def probe_stats(pairs: DataFrame, every: str = "30 minutes", by: str = "domain", ts: str = "ts"):
    """First half of D10, the part that reads the probes; also runs as a streaming aggregation."""
    win = F.window(F.col(ts).cast("timestamp"), every)
    return pairs.groupBy(win.alias("w"), by).agg(
        F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n"))


def checks_from_stats(
    per: DataFrame, by: str = "domain", threshold: float = lx.DRIFT_COSINE,
    shift: float = lx.DISTRIBUTION_SHIFT, reference: dict | None = None,
) -> DataFrame:
    """Second half of D10 on the few rows per window and domain."""
    kl = _kl(per.select("w", by, "n"), by, reference or lx.TRAINING_MIX, ["w"], shift)
    sims = per.groupBy("w").agg(
        F.sort_array(F.collect_list(F.when(F.col("mean_sim") < threshold, F.col(by)))).alias(
            "drifted_domains"),
        F.min("mean_sim").alias("min_mean_sim"), F.sum("n").alias("n_probes"),
        F.count(F.lit(1)).alias("n_domains"))
    out = sims.join(kl, "w")
    detected = (F.size("drifted_domains") > 0) | F.col("distribution_shift")
    return out.select(
        F.col("w.start").alias("window_start"), "n_domains", "n_probes", "min_mean_sim",
        "drifted_domains", "kl_divergence", "distribution_shift",
        detected.alias("drift_detected"), detected.alias("alert_fired"))


def drift_report(checks: DataFrame) -> DataFrame:
    """Totals over the drift checks."""
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("drift_detected").alias("total_drifts"),
        F.max("n_domains").alias("max_domains"), F.bool_and(~F.col("drift_detected"))
        .alias("all_pass"))


def check_history(checks: DataFrame, last: int = 100) -> DataFrame:
    """The latest checks, oldest first by window_start."""
    return checks.orderBy(F.col("window_start").desc()).limit(last).orderBy("window_start")


def drift_record(checks: DataFrame, probes: DataFrame, threshold: float = lx.DRIFT_COSINE, last: int = 100,
                 by: str = "domain") -> DataFrame:
    """D11 as one record: threshold, number of checks, drifts, the probed domains and the latest checks."""
    # as many entries as domains, and as checks asked for
    domains = probes.agg(F.sort_array(F.collect_set(by)).alias("domains"))
    shown = check_history(checks, last).agg(F.sort_array(F.collect_list(F.struct(
        "window_start", "drifted_domains", "min_mean_sim", "kl_divergence", "drift_detected"))).alias("history"))
    total = drift_report(checks).select(F.lit(threshold).alias("threshold"), "n_checks", "total_drifts")
    one = lambda x: x.withColumn("_one", F.lit(1))
    return one(total).join(one(domains), "_one").join(one(shown), "_one").drop("_one")
