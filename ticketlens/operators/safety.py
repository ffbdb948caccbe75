"""Safety filters on candidate responses (T12-T20).  Map-only: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx
from ticketlens.functions import text as tx
from ticketlens.plans.scale import evaluate_once


def case_id(key: Column) -> Column:
    """Repeatable case reference derived from the ticket key."""
    return F.concat(F.lit("ESC-"), F.upper(F.substring(F.md5(key.cast("string")), 1, 6)))


def escalation_guard(ticket: Column, score: Column, case: Column) -> Column:
    """struct(passed, confidence, reason, override)."""
    facts = F.struct(F.coalesce(score, F.lit(0.0)).alias("up"),
                     tx.guard_scan_score(ticket).alias("scan"))
    return tx.bind(facts, lambda f: _guard_verdict(f["up"], f["scan"], case))


def _guard_verdict(upstream: Column, scan: Column, case: Column) -> Column:
    by_score = upstream >= lx.ESCALATION_THRESHOLD
    by_scan = scan >= lx.ESCALATION_THRESHOLD
    reply = tx.filled(lx.ESCALATION_REPLY, {"case": case})
    return F.struct(
        (~(by_score | by_scan)).alias("passed"),
        F.when(by_score | by_scan, F.lit(0.95))
        .otherwise(F.lit(1.0) - F.greatest(upstream, scan))
        .alias("confidence"),
        F.when(by_score, F.format_string("upstream score %.3f reaches 0.6", upstream))
        .when(by_scan, F.format_string("words of the ticket score %.3f", scan))
        .otherwise(F.lit("nothing asks for a person"))
        .alias("reason"),
        F.when(by_score | by_scan, reply).alias("override"),
    )


def tone_check(response: Column, domain: Column) -> Column:
    """First failing rule decides; struct(passed, confidence, reason)."""
    least = F.when(domain == "escalation", lx.MIN_ESCALATION_WORDS).otherwise(
        lx.MIN_RESPONSE_WORDS
    )
    facts = F.struct(
        tx.word_count(response).alias("n"), least.alias("least"),
        tx.has_word(response, lx.RUDE_WORDS).alias("rude"),
        tx.has_word(response, lx.DEFLECTION_WORDS).alias("deflects"),
    )

    def verdict(f: Column) -> Column:
        short, rude = f["n"] < f["least"], f["rude"]
        deflects = f["deflects"] & (f["n"] < lx.DEFLECTION_MAX_WORDS)
        return F.struct(
            (~(short | rude | deflects)).alias("passed"),
            F.when(short, 0.90).when(rude, 0.95).when(deflects, 0.80).otherwise(0.95)
            .alias("confidence"),
            F.when(short, F.format_string("%d words where %d are needed", f["n"],
                                          f["least"]))
            .when(rude, "rude wording")
            .when(deflects, "deflects without an action")
            .otherwise("tone in order")
            .alias("reason"),
        )

    return tx.bind(facts, verdict)


def compliance_check(response: Column, domain: Column) -> Column:
    """struct(passed, confidence, reason) on the domain's rules."""
    def verdict(f: Column) -> Column:
        failed = f["failed"]
        return F.struct(
            (F.size(failed) == 0).alias("passed"),
            (F.lit(1.0) - F.size(failed) / F.greatest(f["n"], F.lit(1))).alias("confidence"),
            F.when(F.size(failed) == 0, F.lit("no rule broken"))
            .otherwise(F.concat(F.lit("broken: "), F.array_join(failed, ", ")))
            .alias("reason"),
        )

    facts = tx.bind(
        tx.compliance_rules(response, domain),
        lambda r: F.struct(tx.failed_rules(r).alias("failed"), F.size(r).alias("n")),
    )
    return tx.bind(facts, verdict)


def flag_unsupported(df: DataFrame, threshold: float = lx.UNSUPPORTED_EVAL_THRESHOLD) -> DataFrame:
    """Score and flag; 0.60 when evaluating, 0.50 when serving."""
    scored = df.withColumn(
        "unsupported_score", tx.unsupported_score(F.col("text"), F.col("response"))
    )
    return scored.withColumn("unsupported", F.col("unsupported_score") >= threshold)


def blend_judge(df: DataFrame, threshold: float = lx.UNSUPPORTED_EVAL_THRESHOLD) -> DataFrame:
    """.7 judge + .3 heuristic, the heuristic alone when no judge score exists."""
    heuristic = F.col("unsupported_score")
    blended = F.coalesce(0.7 * F.col("judge_score") + 0.3 * heuristic, heuristic)
    return df.withColumn("confidence", F.round(blended, 3)).withColumn(
        "unsupported", blended >= threshold
    ).withColumn(
        "method", F.when(F.col("judge_score").isNull(), "heuristic").otherwise("judge")
    )


def normalise_judge_scores(df: DataFrame) -> DataFrame:
    """Raw 1-10 judge score as a fraction, the rule score when it is missing."""
    return df.withColumn(
        "score",
        F.coalesce(
            F.round(F.col("judge_raw") / 10.0, 4),
            tx.response_score(F.col("response"), F.col("domain")),
        ),
    )


def run_filters(
    df: DataFrame,
    key: str = "ticket_id",
    score: str = "escalation_score",
    check_unsupported: bool = True,
    check_compliance: bool = True,
) -> DataFrame:
    """Guard, scrub, then (unless escalated) unsupported claims, tone and compliance.

    Needs columns text, response and domain.  Each stage is a projection on the former, so the
    whole chain is one map-only stage and works on streams as well.
    """
    result = lambda name, s: F.struct(
        F.lit(name).alias("name"), s["passed"].alias("passed"),
        s["confidence"].alias("confidence"), s["reason"].alias("reason"),
    )
    guarded = df.withColumn(
        "_guard", escalation_guard(F.col("text"), F.col(score), case_id(F.col(key)))
    ).withColumn("_draft", F.coalesce("_guard.override", "response", F.lit("")))
    guarded = evaluate_once(guarded, ["_guard", "_draft"])
    scrubbed = guarded.withColumn("final_response", tx.scrub_pii(F.col("_draft"))).withColumn(
        "pii_scrubbed", F.col("final_response") != F.col("_draft")
    )
    scrubbed = evaluate_once(scrubbed, ["final_response", "pii_scrubbed"])
    open_ticket = F.col("_guard.passed")
    unsupported = tx.unsupported_score(F.col("text"), F.col("final_response"))
    checked = (
        scrubbed.withColumn("_unsupported", F.when(open_ticket, unsupported))
        .withColumn("_tone", F.when(open_ticket, tone_check(F.col("final_response"),
                                                            F.col("domain"))))
        .withColumn("_rules", F.when(open_ticket, compliance_check(F.col("final_response"),
                                                                   F.col("domain"))))
    )
    checked = evaluate_once(checked, ["_unsupported", "_tone", "_rules"])
    flagged = F.col("_unsupported") >= lx.UNSUPPORTED_SERVING_THRESHOLD
    parts = [
        result("escalation_guard", F.col("_guard")),
        F.struct(
            F.lit("pii_scrubber").alias("name"), F.lit(True).alias("passed"),
            F.lit(1.0).alias("confidence"),
            F.when(F.col("pii_scrubbed"), "personal data replaced").otherwise("no personal data")
            .alias("reason"),
        ),
    ]
    if check_unsupported:
        parts.append(
            F.when(
                open_ticket,
                F.struct(
                    F.lit("unsupported_claims").alias("name"), (~flagged).alias("passed"),
                    F.col("_unsupported").alias("confidence"),
                    F.format_string("heuristic %.3f", "_unsupported").alias("reason"),
                ),
            )
        )
    parts.append(F.when(open_ticket, result("tone_check", F.col("_tone"))))
    if check_compliance:
        parts.append(F.when(open_ticket, result("compliance", F.col("_rules"))))
    return (
        checked.withColumn("filter_results", F.array_compact(F.array(*parts)))
        .withColumn("escalation_triggered", ~open_ticket)
        .withColumn(
            "unsupported_flagged",
            F.coalesce(flagged, F.lit(False)) if check_unsupported else F.lit(False),
        )
        .withColumn("quality_passed", F.forall("filter_results", lambda r: r["passed"]))
        .withColumn("case_id", F.when(~open_ticket, case_id(F.col(key))))
        .drop("_guard", "_draft", "_unsupported", "_tone", "_rules")
    )
