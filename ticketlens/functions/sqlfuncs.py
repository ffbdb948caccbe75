"""Registers the scalar operators as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ticketlens.functions import lexicon as lx
from ticketlens.functions import sqltext as sq

_VECTOR = "ARRAY<DOUBLE>"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, result type, body)."""
    e = "spark"
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norm = lambda v: f"sqrt(aggregate({v}, 0D, (s, x) -> s + x * x))"
    window = sq.quote("(?s)(.)(?=(..))", e)
    return {
        "escalation_score": ("t STRING", "DOUBLE", sq.escalation_score("t", e)),
        "keyword_domain": ("t STRING", "STRING", sq.keyword_domain("t", e)),
        "response_score": ("r STRING, d STRING", "DOUBLE", sq.response_score("r", "d", e)),
        "guard_score": ("t STRING", "DOUBLE", sq.guard_score("t", e)),
        "empathy_score": ("r STRING", "DOUBLE", sq.empathy_score("r", e)),
        "action_score": ("r STRING", "DOUBLE", sq.action_score("r", e)),
        "clarity_score": ("r STRING", "DOUBLE", sq.clarity_score("r", e)),
        "length_score": ("r STRING", "DOUBLE", sq.length_score("r", e)),
        "policy_score": ("r STRING, d STRING", "DOUBLE", sq.policy_score("r", "d", e)),
        "ticket_cost": ("d STRING", "DOUBLE", sq.case_map("d", {k: f"{v}D" for k, v in lx.COST_PER_TICKET.items()}, f"{lx.UNKNOWN_DOMAIN_COST}D")),
        "mcnemar_statistic": ("b BIGINT, c BIGINT", "DOUBLE",
                              "CASE WHEN b + c = 0 THEN 0D ELSE power(abs(b - c) - 1, 2) / (b + c) END"),
        "cohens_h": ("p DOUBLE, q DOUBLE", "DOUBLE", "2 * abs(asin(sqrt(p)) - asin(sqrt(q)))"),
        "tone_score": ("r STRING", "DOUBLE", sq.tone_score("r", e)),
        "scrub_pii": ("t STRING", "STRING", sq.scrub_pii("t", e)),
        "unsupported_score": ("t STRING, r STRING", "DOUBLE", sq.unsupported_score("t", "r", e)),
        "trigrams": ("t STRING", "ARRAY<STRING>",
                     f"array_distinct(zip_with(regexp_extract_all(lower(t), {window}, 1), "
                     f"regexp_extract_all(lower(t), {window}, 2), (x, y) -> concat(x, y)))"),
        "set_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE",
                        "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE "
                        "size(array_intersect(a, b)) / size(array_union(a, b)) END"),
        "vec_dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", dot),
        "vec_norm": (f"a {_VECTOR}", "DOUBLE", norm("a")),
        "vec_cosine": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE",
                       f"CASE WHEN {norm('a')} * {norm('b')} > 0 THEN {dot} / ({norm('a')} * "
                       f"{norm('b')}) ELSE 0D END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, (params, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} "
                  f"RETURN {body}")
    return list(definitions())
