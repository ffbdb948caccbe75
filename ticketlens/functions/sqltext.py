"""SQL text fragments built from the fixed values.

Used for the registered SQL functions and for the reference SQL, so both read the same lists.
``engine`` is "spark" or "duckdb"; only regular-expression calls differ.
"""

from __future__ import annotations

import re

from ticketlens.functions import lexicon as lx
from ticketlens.functions.text import NOT_SPACE, SPACE, word_pattern


def quote(text: str, engine: str = "duckdb") -> str:
    if engine == "spark":
        text = text.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, values: dict[str, str], engine: str = "duckdb") -> str:
    """A fixed text with its {names} replaced by SQL expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"({values[p]})" if k % 2 else quote(p, engine) for k, p in enumerate(pieces) if k % 2 or p)


def matches(col: str, pattern: str, engine: str = "duckdb") -> str:
    fn = "regexp_like" if engine == "spark" else "regexp_matches"
    return f"{fn}({col}, {quote(pattern, engine)})"


def has_word(col: str, words, engine: str = "duckdb") -> str:
    return matches(col, word_pattern(words), engine)


def hits(lowered: str, phrases, engine: str = "duckdb") -> str:
    return "(" + " + ".join(
        f"cast(contains({lowered}, {quote(p, engine)}) as int)" for p in phrases
    ) + ")"


def any_of(lowered: str, phrases, engine: str = "duckdb") -> str:
    return "(" + " or ".join(f"contains({lowered}, {quote(p, engine)})" for p in phrases) + ")"


def strip(col: str, engine: str = "duckdb") -> str:
    pattern = quote(f"^{SPACE}+|{SPACE}+$", engine)
    tail = "" if engine == "spark" else ", 'g'"
    return f"regexp_replace({col}, {pattern}, ''{tail})"


def words(col: str, engine: str = "duckdb") -> str:
    pattern = quote(NOT_SPACE + "+", engine)
    if engine == "spark":
        return f"regexp_count({col}, {pattern})"
    return f"len(regexp_extract_all({col}, {pattern}))"


def case_map(col: str, mapping: dict, default: str = "null") -> str:
    body = " ".join(f"when '{k}' then {v}" for k, v in mapping.items())
    return f"case {col} {body} else {default} end"


def group_score(col, anger, threat, urgency, engine="duckdb") -> str:
    def part(ws, weight):
        flag = has_word(col, ws, engine)
        return f"case when {flag} then cast({weight} as double) else cast(0 as double) end"

    return (f"({part(anger, lx.ANGER_WEIGHT)} + {part(threat, lx.THREAT_WEIGHT)}"
            f" + {part(urgency, lx.URGENCY_WEIGHT)})")


def escalation_score(col: str, engine: str = "duckdb") -> str:
    return ("least(cast(1 as double), "
            + group_score(col, lx.ROUTER_ANGER, lx.ROUTER_THREAT, lx.ROUTER_URGENCY, engine) + ")")


def guard_score(col: str, engine: str = "duckdb") -> str:
    return group_score(col, lx.GUARD_ANGER, lx.GUARD_THREAT, lx.GUARD_URGENCY, engine)


def keyword_domain(col: str, engine: str = "duckdb") -> str:
    low = f"lower({col})"
    n = {d: hits(low, kws, engine) for d, kws in lx.DOMAIN_KEYWORDS.items()}
    best = "greatest(" + ", ".join(n.values()) + ")"
    choice = " ".join(f"when {h} = {best} then '{d}'" for d, h in n.items())
    return (f"case when {best} >= {lx.DOMAIN_KEYWORD_MIN_HITS} then case {choice} end end")


def tone_score(col: str, engine: str = "duckdb") -> str:
    low = f"lower({col})"
    return (f"least(cast(1 as double), {hits(low, lx.TONE_EMPATHY, engine)} * cast(0.15 as double)"
            f" + {hits(low, lx.TONE_ACTION, engine)} * cast(0.20 as double))")


def policy_score(col: str, domain: str, engine: str = "duckdb") -> str:
    low = f"lower({col})"
    return case_map(
        domain,
        {d: f"{hits(low, kws, engine)} / cast({len(kws)} as double)"
         for d, kws in lx.POLICY_KEYWORDS.items()},
        "cast(0 as double)",
    )


def empathy_score(col, engine="duckdb"):
    h = hits(f"lower({col})", lx.SCORE_EMPATHY, engine)
    return f"least(cast(1 as double), {h} / cast(2 as double))"


def action_score(col, engine="duckdb"):
    low = f"lower({col})"
    net = f"({hits(low, lx.SCORE_ACTION, engine)} - {hits(low, lx.SCORE_VAGUE, engine)})"
    return (f"least(cast(1 as double), greatest(cast(0 as double), {net} / cast(2 as double)))")


def clarity_score(col, engine="duckdb"):
    if engine == "spark":
        n = (f"size(filter(split({col}, '[.!?]'), s -> length({strip('s', engine)}) > 5))")
    else:
        n = (f"len(list_filter(regexp_split_to_array({col}, '[.!?]'), "
             f"lambda s: length({strip('s', engine)}) > 5))")
    return (f"case when {n} >= 2 then least(cast(1 as double), {n} / cast(3 as double))"
            f" else cast(0.4 as double) end")


def length_score(col, engine="duckdb"):
    n = words(col, engine)
    return (f"case when {n} < 20 then cast(0.3 as double) when {n} > 150 then cast(0.5 as double)"
            f" else cast(1 as double) - abs({n} - 75) / cast(75 as double) * cast(0.4 as double) end")


def response_score(col, domain, engine="duckdb"):
    w = lx.RESPONSE_WEIGHTS
    parts = [
        (w["empathy"], empathy_score(col, engine)),
        (w["action"], action_score(col, engine)),
        (w["clarity"], clarity_score(col, engine)),
        (w["length"], length_score(col, engine)),
        (w["policy"], policy_score(col, domain, engine)),
    ]
    return "round(" + " + ".join(f"cast({a} as double) * ({b})" for a, b in parts) + ", 4)"


def scrub_pii(col: str, engine: str = "duckdb") -> str:
    tail = "" if engine == "spark" else ", 'g'"
    for _, pattern, mask in lx.PII_PATTERNS:
        col = f"regexp_replace({col}, {quote(pattern, engine)}, {quote(mask, engine)}{tail})"
    return col


def unsupported_score(ticket, response, engine="duckdb"):
    def found(col, p):
        return (f"regexp_extract_all({col}, {quote(p, engine)}, 0)" if engine == "spark"
                else f"regexp_extract_all({col}, {quote(p, engine)})")

    if engine == "spark":
        invented = [f"size(array_except({found(response, p)}, {found(ticket, p)})) > 0"
                    for p in lx.INVENTED_PATTERNS]
    else:
        invented = [
            f"len(list_filter({found(response, p)}, lambda m: not list_contains({found(ticket, p)}, m))) > 0"
            for p in lx.INVENTED_PATTERNS]
    clash = [f"({matches(response, r, engine)} and {matches(ticket, t, engine)})"
             for r, t in lx.CONTRADICTIONS]
    phrase = any_of(f"lower({response})", lx.UNSUPPORTED_PHRASES, engine)

    def part(cond, weight):
        return f"case when {cond} then cast({weight} as double) else cast(0 as double) end"

    total = " + ".join([
        part("(" + " or ".join(invented) + ")", lx.INVENTED_WEIGHT),
        part("(" + " or ".join(clash) + ")", lx.CONTRADICTION_WEIGHT),
        part(phrase, lx.PHRASE_WEIGHT),
        part(f"{words(response, engine)} < 10", lx.SHORT_WEIGHT),
    ])
    return f"round(least(cast(1 as double), {total}), 3)"


def compliance_flags(col: str, engine: str = "duckdb") -> dict[str, dict[str, str]]:
    """Domain -> rule -> boolean SQL, without the rule shared by all domains."""
    low = f"lower({col})"
    out = {}
    for d, rules in lx.COMPLIANCE_RULES.items():
        out[d] = {}
        for name, (some, none) in rules.items():
            checks = ([any_of(low, some, engine)] if some else []) + (
                [f"not {any_of(low, none, engine)}"] if none else [])
            out[d][name] = "(" + " and ".join(checks) + ")"
    return out
