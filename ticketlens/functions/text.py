"""Row-wise text expressions.  All of them stay inside the JVM, but for the similarity of two texts."""

from __future__ import annotations

import re

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions import lexicon as lx

# One class for every character that counts as white space, valid in Java and RE2 regexes.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD_EDGE_LEFT = r"(^|[^\p{L}\p{N}_])"
WORD_EDGE_RIGHT = r"([^\p{L}\p{N}_]|$)"


def word_pattern(words: list[str]) -> str:
    """Case-insensitive whole-word pattern that means the same in Java and RE2."""
    return f"(?i){WORD_EDGE_LEFT}({'|'.join(words)}){WORD_EDGE_RIGHT}"


# the same characters as SPACE, for the trim function
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def has_word(c: Column, words: list[str]) -> Column:
    """Whole-word search.  The plain substring test runs first and settles most texts, so the
    pattern only sees texts that contain one of the words."""
    low = F.lower(c)
    return any_phrase(low, [w.lower() for w in words]) & c.rlike(word_pattern(words))


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOT_SPACE + "+"))


def phrase_hits(lowered: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur in an already lower-cased text."""
    return reduce(add, [F.contains(lowered, F.lit(p)).cast("int") for p in phrases])


def any_phrase(lowered: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])


def _flag(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def by_domain(domain: Column, branches: dict, default) -> Column:
    out = None
    for name, value in branches.items():
        out = F.when(domain == name, value) if out is None else out.when(domain == name, value)
    return out.otherwise(default)


# --- escalation --------------------------------------------------------------

def _group_score(text: Column, anger, threat, urgency) -> Column:
    return (
        _flag(has_word(text, anger), lx.ANGER_WEIGHT)
        + _flag(has_word(text, threat), lx.THREAT_WEIGHT)
        + _flag(has_word(text, urgency), lx.URGENCY_WEIGHT)
    )


def escalation_score(text: Column) -> Column:
    """Router keyword score in [0, 1]."""
    raw = _group_score(text, lx.ROUTER_ANGER, lx.ROUTER_THREAT, lx.ROUTER_URGENCY)
    return F.least(F.lit(1.0), raw)


def escalation_signals(text: Column) -> Column:
    """Names of the keyword groups that fired."""
    return F.array_compact(
        F.array(
            F.when(has_word(text, lx.ROUTER_ANGER), "anger"),
            F.when(has_word(text, lx.ROUTER_THREAT), "threat"),
            F.when(has_word(text, lx.ROUTER_URGENCY), "urgency"),
        )
    )


def guard_scan_score(ticket: Column) -> Column:
    """Guard lexicon score (uncapped)."""
    return _group_score(ticket, lx.GUARD_ANGER, lx.GUARD_THREAT, lx.GUARD_URGENCY)


def keyword_domain(text: Column) -> Column:
    """Domain with most keyword hits, ties to the first listed, null below two hits."""
    names = F.array(*[F.lit(d) for d in lx.DOMAIN_KEYWORDS])
    counts = bind(
        F.lower(text),
        lambda low: F.array(*[phrase_hits(low, kws) for kws in lx.DOMAIN_KEYWORDS.values()]),
    )
    return bind(
        counts,
        lambda n: F.when(
            F.array_max(n) >= lx.DOMAIN_KEYWORD_MIN_HITS,
            F.element_at(names, F.array_position(n, F.array_max(n)).cast("int")),
        ),
    )


# --- response scores ----------------------------------------------------------

def empathy_score(response: Column) -> Column:
    return F.least(phrase_hits(F.lower(response), lx.SCORE_EMPATHY) / 2.0, F.lit(1.0))


def action_score(response: Column) -> Column:
    low = F.lower(response)
    net = phrase_hits(low, lx.SCORE_ACTION) - phrase_hits(low, lx.SCORE_VAGUE)
    return F.least(F.greatest(net / 2.0, F.lit(0.0)), F.lit(1.0))


def clarity_score(response: Column) -> Column:
    sentences = F.size(
        F.filter(F.split(response, "[.!?]"), lambda s: F.length(strip(s)) > 5)
    )
    return bind(
        sentences,
        lambda n: F.when(n >= 2, F.least(n / 3.0, F.lit(1.0))).otherwise(F.lit(0.4)),
    )


def length_score(response: Column) -> Column:
    return bind(
        word_count(response),
        lambda n: F.when(n < 20, F.lit(0.3))
        .when(n > 150, F.lit(0.5))
        .otherwise(F.lit(1.0) - F.abs(n - 75) / 75.0 * 0.4),
    )


def policy_score(response: Column, domain: Column) -> Column:
    low = F.lower(response)
    shares = {
        d: phrase_hits(low, kws) / F.lit(float(len(kws))) for d, kws in lx.POLICY_KEYWORDS.items()
    }
    return by_domain(domain, shares, F.lit(0.0))


def response_score(response: Column, domain: Column) -> Column:
    """Weighted sum of the five sub-scores, 4 decimals."""
    w = lx.RESPONSE_WEIGHTS
    total = (
        F.lit(w["empathy"]) * empathy_score(response)
        + F.lit(w["action"]) * action_score(response)
        + F.lit(w["clarity"]) * clarity_score(response)
        + F.lit(w["length"]) * length_score(response)
        + F.lit(w["policy"]) * policy_score(response, domain)
    )
    return F.round(total, 4)


def tone_score(response: Column) -> Column:
    """T10."""
    low = F.lower(response)
    raw = phrase_hits(low, lx.TONE_EMPATHY) * 0.15 + phrase_hits(low, lx.TONE_ACTION) * 0.20
    return F.least(raw, F.lit(1.0))


def compliance_rules(response: Column, domain: Column) -> Column:
    """Map of rule name to passed."""
    low = F.lower(response)
    non_empty = [F.lit("non_empty"), F.length(strip(response)) > 0]

    def passed(any_of, none_of):
        checks = ([any_phrase(low, any_of)] if any_of else []) + (
            [~any_phrase(low, none_of)] if none_of else []
        )
        return reduce(lambda a, b: a & b, checks)

    branches = {}
    for d, rules in lx.COMPLIANCE_RULES.items():
        pairs = list(non_empty)
        for name, (any_of, none_of) in rules.items():
            pairs += [F.lit(name), passed(any_of, none_of)]
        branches[d] = F.create_map(*pairs)
    return by_domain(domain, branches, F.create_map(*non_empty))


def failed_rules(rules: Column) -> Column:
    return F.map_keys(F.map_filter(rules, lambda _, ok: ~ok))


# --- personal data ---------------------------------------------------------------

def scrub_pii(text: Column) -> Column:
    """Mask personal data, one pattern after the other."""
    for name, pattern, mask in lx.PII_PATTERNS:
        text = bind(text, lambda t: F.when(
            _may_hold(name, t), F.regexp_replace(t, pattern, mask)).otherwise(t))
    return text


def _may_hold(name: str, t: Column) -> Column:
    """Cheap necessary condition of a personal-data pattern."""
    if name == "email":
        return F.contains(t, F.lit("@"))
    if name == "password":
        return F.contains(F.lower(t), F.lit("password"))
    return t.rlike("[0-9]")


def pii_counts(text: Column) -> dict[str, Column]:
    return {
        name: F.regexp_count(text, F.lit(pattern)) for name, pattern, _ in lx.PII_PATTERNS
    }


# --- unsupported claims --------------------------------------------------------------

def unsupported_score(ticket: Column, response: Column) -> Column:
    """Heuristic score that the response claims things the ticket does not support."""
    low = F.lower(response)
    invented = reduce(
        lambda a, b: a | b,
        [
            F.contains(low, F.lit(hint))
            & (
                F.size(
                    F.array_except(
                        F.regexp_extract_all(response, F.lit(p), 0),
                        F.regexp_extract_all(ticket, F.lit(p), 0),
                    )
                )
                > 0
            )
            for p, hint in zip(lx.INVENTED_PATTERNS, lx.INVENTED_HINTS)
        ],
    )
    contradicted = reduce(
        lambda a, b: a | b,
        [
            F.contains(low, F.lit(hint)) & response.rlike(r) & ticket.rlike(t)
            for (r, t), hint in zip(lx.CONTRADICTIONS, lx.CONTRADICTION_HINTS)
        ],
    )
    total = (
        _flag(invented, lx.INVENTED_WEIGHT)
        + _flag(contradicted, lx.CONTRADICTION_WEIGHT)
        + _flag(any_phrase(low, lx.UNSUPPORTED_PHRASES), lx.PHRASE_WEIGHT)
        + _flag(word_count(response) < 10, lx.SHORT_WEIGHT)
    )
    return F.round(F.least(total, F.lit(1.0)), 3)


# --- n-gram sets ------------------------------------------------------------------------

def trigrams(text: Column) -> Column:
    """Q5: distinct lower-cased character trigrams, empty below three characters."""
    low = F.lower(text)
    # Consuming one code point per match keeps the scan linear and never splits a character.
    window = F.lit("(?s)(.)(?=(..))")
    return F.array_distinct(
        F.zip_with(
            F.regexp_extract_all(low, window, 1),
            F.regexp_extract_all(low, window, 2),
            lambda head, tail: F.concat(head, tail),
        )
    )


def trigram_codes(lowered: str) -> np.ndarray:
    """The distinct trigrams of a lower-cased text as sorted numbers, 21 bits a character: no two alike."""
    c = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def jaccard(a: Column, b: Column) -> Column:
    """Q6: similarity of the trigram sets of two texts, which are built where the texts meet.

    0 when either set is empty; intersection counted once, union by arithmetic.
    """
    def similarity(x, y):
        if x is None or y is None:
            known = y if x is None else x
            return 0.0 if known is not None and len(known) < 3 else None
        x, y = trigram_codes(x), trigram_codes(y)
        if not len(x) or not len(y):
            return 0.0
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # two sorted runs, merged
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common / (len(both) - common)

    @F.pandas_udf("double")
    def similarities(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(*pair) for pair in zip(x, y)], dtype=object)

    return similarities(F.lower(a), F.lower(b))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A fixed text with its {names} replaced by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(pieces) if k % 2 or p])


def seeded_hash(seed, *parts: Column) -> Column:
    """Portable seeded hash: md5 hex of seed and key, usable as sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_index(seed, *parts: Column) -> Column:
    """First 32 bits of the seeded hash as a non-negative integer."""
    return F.conv(F.substring(seeded_hash(seed, *parts), 1, 8), 16, 10).cast("bigint")
