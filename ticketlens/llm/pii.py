"""Personal data: fixed base rules, and detection behind disguises with exact source spans."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import fresh, table

KINDS = ("email", "ip", "card", "phone")

# The base rules' character classes and limits.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its first digit fails at all others, hence the look-behind and
# the possessive quantifiers: they keep long runs linear and find the same matches.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b", "г": "r", "к": "k", "м": "m",
    "н": "h", "т": "t", "в": "b", "п": "n", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S",
    "Ј": "J", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k",
    "γ": "y", "χ": "x", "ε": "e", "η": "n", "ω": "w", "Α": "A", "Β": "B", "Ε": "E", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ζ": "Z", "ı": "i", "ⅼ": "l", "ℓ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
    "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Digits written out, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
# Words that stand for the two marks of an address.
AT_WORDS, DOT_WORDS = ("at", "arroba", "ät", "chez"), ("dot", "punkt", "point", "punto")
# Endings that make "name at host.ending" an address without further marks.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "example", "test")
INVISIBLE = "​‌‍⁠﻿­"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the address rule, leftmost first, found from their at signs."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the fixed rules, in order; the end is exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@lru_cache(maxsize=1)
def _single() -> dict[str, str]:
    """One-character rewrites: look-alikes, and the decimal digits and letters of wide forms."""
    out = dict(HOMOGLYPHS)
    out.update((chr(0xFF01 + k), chr(0x21 + k)) for k in range(94))  # full-width ASCII
    for block in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out.update((chr(block + k), str(k)) for k in range(10))
    return out


_WORDLIKE = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(
    rf"(?<!\w)(?:{_WORDLIKE})(?:[\x20,-]{{1,2}}(?:{_WORDLIKE}|(?:plus\x20)?[0-9]))+(?!\w)"
    rf"|(?<!\w)(?:{_WORDLIKE})(?=[\x20-]?[0-9])|(?<=[0-9]\x20)(?:{_WORDLIKE})(?!\w)", re.I)
_SPELLED_WORD = re.compile(_WORDLIKE, re.I)
_MARK = re.compile(
    rf"\s?[(\[{{<]\s?({'|'.join(AT_WORDS)}|@|{'|'.join(DOT_WORDS)}|\.)\s?[)\]}}>]\s?"
    rf"|\s?[_-]({'|'.join(AT_WORDS)}|{'|'.join(DOT_WORDS)})[_-]\s?"
    rf"|\s({'|'.join(AT_WORDS)}|@|{'|'.join(DOT_WORDS)})\s", re.I)
_PLUS = re.compile(r"(?<!\w)plus\s?(?=\+?[0-9])", re.I)
_NUMBER_DOT = re.compile(
    rf"(?<=[0-9])(?:\s?[(\[{{<]\s?(?:{'|'.join(DOT_WORDS)}|\.)\s?[)\]}}>]\s?|\s(?:{'|'.join(DOT_WORDS)})\s)(?=[0-9])", re.I)
_DOTTED = tuple(f"{o}{w}" for w in DOT_WORDS for o in " ([{<") + ("(.", "[.")
_DIGIT_SET = frozenset(DIGIT_WORDS)
# substrings of a lower-cased text without which no mark is disguised
_BRACKETED = tuple(f"{o}{g}{w}" for w in (*AT_WORDS, "@") for o in "([{<" for g in ("", " ")) + tuple(
    f"{o}{w}{o}" for w in AT_WORDS for o in "_-") + (" @", "@ ")
_BARE = tuple(f" {w} " for w in AT_WORDS)
_BARE_NEXT = tuple(f" {w} " for w in DOT_WORDS) + tuple(f".{e}" for e in ENDINGS)
# what a disguised dot ends with, for texts whose at sign is plain
_HIDDEN_DOT = re.compile(rf"(?:{'|'.join(DOT_WORDS)})[)\]}}>_\s-]|\.\s?[)\]}}>]")


class Tape:
    """Text under rewriting: its characters and the source span of each of them."""

    def __init__(self, text: str):
        self.text = text
        self.start = self.end = None

    def _open(self) -> None:
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces text[a:b] by a string, for ordered disjoint (a, b, string)."""
        if not edits:
            return
        self._open()
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[last:a], new]
            starts += [self.start[last:a], np.full(len(new), self.start[a])]
            ends += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        self.text = "".join([*parts, self.text[last:]])
        self.start = np.concatenate([*starts, self.start[last:]])
        self.end = np.concatenate([*ends, self.end[last:]])


@lru_cache(maxsize=1)
def _special() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, [*_single(), *INVISIBLE])) + "]")


def _fold_characters(tape: Tape) -> None:
    single = _single()
    tape.rewrite([(m.start(), m.end(), single.get(m[0], "")) for m in _special().finditer(tape.text)])


def _fold_digits(tape: Tape) -> None:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = list(_SPELLED_WORD.finditer(tape.text, m.start(), m.end()))
        for k, w in enumerate(words):
            # separators between spelled digits go, so that a run of them reads as one number
            b = words[k + 1].start() if k + 1 < len(words) else w.end()
            between = tape.text[w.end():b]
            edits.append((w.start(), b if not between.strip(" ,-") else w.end(),
                          DIGIT_WORDS[w[0].lower()]))
    tape.rewrite(edits)


def _fold_marks(tape: Tape) -> None:
    """Rewrites disguised at and dot marks; bare words only where they form a whole address.

    Plain at signs start chains as well, for the disguised dots around them.
    """
    ats, dots = {*AT_WORDS, "@"}, {*DOT_WORDS, "."}
    marks = []
    for m in _MARK.finditer(tape.text):
        word = (m[1] or m[2] or m[3]).lower()
        marks.append((m.start(), m.end(), "@" if word in ats else ".", m[3] is not None))
    seen = {p for a, b, *_ in marks for p in range(a, b)}
    marks += [(p, p + 1, "@", False) for m in re.finditer("@", tape.text) if (p := m.start()) not in seen]
    marks.sort()
    edits = []
    k = 0
    while k < len(marks):
        a, b, sign, _ = marks[k]
        if sign != "@" or not a or tape.text[a - 1] not in LOCAL:
            k += 1
            continue
        # the chain of marks behind an at mark, with one domain label between each two
        chain, at, j = [k], b, k + 1
        while j < len(marks) and marks[j][2] == "." and re.fullmatch(
                r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*", tape.text[at:marks[j][0]]):
            chain.append(j)
            at, j = marks[j][1], j + 1
        back = k - 1  # dots of a dotted local part, in brackets only
        while back >= 0 and marks[back][2] == "." and not marks[back][3] and (
                marks[back][0] and tape.text[marks[back][0] - 1] in LOCAL) and re.fullmatch(
                r"[A-Za-z0-9._%+-]{1,64}", tape.text[marks[back][1]:marks[back + 1][0]]):
            chain.insert(0, back)
            back -= 1
        tail = re.match(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*", tape.text[at:at + 256])
        whole = tail and (j > k + 1 or "." in tail[0])
        # bare words alone need a dot word as well, or an ending that hosts have
        if whole and marks[k][3] and j == k + 1:
            whole = tail[0].rpartition(".")[2].lower() in ENDINGS
        if whole:
            edits += [(marks[c][0], marks[c][1], marks[c][2]) for c in chain]
        k = max(j, k + 1)
    tape.rewrite(sorted(edits))


def _extends(text: str, end: int, found: str) -> bool:
    """Whether a found address goes on behind a base address that ends there.

    Look-alike letters, invisible characters and brackets go on; dashes, stops and bare words may
    as well start the next phrase, so behind them the address must have an ending of hosts.
    """
    behind = text[end:end + 2].lstrip()[:1]
    sure = behind in tuple("([{<") or (behind == text[end] and (behind.isalnum() or behind in INVISIBLE))
    return sure or found.rpartition(".")[2].lower() in ENDINGS


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only after normalising; none of them lies inside a base span."""
    odd = not text.isascii() and _special().search(text) is not None
    tape = Tape(text)
    if odd:
        _fold_characters(tape)
    low = tape.text.lower()
    plus = "plus" in low
    spelled = not _DIGIT_SET.isdisjoint(low.replace("-", " ").replace(",", " ").split())
    marked = any(x in low for x in _BRACKETED) or (
        any(x in low for x in _BARE) and any(x in low for x in _BARE_NEXT)) or (
        "@" in low and _HIDDEN_DOT.search(low) is not None)
    dotted = any(x in low for x in _DOTTED)
    if not (odd or spelled or plus or marked or dotted):
        return []
    if spelled:
        _fold_digits(tape)
    if plus:
        tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    if dotted:
        tape.rewrite([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(tape.text)])
    if marked:
        _fold_marks(tape)
    if tape.text == text:
        return []
    taken = sorted((a, b, kind) for a, kind, b in base)
    starts = np.array([a for a, *_ in taken], np.int64)
    ends = np.array([b for _, b, _ in taken], np.int64)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    out = []
    for a, kind, b in base_spans(tape.text):
        lo, hi = int(tape.start[a]), int(tape.end[b - 1])
        if text[lo:hi] == tape.text[a:b]:
            continue  # nothing in it was disguised: the base rules have judged it
        k = int(np.searchsorted(starts, hi)) - 1
        keep = True
        while keep and k >= 0 and reach[k] > lo:  # the base spans it meets
            first, last, other = taken[k]
            if first <= lo and hi <= last:
                keep = False
            elif kind == other == 0 and lo < last < hi:
                keep = _extends(text, last, tape.text[a:b])
            k -= 1
        if keep:
            out.append((lo, kind, hi))
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def detect(docs: DataFrame) -> DataFrame:
    """The input's columns, then counts of base spans, their digest, and all spans.

    A null text counts as empty.  Rows are judged one by one; input columns of the same names
    stay as they are and the new ones get underscores in front.  Positions are code points, ends
    are exclusive.  An added span may hold base spans, never the other way round.
    """
    names = [fresh(docs.columns, c) for c in
             ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.LongType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches):
        for batch in batches:
            counts, digests, spans, more = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                extra = added_spans(text, base) if text else []
                counts.append([sum(k == n for _, k, _ in base) for n in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + extra))
                more.append(len(extra))
            table_of = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(table_of[:, n]) for n in range(4)),
                 pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                 pa.array(more, pa.int64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def redact(text: str | None) -> str | None:
    """The text with every span, base or added, replaced by its kind in brackets."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base), key=lambda s: (s[0], -s[2]))
    if not spans:
        return text
    parts, last = [], 0
    for a, kind, b in spans:
        if a >= last:
            parts += [text[last:a], f"[{KINDS[kind]}]"]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def scrub(docs: DataFrame) -> DataFrame:
    """The input with redacted texts; every other column and row stays."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array(map(redact, batch.column("text").to_pylist()),
                             batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")).drop("text")
