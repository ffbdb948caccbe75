"""Terms of a lexicon within a bounded edit distance of a token."""

from __future__ import annotations

import numpy as np

from ticketlens.llm.features import mix, slot

PIECE_BITS = 16


def piece(a, b, c):
    """Hash of up to three characters, for one piece or for arrays of pieces."""
    a, b, c = (np.asarray(x, np.uint32) for x in (a, b, c))
    with np.errstate(over="ignore"):
        return slot(mix(a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
                        + c * np.uint32(0xC2B2AE3D)), PIECE_BITS)


def allowed(term: str) -> int:
    """Edits that a term of this length may carry."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Lexicon trie; every node has its children and the term that ends there."""

    def __init__(self, terms):
        self.root = ({}, None)
        for term in sorted(terms):
            node = self.root
            for c in term[:-1]:
                node = node[0].setdefault(c, ({}, None))
            last = term[-1]
            old = node[0].get(last)
            node[0][last] = (old[0] if old else {}, term)


class Automaton:
    """Levenshtein automaton of one token: a set of states per number of edits, as bits.

    Bit i of level e is set when the first i characters of the token can be turned into the
    input so far with e edits.
    """

    def __init__(self, token: str, edits: int):
        self.edits, self.size = edits, len(token)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(token):
            self.masks[c] = self.masks.get(c, 0) | (1 << (i + 1))
        self.limit = (1 << (len(token) + 1)) - 1

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (e + 1)) - 1 & self.limit for e in range(self.edits + 1))

    def step(self, states: tuple[int, ...], char: str) -> tuple[int, ...]:
        mask = self.masks.get(char, 0)
        out, below = [], 0
        for e, s in enumerate(states):
            now = (s << 1) & mask
            if e:
                old = states[e - 1]
                # a character inserted, replaced, or dropped after the step one level below
                now |= old | (old << 1) | (below << 1)
            below = now & self.limit
            out.append(below)
        return tuple(out)

    def distance(self, states: tuple[int, ...]) -> int | None:
        for e, s in enumerate(states):
            if s >> self.size & 1:
                return e
        return None


def nearest(token: str, trie: Trie, edits: int) -> tuple[str, int] | None:
    """Closest term that its own length allows, and the distance; ties go to the first term."""
    automaton = Automaton(token, edits)
    best = None
    stack = [(trie.root, automaton.start())]
    while stack:
        (children, term), states = stack.pop()
        if term is not None:
            d = automaton.distance(states)
            if d is not None and d <= allowed(term) and (best is None or (d, term) < best):
                best = (d, term)
        for c, child in children.items():
            after = automaton.step(states, c)
            if after[-1]:
                stack.append((child, after))
    return (best[1], best[0]) if best else None


class Matcher:
    """Finds terms and misspelled terms among the tokens of many texts at once.

    A token within one edit of a term keeps its first two or its last three characters, one
    within two edits its first, its last or, shifted by one place at most, its middle three.  A
    hash table over such pieces picks the tokens that are walked through the trie; the answers
    are remembered, up to a bounded number.
    """

    def __init__(self, terms, remember: int = 200_000):
        self.trie, self.remember, self.exact = Trie(terms), remember, set(terms)
        self.known: dict[str, tuple[str, int] | None] = {}
        self.sizes = np.zeros(256, bool)
        self.whole = np.zeros(1 << PIECE_BITS, bool)  # hash of three at the start, exact terms
        self.head2, self.head3 = self.whole.copy(), self.whole.copy()
        self.tail3 = self.whole.copy()
        self.middle: dict[int, np.ndarray] = {}
        for t in terms:
            d = allowed(t)
            c = np.fromiter(map(ord, t + "\0\0\0"), np.uint32)
            for n in range(len(t) - d, len(t) + d + 1):
                if n < len(self.sizes):
                    self.sizes[n] = True
            self.whole[piece(c[0], c[1], c[2] * np.uint32(len(t) > 2))] = True
            if not d:
                continue
            self.tail3[piece(*c[len(t) - 3:len(t)])] = True
            if d == 1:
                self.head2[piece(c[0], c[1], np.uint32(0))] = True
            else:
                self.head3[piece(*c[:3])] = True
                a = len(t) // 3
                for at in (a - 1, a, a + 1):
                    self.middle.setdefault(at, np.zeros(1 << PIECE_BITS, bool))[piece(*c[a:a + 3])] = True

    def candidates(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the tokens codes[starts:ends] that can be near a term."""
        size = ends - starts
        at = np.flatnonzero(self.sizes[np.minimum(size, 255)] & (size < 255))
        s, e, n = starts[at], ends[at], size[at]
        padded = np.concatenate([codes, np.zeros(8, codes.dtype)])

        def three(i, long):
            return piece(padded[i], padded[i + 1], padded[i + 2] * long)

        zero = np.uint32(0)
        hit = self.whole[three(s, (n > 2).astype(np.uint32))]
        hit |= self.head2[three(s, zero)] | self.head3[three(s, np.uint32(1))]
        hit |= (n >= 4) & self.tail3[three(np.maximum(e - 3, 0), np.uint32(1))]
        for k, table in self.middle.items():
            hit |= (n >= k + 3) & table[three(s + k, np.uint32(1))]
        return at[hit]

    def match(self, token: str) -> tuple[str, int] | None:
        """The nearest term and its distance."""
        if token in self.known:
            return self.known[token]
        found = (token, 0) if token in self.exact else nearest(token, self.trie, 2)
        if len(self.known) >= self.remember:
            self.known.clear()
        self.known[token] = found
        return found
