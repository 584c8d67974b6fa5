"""Levenshtein automata intersected with a lexicon trie, as one table-driven automaton over bytes."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

from wayfold.llm.tokens import word_hashes

#: Edits that a term allows, by its length in bytes: none below 5, one from 5, two from 9.
EDITS = ((9, 2), (5, 1), (0, 0))
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = True
#: Terms that share one automaton: its states grow faster than its terms.
TERMS_A_PART = 25


@dataclass
class Automaton:
    """step[state, byte class] -> state; found[state] = term * 4 + edits, or -1. State 0 starts, 1 is dead."""

    classes: np.ndarray
    step: np.ndarray
    found: np.ndarray

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each token of data, found[] of the state it ends in; all tokens advance a byte at a time together."""
        out = np.full(len(start), -1, np.int32)
        at, state, k = np.arange(len(start)), np.zeros(len(start), np.int32), 0
        while len(at):
            ends = start[at] + k == end[at]
            if ends.any():
                out[at[ends]] = self.found[state[ends]]
                at, state = at[~ends], state[~ends]
            state = self.step[state, self.classes[data[start[at] + k]]]
            live = state != 1
            at, state, k = at[live], state[live], k + 1
        return out


def allowed(term: bytes) -> int:
    return next(e for n, e in EDITS if len(term) >= n)


@dataclass
class Lexicon:
    """Automata of (first term, automaton); match() as of one automaton over all terms, each distinct token matched once."""

    parts: list[tuple[int, Automaton]]

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        out = np.full(len(first), -1, np.int32)
        for base, part in self.parts:
            got = part.match(data, start[first], end[first])
            nearer = (got >= 0) & ((out < 0) | (got % 4 < out % 4))
            out[nearer] = got[nearer] + 4 * base
        return out[back]


def build_parts(terms: Sequence[str], anchored: bool = True) -> Lexicon:
    return Lexicon([(i, build(terms[i : i + TERMS_A_PART], anchored)) for i in range(0, len(terms), TERMS_A_PART)])


def build(terms: Sequence[str], anchored: bool = True) -> Automaton:
    """The automaton of all strings within the allowed edits of a term; anchored, a term's first byte must match.

    Its states are the sets of (trie node, edits so far) that the read bytes can lead to; a node
    remembers the most edits that any term below it allows.
    """
    words = [t.encode() for t in terms]
    children, most, ends = [{}], [0], [None]
    for i, w in enumerate(words):
        node = 0
        for c in w:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                most.append(0)
                ends.append(None)
            node = children[node][c]
            most[node] = max(most[node], allowed(w))
        ends[node] = i
    alphabet = sorted({c for w in words for c in w})
    classes = np.zeros(256, np.int32)
    for k, c in enumerate(alphabet, 1):
        classes[c] = k
        if 97 <= c <= 122:
            classes[c - 32] = k

    def closed(pairs) -> frozenset:
        """With deletions of term bytes; of one node's edit counts only the least matters."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e <= most[node] and e < best.get(node, 9):
                best[node] = e
                todo += [(x, e + 1) for x in children[node].values()]
        return frozenset(best.items())

    def advance(state: frozenset, c: int | None) -> frozenset:
        nxt = []
        for node, e in state:
            if c in children[node]:
                nxt.append((children[node][c], e))
            nxt.append((node, e + 1))
            nxt += [(x, e + 1) for x in children[node].values()]
        return closed(nxt)

    numbers: dict[object, int] = {"start": 0, frozenset(): 1}
    rows, todo = {}, []

    def number(state: frozenset) -> int:
        if state not in numbers:
            numbers[state] = len(numbers)
            todo.append(state)
        return numbers[state]

    if anchored:
        rows[0] = [1, *[number(closed([(children[0][c], 0)])) if c in children[0] else 1 for c in alphabet]]
    else:
        most[0] = max(map(allowed, words), default=0)
        rows[0] = [number(advance(closed([(0, 0)]), c)) for c in (None, *alphabet)]
    rows[1] = [1] * (len(alphabet) + 1)
    while todo:
        state = todo.pop()
        rows[numbers[state]] = [number(advance(state, c)) for c in (None, *alphabet)]
    found = np.full(len(numbers), -1, np.int32)
    for state, k in numbers.items():
        if k > 1:
            hits = [(e, ends[node]) for node, e in state if ends[node] is not None and e <= allowed(words[ends[node]])]
            if hits:
                e, term = min(hits)
                found[k] = term * 4 + e
    return Automaton(classes, np.array([rows[k] for k in range(len(rows))], np.int32), found)


@cache
def _wordy() -> np.ndarray:
    """Of each code point, whether it is a letter or a number."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def _in_words(data: np.ndarray) -> np.ndarray:
    word = TOKEN[data]
    if (data >= 128).any():
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        if size.sum() == len(data):
            word = np.repeat(_wordy()[points], size)
    return word


def token_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of runs of letters and numbers, as [\\p{L}\\p{N}]+ cuts them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = _in_words(data)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < n)]
    begins[inner], ends[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1
