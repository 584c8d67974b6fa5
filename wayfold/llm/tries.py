"""Byte tries of terms with counters a source at their leaves, kept flat in pre-order (helpers that run inside tasks).

A leaf is held as the depth at which it leaves the branch of the leaf before it, and its own bytes
from there on. Leaves are in byte order, so a subtrie is a stretch of them, and cutting, merging and
walking a trie work on arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Depth that is written for a leaf at most; deeper common beginnings are written again.
DEEPEST = 255
FIELDS = {"shared": np.uint8, "length": np.uint32, "tails": np.uint8, "docs": np.int64, "width": np.uint32, "code": np.uint32, "n": np.int64}
PIECE = "lang string, prefix binary, counters long, sources array<string>, " + ", ".join(f"{f} binary" for f in FIELDS)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and each value summed over its key's rows."""
    if not len(key):
        return (key, *values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first], *(np.add.reduceat(v[order], first) for v in values))


def binary(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """An Arrow column of the values that lie one behind the other in data."""
    off = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def parts(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary column without nulls."""
    off = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    raw = terms.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


@dataclass
class Trie:
    """terms in byte order; docs a leaf; for each counter its leaf (at, ascending), its source's code and its number."""

    terms: pa.Array
    docs: np.ndarray
    at: np.ndarray
    code: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, terms: pa.Array, docs: np.ndarray, at: np.ndarray, code: np.ndarray, n: np.ndarray) -> Trie:
        """From leaves in any order, some of them of one term: their counters are added."""
        if not len(terms):
            return cls(terms, docs, at, code, n)
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        leaf = rank[coded.indices.to_numpy()]
        codes = int(code.max(initial=0)) + 1
        key, n = summed(leaf[at] * codes + code, n)
        _, docs = summed(leaf, docs)
        return cls(coded.dictionary.take(pa.array(order)), docs, key // codes, key % codes, n)

    def cuts(self, keys: list[bytes]) -> list[tuple[int, int]]:
        """Stretches of leaves of one key each, for keys in the order of the leaves."""
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        return list(zip(edges[:-1], edges[1:], strict=True)) if keys else []

    def pieces(self, lang: str, names: list[str], keys: list[bytes]) -> Iterator[dict]:
        """The subtries of each key as rows of PIECE; names: the sources by code."""
        data, off = parts(self.terms)
        length = np.diff(off)
        shared = np.zeros(len(length), np.int64)
        most, alive = np.minimum(np.minimum(length[1:], length[:-1]), DEEPEST), np.arange(1, len(length))
        depth = 0
        while len(alive):
            alive = alive[most[alive - 1] > depth]
            alive = alive[data[off[alive] + depth] == data[off[alive - 1] + depth]]
            shared[alive] += 1
            depth += 1
        first = np.searchsorted(self.at, np.arange(len(length) + 1))
        for a, z in self.cuts(keys):
            own = shared[a:z].copy()
            own[0] = 0
            keep = np.ones(off[z] - off[a], bool)
            step = np.zeros(len(keep) + 1, np.int64)
            np.add.at(step, off[a:z] - off[a], 1)
            np.add.at(step, off[a:z] - off[a] + own, -1)
            keep &= np.cumsum(step)[:-1] == 0
            used, code = np.unique(self.code[first[a] : first[z]], return_inverse=True)
            flat = {"shared": own, "length": length[a:z], "tails": data[off[a] : off[z]][keep], "docs": self.docs[a:z], "width": np.diff(first[a : z + 1]), "code": code, "n": self.n[first[a] : first[z]]}
            yield {"lang": lang, "prefix": keys[a], "counters": int(first[z] - first[a]), "sources": [names[c] for c in used]} | {f: flat[f].astype(kind).tobytes() for f, kind in FIELDS.items()}


def unpacked(row: dict, codes: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves and counters of a row of PIECE; codes gets new sources."""
    f = {name: np.frombuffer(row[name], kind).astype(np.int64 if name != "tails" else np.uint8) for name, kind in FIELDS.items()}
    shared, length = f["shared"], f["length"]
    off, tail = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length - shared)])
    data = np.empty(off[-1], np.uint8)
    own = np.arange(off[-1]) - np.repeat(off[:-1], length)  # the depth of each byte
    data[own >= np.repeat(shared, length)] = f["tails"]
    leaf = np.arange(len(length))
    for depth in range(int(shared.max(initial=0))):
        source = np.maximum.accumulate(np.where(shared <= depth, leaf, 0))  # the leaf that last wrote this depth
        need = np.flatnonzero(shared > depth)
        data[off[need] + depth] = f["tails"][tail[source[need]] + depth - shared[source[need]]]
    code = np.array([codes.setdefault(s, len(codes)) for s in row["sources"]], np.int64)
    return binary(data, length), f["docs"], np.repeat(leaf, f["width"]), code[f["code"]], f["n"]


def merged(found: Iterable[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
    """One trie of several lists of leaves and counters."""
    found = list(found)
    first = np.cumsum([0, *(len(x[0]) for x in found)])
    terms = pa.concat_arrays([x[0] for x in found]) if found else pa.array([], pa.large_binary())
    docs, at, code, n = (np.concatenate([x[k] + (first[i] if k == 2 else 0) for i, x in enumerate(found)] or [np.zeros(0, np.int64)]) for k in range(1, 5))
    return Trie.of(terms, docs, at, code, n)
