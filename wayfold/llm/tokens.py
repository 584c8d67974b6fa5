"""Vectorised words and word shingles of Arrow string columns (helpers that run inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are cut at a time; a longer single text is one slice of its own.
SLICE_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column (nulls count as empty) into (first row, bytes, offsets) of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of every word; rows are the texts between ``off``, ``space`` tells which bytes are no part of words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~space[data]
    inner = off[(off > 0) & (off < n)]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word after lower-casing A-Z."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_P, n)[:n], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[start]) * _powers(_P_INV, n)[start] + (end - start).astype(np.uint64) * _Q)


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, the row of each, and the number of words of each row.

    A row of fewer words has one shingle: the whole sequence.
    """
    count = np.bincount(row, minlength=rows)
    h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h = h * _Q + words[j : len(words) - k + 1 + j]
        same = row[: len(h)] == row[k - 1 :]
        h, at = mix64(h[same] + np.uint64(k)), row[: len(same)][same]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        g = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            g[has] = g[has] * _Q + words[first[has] + j]
        h, at = np.concatenate([h, mix64(g + count[short].astype(np.uint64) * _P)]), np.concatenate([at, short])
    return h, at, count


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text of a column, in order, the sorted distinct hashes of its k-word shingles."""
    for _, data, off in slices(texts):
        start, end, row = word_bounds(data, off)
        h, at, _ = shingle_hashes(word_hashes(data, start, end), row, len(off) - 1, k)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[fresh], at[fresh]
        cut = np.searchsorted(at, np.arange(len(off)))
        for i in range(len(off) - 1):
            yield h[cut[i] : cut[i + 1]]
