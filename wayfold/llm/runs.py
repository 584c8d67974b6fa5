"""Periodic runs of words: factors from a suffix automaton, runs across factors, the others copied."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameter: words that a run has at least (and twice its period).
LEAST = 12
_MIX = np.uint64(0x9E3779B97F4A7C55)


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, source) of the factors of w, left to right.

    A factor is the longest stretch that also starts further left (at ``source``; the two may
    overlap), or one word that is new (source -1). The suffix automaton knows for every stretch where
    its first occurrence ends; time and memory are linear in w.
    """
    nxt, link, size, first, last = [{}], [-1], [0], [-1], 0
    for i, c in enumerate(w):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(i)
        p, last = last, cur
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            continue
        q = nxt[p][c]
        if size[p] + 1 != size[q]:
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            first.append(first[q])
            link[q] = copy
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            q = copy
        link[cur] = q
    out, i, n = [], 0, len(w)
    while i < n:
        at, j = 0, i
        while j < n and first[nxt[at][w[j]]] < j:
            at = nxt[at][w[j]]
            j += 1
        out.append((i, j - i, first[at] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def _common(w: Sequence[int]) -> list[int]:
    """For each place of w, how far the words from there agree with those from its start (0 for the start itself)."""
    n = len(w)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _touching(w: Sequence[int], lo: int, b: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of w[lo:hi] that touch or cross b, of at least ``least`` words.

    Main's way: how far to the left and right of b words agree with those one period on, for all periods at once.
    """
    x, y = w[lo:b], w[b:hi]
    nx, ny = len(x), len(y)
    back = [*x[::-1], -1, *y[::-1], *x[::-1]]
    ahead = [*y, -1, *x, *y]
    ls, lp = _common(back), _common(ahead)
    for p in range(1, ny + 1):  # a whole period lies to the right of b
        left, right = min(ls[nx + 1 + ny - p], nx), lp[p] if p < ny else 0
        if left + right >= p and p + left + right >= least:
            yield b - left, b + p + right, p
    for p in range(1, nx + 1):  # a whole period lies to the left of b
        left, right = ls[p] if p < nx else 0, min(lp[ny + 1 + nx - p], ny)
        if left + right >= p and p + left + right >= least:
            yield b - p - left, b + right, p


def runs(w: Sequence[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of w of at least ``least`` words, in order.

    A run that ends in a factor and starts before it reaches less than two lengths of the factor before
    and one of its own to the left of their border, so that the leftmost runs come from windows whose
    sizes add up to a multiple of w. A run inside a factor, away from its ends, is a copy of one where
    the factor occurred before.
    """
    n, parts = len(w), factors(w)
    found: dict[int, dict[int, int]] = {}
    for k in range(1, len(parts) + 1):
        before = parts[k - 1]
        b, own = (parts[k][0], parts[k][1]) if k < len(parts) else (n, 0)
        for s, e, p in _touching(w, max(0, b - 2 * before[1] - own), b, b + own, least):
            if (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p]):
                ends = found.setdefault(s, {})
                ends[e] = min(p, ends.get(e, p))
    for start, size, source in parts:
        if source >= 0 and size > least:
            shift = start - source
            for s in range(start + 1, start + size - least):
                for e, p in list(found.get(s - shift, {}).items()):
                    if e + shift < start + size:
                        found.setdefault(s, {})[e + shift] = p
    return [(s, e, p) for s in sorted(found) for e, p in sorted(found[s].items())]


def stretches(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches of words that can hold a run of at least ``least`` words.

    In such a run at least half of its words, so ``least // 2``, agree with those one period on. So
    every word of it lies in a window of that many words that occurs twice; all others are passed over.
    Windows are told apart by hashes, of which equal ones only make stretches longer.
    """
    k = least // 2
    if k < 1 or len(ids) < least:
        yield from [(0, len(ids))] if len(ids) >= least else []
        return
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _MIX + ids[j : len(ids) - k + 1 + j].astype(np.uint64)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    at = np.flatnonzero(np.isin(h, twice))
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    inside = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(inside))
    for a, z in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        if z - a >= least:
            yield a, z


def _rows(batches: Iterator[pa.RecordBatch], least: int, order: Callable[[str | None, int], np.ndarray | None] | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        found, texts = [], []
        for row_id, text in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or b"").split()  # bytes are cut at ASCII white space alone
            moved = order(row_id.as_py(), len(words)) if order else None
            if moved is not None:
                words = [words[i] for i in moved.tolist()]
            known: dict[bytes, int] = {}
            ids = np.fromiter(map(known.setdefault, words, range(len(words))), np.int64, len(words))
            own, gone = [], np.zeros(len(words) + 1, np.int64)
            for a, z in stretches(ids, least):
                for s, e, p in runs(ids[a:z].tolist(), least):
                    own.append({"start": a + s, "length": e - s, "period": p})
                    gone[a + s + p] += 1
                    gone[a + e] -= 1
            if own:
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
            found.append(own)
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary())], ["id", "runs", "collapsed"])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, order: Callable[[str | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Return id_col, runs (array of start, length, period in words) and collapsed (the text without repeats).

    Words are cut at ASCII white space. A run is a stretch of at least ``least`` words and two periods
    that no neighbouring word extends; a word is dropped if a run contains it after the first period.
    ``order`` may give the row numbers in which an id's words are taken instead.

    One row per row, found where the text lies, without a shuffle. Null and empty texts have no runs and
    an empty collapsed text; a null id is kept; repeated rows are treated alike; an empty table gives no
    rows; other columns are left out, whatever their names. Time is linear in a text but for one sort, memory about
    half a kilobyte a word of stretches that repeat, so that one long text is the largest thing in a task.
    """
    key = F.col(id_col)
    slim = docs.select(key.alias("id"), key.cast("string").alias("name"), F.col(text_col).cast("binary").alias("text"))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    out = slim.mapInArrow(lambda batches: _rows(batches, least, order), kinds)
    return out.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _made_periodic(name: str | None, n: int) -> np.ndarray | None:
    """The contract's order of words: every tenth document repeats from a word on; None for the others."""
    if name is None or not n:
        return None
    h = zlib.crc32(name.encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the contract's repeats, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = word_runs(docs, order=_made_periodic)
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))[0]
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    told = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
