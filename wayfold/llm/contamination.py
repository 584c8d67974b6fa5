"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.tokens import slices

#: Passages are windows of an item of so many bytes, so far apart, and match within RATE edits a byte.
Q, WINDOWS, RATE = 8, ((96, 48), (48, 3)), 0.1
#: Any part of an item of PASSAGE bytes holds a whole window of the small kind, so it is found if it has 4 edits at most.
PASSAGE = min(w + step - 1 for w, step in WINDOWS)
#: Items of fewer bytes than this, normalised, are too common a phrase to be told from chance.
SHORTEST = 24
#: Places of items that are looked at together.
SHARE = 1 << 20
#: Bytes of items that one pass over the documents looks for; an index takes about 40 times as much in each task.
BLOCK_BYTES = 1 << 20


def normal(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits are one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[: max(0, len(x) - shift)] | (x[shift:] << np.uint64(8 * shift))
    return x


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its count, one run after another."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(many.sum())


def edits_of(size):
    """Edits that a window of so many bytes may have: RATE a byte, fewer where the q-gram lemma would else ask for no gram."""
    return np.minimum((np.asarray(size) * RATE).astype(np.int64), np.maximum(np.asarray(size) - Q, 0) // Q)


def starts(size: int, width: int, step: int) -> list[int]:
    """Where windows of one kind begin in an item of so many bytes; a shorter item is one window."""
    last = max(0, size - width)
    return [*range(0, last, step), last]


class Items:
    """Items of one block with an index from q-grams to their places."""

    def __init__(self, items: Sequence[tuple[int, str]], shortest: int = SHORTEST):
        kept = [(i, t.encode()) for i, t in items if len(t.encode()) >= max(shortest, Q)]
        self.item = np.array([i for i, _ in kept], np.int64)
        self.size = np.array([len(t) for _, t in kept], np.int64)
        self.data = np.frombuffer(b"".join(t for _, t in kept), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        found = [grams(self.data[b : b + n]) for b, n in zip(self.begin, self.size, strict=True)]
        gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(kept), dtype=np.int32), self.size - Q + 1)
        place = _runs(np.zeros(len(kept), np.int64), self.size - Q + 1).astype(np.int32)
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[_slot(self.gram)] = True
        #: By kind: window size, edits and least shared grams of each item. The lemma: e edits destroy at most Q * e grams.
        self.kinds = []
        for width, step in WINDOWS:
            size = np.minimum(self.size, width)
            edits = edits_of(size)
            self.kinds.append((width, step, size, edits, np.maximum(size - Q + 1 - Q * edits, 1)))

    def _hits(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, item, place in the item and position in the row of shared grams, of those that lie dense enough for some window.

        In parts of about SHARE places of items, however common a gram is; a part goes on until
        every window that begins in it has ended, so parts overlap and each window is whole in one.
        """
        g = grams(data)
        if not len(g) or not len(self.gram):
            return
        at = np.flatnonzero(self.maybe[_slot(g)])
        k = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        real = self.gram[k] == g[at]
        at, k = at[real], k[real]
        row = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[row + 1]
        at, k, row = at[inside], k[inside], row[inside]
        # of any item at all
        dense, reach = np.zeros(len(at), bool), 0
        for _, _, size, edits, least in self.kinds:
            few, span = int(least.min()), int((size + edits).max()) - Q
            dense |= _dense(row, at, np.full(len(at), few), np.full(len(at), span))
            reach = max(reach, int((size + 6 * edits).max()) + 6)
        at, k, row = at[dense], k[dense], row[dense]
        many = self.count[k]
        total, lo = np.concatenate([[0], np.cumsum(many)]), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SHARE, "right")) - 1)
            to = int(np.searchsorted(at, at[hi - 1] + reach, "right"))
            yield self._of_items(row[lo:to], at[lo:to], k[lo:to], off)
            lo = hi

    def _of_items(self, row: np.ndarray, at: np.ndarray, k: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        many = self.count[k]
        entry = _runs(self.first[k], many)
        owner, place = self.owner[entry], self.place[entry]
        at, row = np.repeat(at, many), np.repeat(row, many)
        # in the order of positions within each row and item
        key = row * len(self.item) + owner
        order = np.argsort(key, kind="stable")
        key, owner, place, at, row = key[order], owner[order], place[order], at[order], row[order]
        dense = np.zeros(len(at), bool)
        for _, _, size, edits, least in self.kinds:
            dense |= _dense(key, at, least[owner], (size + edits)[owner] - Q)
        return row[dense], owner[dense].astype(np.int64), place[dense].astype(np.int64), at[dense] - off[row[dense]]

    def regions(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """By kind: rows (row, item, window's start, least diagonal) of windows with enough shared grams in a band of diagonals."""
        for row, owner, place, at in self._hits(data, off):
            for kind in range(len(self.kinds)):
                yield kind, self._windows(kind, row, owner, place, at)

    def _windows(self, kind: int, row: np.ndarray, owner: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        width, step, size, edits, least = self.kinds[kind]
        band_width = 2 * edits[owner] + 1
        out = [np.zeros((0, 4), np.int64)]
        for shift in (0, 1):  # bands of two widths, one width apart: any match lies in one of them
            band = ((at - place) // band_width + shift) // 2
            order = np.lexsort((place, band, owner, row))
            r, o, b, p = row[order], owner[order], band[order], place[order]
            fresh = np.ones(len(r), bool)  # a gram of the item counts once a band
            same = lambda x: x[1:] == x[:-1]
            fresh[1:] = ~(same(r) & same(o) & same(b) & same(p))
            r, o, b, p = r[fresh], o[fresh], b[fresh], p[fresh]
            if not len(r):
                continue
            end = np.arange(len(r)) + least[o] - 1
            to = np.minimum(end, len(r) - 1)
            full = (end < len(r)) & (r[to] == r) & (o[to] == o) & (b[to] == b) & (p[to] - p <= size[o] - Q)
            first, last = np.maximum(p[to] + Q - size[o], 0)[full], np.minimum(p, self.size[o] - size[o])[full]
            r, o, b = r[full], o[full], b[full]
            # the windows of the grid that hold these grams; the last one need not be on it
            lo, hi = -(-first // step), last // step
            many = np.maximum(hi - lo + 1, 0)
            low = (2 * b - shift) * (2 * edits[o] + 1)
            grid = np.stack([np.repeat(r, many), np.repeat(o, many), _runs(lo, many) * step, np.repeat(low, many)], axis=1)
            ends = last == (self.size - size)[o]
            out += [grid, np.stack([r, o, last, low], axis=1)[ends]]
        return np.unique(np.concatenate(out), axis=0)


def _dense(key: np.ndarray, at: np.ndarray, least: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Of hits ordered by key and position: those of some ``least`` hits in a row that lie within ``span`` positions."""
    n = len(key)
    if not n:
        return np.zeros(0, bool)
    end = np.arange(n) + least - 1
    to = np.minimum(end, n - 1)
    ok = (end < n) & (key[to] == key) & (at[to] - at <= span)
    change = np.bincount(np.flatnonzero(ok), minlength=n + 1) - np.bincount(to[ok] + 1, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def banded(passages: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each passage and any part of its region within the band, and where that part ends.

    passages: a row of bytes each, of which the first sizes[r] count. regions: passages' width plus
    the band's width of bytes each; column j of row i lies on diagonal j - i. All rows advance one
    byte of their passage at a time; a step is a minimum over the band's diagonals.
    """
    rows, width = len(passages), regions.shape[1] - passages.shape[1]
    cost = np.zeros((rows, width), np.int16)
    steps = np.arange(width, dtype=np.int16)
    best, ends = np.full(rows, 32767, np.int64), np.zeros(rows, np.int64)
    for i in range(passages.shape[1]):
        take = cost + (regions[:, i : i + width] != passages[:, i : i + 1])
        take[:, :-1] = np.minimum(take[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(take - steps, axis=1) + steps
        done = np.flatnonzero(sizes == i + 1)
        at = cost[done].argmin(axis=1)
        best[done], ends[done] = cost[done, at], i + 1 + at
    return best, ends


def _matches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for first, data, off in slices(batch.column(1)):
            seen: dict[tuple[int, int], list] = {}
            for kind, found in items.regions(data, off):
                _, _, size, edits, _ = items.kinds[kind]
                for part in (found[i : i + 4096] for i in range(0, len(found), 4096)):
                    row, owner, begin, low = part.T
                    most, long = int(edits[owner].max()), int(size[owner].max())
                    inner = np.arange(long) < size[owner][:, None]
                    passage = np.where(inner, items.data[np.minimum((items.begin[owner] + begin)[:, None] + np.arange(long), len(items.data) - 1)], 0).astype(np.uint8)
                    start = begin + low - edits[owner]
                    place = start[:, None] + np.arange(long + 2 * (2 * most + 1) + 2 * most)
                    inside = (place >= 0) & (place < (off[row + 1] - off[row])[:, None])
                    region = np.where(inside, data[np.clip(off[row][:, None] + place, 0, len(data) - 1)], 0).astype(np.uint8)
                    least, ends = banded(passage, size[owner], region)
                    for k in np.flatnonzero(least <= edits[owner]):
                        hit = [int(least[k]), int(start[k] + ends[k])]
                        old = seen.setdefault((int(row[k]), int(items.item[owner[k]])), [set(), *hit])
                        old[0].add((kind, int(begin[k])))
                        old[1:] = min(old[1:], hit)
            out += [(ids[first + row].as_py(), item, len(w), e, end) for (row, item), (w, e, end) in sorted(seen.items())]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item", "passages", "edits", "ends"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """Return id_col, item_col, passages, edits, ends: one row per document and item of which it holds a passage.

    passages counts the item's windows that match, edits is the least of their edits, ends where
    that match ends (bytes of the normalised text). Any PASSAGE bytes of an item (about 8 words) are
    found with up to 4 edits, shorter items as a whole with RATE edits a byte. Documents are read and
    not shuffled. Items are the query set: they are sent to the tasks in blocks of bounded bytes,
    one pass over the documents a block, whose matches are written before the next is sent.

    Null and empty texts and items match nothing, nor do items under ``shortest`` bytes (8, the size
    of a gram, at least); a row with a null id is matched under that id; repeated rows are all
    matched; other columns, whatever their names, are ignored; an empty benchmark or table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), normal(F.col(item_text)).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), normal(F.col(text_col)).alias("text"))
    out = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        # plain values, so that executors need not have this package to read them
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in block])
        found = slim.mapInArrow(lambda it, sent=sent: _matches(it, Items(sent.value, shortest)), "id long, item long, passages long, edits long, ends long")
        out.append(table(found, "contaminated"))
        sent.destroy()
    return reduce(DataFrame.unionByName, out).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "passages", "edits", "ends")


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items; documents without any aren't listed."""
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows of a null id go together if one of them holds one."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")
