"""Vector planes that are stored once, and the nearest vectors of many queries at a time.

A plane row holds a block of vectors: ids, sign bits and int8 codes with a scale each. Queries are packed into
blocks as well; every block of vectors meets every block of queries in some task, as one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.vectors import POOL, POOL_FACTOR
from wayfold.store import table

#: Vectors and queries to a block.
BLOCK, ASKED = 2048, 256
PLANE = "n int, dim int, ids binary, signs binary, codes binary, scales binary"
QUERY = "n int, dim int, ids binary, asked binary"


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (1 for x >= 0), codes rounded half away from zero and scales (0 for a zero vector) of the rows of x."""
    scale = np.abs(x).max(1, initial=0) / 127
    part = x / np.where(scale == 0, 1, scale)[:, None]
    codes = np.clip(np.sign(part) * np.floor(np.abs(part) + 0.5), -127, 127).astype(np.int8)
    return np.packbits(x >= 0, axis=1), codes, scale


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of one length each, from rows (id, vector)."""
    held: dict[int, list] = {}
    for batch in batches:
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = held.setdefault(len(vector), [])
            own.append((key, vector))
            if len(own) == size:
                yield np.array([k for k, _ in own], np.int64), np.array([v for _, v in own], np.float64)
                own.clear()
    for own in held.values():
        if own:
            yield np.array([k for k, _ in own], np.int64), np.array([v for _, v in own], np.float64)


def _rows(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        kinds = [pa.int32() if n in ("n", "dim") else pa.binary() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def _plane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack() -> Iterator[tuple]:
        for ids, x in _blocks(batches, BLOCK):
            signs, codes, scale = quantized(x)
            yield len(ids), x.shape[1], ids.tobytes(), signs.tobytes(), codes.tobytes(), scale.tobytes()

    return _rows(pack(), [c.split()[0] for c in PLANE.split(", ")])


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The plane of vectors (PLANE), to be stored. Rows without an id, a vector or a number in it are left out."""
    whole = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(_plane, PLANE)


def _signs(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, -1), axis=1, count=dim).astype(np.float32) * 2 - 1


def _distances(row: dict) -> np.ndarray:
    """Differing sign bits of each query (row) and vector (column) of a pair of blocks."""
    asked = np.where(np.frombuffer(row["asked"]).reshape(row["m"], -1) >= 0, 1, -1).astype(np.float32)
    return ((row["dim"] - asked @ _signs(row["signs"], row["n"], row["dim"]).T) / 2).astype(np.int32)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many vectors lie at each distance of each query, summed over a task's blocks."""
    sums: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            d, top = _distances(row), row["dim"] + 1
            counts = np.bincount((d + np.arange(len(d))[:, None] * top).ravel(), minlength=len(d) * top).reshape(len(d), top)
            sums[row["qids"]] = sums.get(row["qids"], 0) + counts
    for ids, counts in sums.items():
        q, bits = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[q]), pa.array(bits.astype(np.int32)), pa.array(counts[q, bits])], ["query", "bits", "n"])


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query within its distance, of a task's blocks."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            ids, codes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.int8).reshape(row["n"], -1)
            near = _distances(row) <= np.frombuffer(row["limits"], np.int32)[:, None]
            scores = np.round(np.frombuffer(row["asked"]).reshape(row["m"], -1) @ codes.T.astype(np.float64) * np.frombuffer(row["scales"]), 6)
            for i, q in enumerate(np.frombuffer(row["qids"], np.int64).tolist()):
                at = np.flatnonzero(near[i])
                old = held.get(q, (np.zeros(0, np.int64), np.zeros(0)))
                keys, values = np.concatenate([old[0], ids[at]]), np.concatenate([old[1], scores[i, at]])
                order = np.lexsort((keys, -values))[:k]
                held[q] = keys[order], values[order]
    cols = [np.repeat(list(held), [len(v[0]) for v in held.values()]).astype(np.int64), *(np.concatenate([v[j] for v in held.values()] or [np.zeros(0)]) for j in range(2))]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])], ["query", "id", "score"])


def _meet(plane: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Every block of vectors beside every block of queries of its length: queries go to each of some groups of vectors.

    Always by a shuffle: Spark takes the repeated queries for as small as they were once, and would send them all through the driver.
    """
    asked = queries.select(F.col("n").alias("m"), "dim", F.col("ids").alias("qids"), "asked", *(c for c in ["limits"] if c in queries.columns), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    return plane.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).join(asked.hint("merge"), ["g", "dim"])


def batch_topk(plane: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pool: int = POOL) -> DataFrame:
    """The k nearest of each query (id_col, vec_col): query, id, score, rank from 1. Equal scores go by id.

    Scores are int8 dot products among the ``pool`` vectors nearest by sign bits and all others as near as the last of
    them. Two passes over the plane: distances are counted, which gives each query's limit, then those within it
    are scored. A task keeps k vectors a query; no pairs are written.
    """
    pool = max(pool, POOL_FACTOR * k)
    whole = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    rows = queries.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(((len(ids), x.shape[1], ids.tobytes(), x.tobytes()) for ids, x in _blocks(batches, ASKED)), ["n", "dim", "ids", "asked"])

    asked = table(rows.mapInArrow(pack, QUERY), "query-blocks")
    groups = int(plane.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _meet(plane.select("n", "dim", "ids", "signs"), asked, groups).mapInArrow(_histograms, "query long, bits int, n long").groupBy("query", "bits").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = counts.select("query", "bits", before.alias("before")).where(F.col("before") < pool).groupBy("query").agg(F.max("bits").alias("limit"))

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {x["query"]: x["limit"] for x in row["found"]}
                own = np.array([known.get(q, -1) for q in np.frombuffer(row["ids"], np.int64).tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["n"]], pa.int32()), pa.array([row["dim"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (row["ids"], row["asked"], own.tobytes()))], ["n", "dim", "ids", "asked", "limits"])

    where = _query_blocks(asked).join(limits.hint("merge"), "query").groupBy("ids").agg(F.collect_list(F.struct("query", "limit")).alias("found"))  # a block's queries
    ready = table(asked.join(where.hint("merge"), "ids").select("n", "dim", "ids", "asked", "found").mapInArrow(limited, f"{QUERY}, limits binary"), "query-limits")
    found = _meet(plane, ready, groups).mapInArrow(lambda b: _best(b, k), "query long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _query_blocks(asked: DataFrame) -> DataFrame:
    """ids (of a block) and query: which queries are in which block."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids] * len(own), pa.binary()), pa.array(own)], ["ids", "query"])

    return asked.select("ids").mapInArrow(flat, "ids binary, query long")
