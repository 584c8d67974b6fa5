"""Stored vector planes against exact search and the single-query form."""

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import planes, vectors


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n // 10, dim))[r.integers(0, n // 10, n)] + 0.3 * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def topk(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.id, r.score))
    return out


def test_planes_hold_what_the_column_form_computes(spark):
    x = np.array([[0.5, -1.0, 0.0, 1e-9] + [0.25] * 37, [0.0] * 41, [-0.5 / 127, 127.0, 63.5, -63.5] + [0.0] * 37])
    signs, codes, scale = planes.quantized(x)
    want = frame(spark, range(3), x).select("vec_id", vectors.quantize(F.col("embedding")).alias("q"), vectors.binarize(F.col("embedding")).alias("b")).orderBy("vec_id").collect()
    for i, r in enumerate(want):
        assert r.q.codes == codes[i].tolist() and r.q.scale == scale[i]
        bits = "".join(f"{w:0{min(32, 41 - 32 * k)}b}" for k, w in enumerate(r.b))
        assert bits == "".join(map(str, np.unpackbits(signs[i], count=41)))


def test_batches_equal_single_queries_and_recall_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(planes, "BLOCK", 64)
    monkeypatch.setattr(planes, "ASKED", 3)
    x = clustered(600, 48, 1)
    df = frame(spark, range(600), x).repartition(3)
    plane = planes.build(df).cache()
    asked = [0, 100, 200, 300, 400, 500, 599]
    got = topk(planes.batch_topk(plane, df.where(F.col("vec_id").isin(asked)), 10, pool=160))
    exact = {q: set(np.lexsort((np.arange(600), -(x @ x[q])))[:10].tolist()) for q in asked}
    assert np.mean([len(exact[q] & {i for i, _ in got[q]}) / 10 for q in asked]) >= 0.9
    signs, codes, scale = planes.quantized(x)
    bits = np.unpackbits(signs, axis=1).astype(int)
    for q in asked:
        d = (bits != bits[q]).sum(1)
        near = np.flatnonzero(d <= np.sort(d)[159])
        score = np.round(codes[near].astype(float) @ x[q] * scale[near], 6)
        assert got[q] == [(int(near[j]), score[j]) for j in np.lexsort((near, -score))[:10]]
    one = vectors.two_stage_topk(df, x[100].tolist(), 10, pool=600).collect()
    every = topk(planes.batch_topk(plane, df.where("vec_id = 100"), 10, pool=600))
    assert every[100] == [(r.vec_id, r.score) for r in one]


def test_ties_odd_rows_lengths_and_no_rows(spark):
    rows = [(7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (5, None), (6, []), (8, [float("nan"), 1.0]), (20, [1.0, 0.0, 0.0]), (21, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plane = planes.build(df)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<double>")
    assert topk(planes.batch_topk(plane, asked, 2)) == {1: [(3, 1.0), (7, 1.0)], 2: [(20, 1.0), (21, 0.0)]}
    assert planes.batch_topk(plane, asked.limit(0), 2).count() == 0 and planes.batch_topk(planes.build(df.limit(0)), asked, 2).count() == 0
    # a plane grows by rows of its own; of an allowlist, a plane of these ids is made
    more = plane.unionByName(planes.build(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")))
    assert [i for i, _ in topk(planes.batch_topk(more, asked, 2))[1]] == [1, 3]
    assert topk(planes.batch_topk(planes.build(df.where("vec_id = 9")), asked, 10)) == {1: [(9, 0.0)]}


def test_queries_never_go_through_the_driver(spark):
    """However small the tables look, blocks of queries are shuffled to blocks of vectors."""
    plane = spark.createDataFrame([(0, 4, b"", b"", b"", b"")], planes.PLANE)
    asked = spark.createDataFrame([(0, 4, b"", b"")], planes.QUERY)
    assert "Broadcast" not in planes._meet(plane, asked, 4)._jdf.queryExecution().executedPlan().toString()
