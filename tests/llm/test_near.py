import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from wayfold.llm import near, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, text) -> {doc_id: (n, component)} from all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Ä", "Über"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = words(rng.choice(rows[-20:])[1] or "x")
            for _ in range(rng.randrange(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            text = rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.2 else x for x in w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 8, 30, 80, 200])))
        rows.append((i * 7 % 1009, text))
    return rows


def test_shingle_sets_count_like_a_plain_loop():
    rows = corpus(200) + [(5000, None), (5001, " \n"), (5002, "a" * 100000), (5003, "x " * 50000), (5004, "")]
    got = list(tokens.shingle_sets(pa.array([t for _, t in rows], pa.string()), 5))
    seen = {}
    for (_, t), g in zip(rows, got, strict=True):
        want = shingles(t)
        assert len(g) == len(want) and np.all(np.diff(g.astype(object)) > 0)
        assert seen.setdefault(frozenset(want), g.tobytes()) == g.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_small_slices_change_nothing(monkeypatch):
    texts = pa.array([t for _, t in corpus(50)])
    whole = [x.tobytes() for x in tokens.shingle_sets(texts, 5)]
    monkeypatch.setattr(tokens.slices, "__defaults__", (50,))
    assert [x.tobytes() for x in tokens.shingle_sets(texts, 5)] == whole


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(3)
    for j, n in ((0.9, 400), (0.75, 1000), (0.5, 300), (0.0, 500)):
        shared = int(round(2 * n * j / (1 + j)))
        est = []
        for _ in range(30):
            both, a, b = (rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (shared, n - shared, n - shared))
            x, y = near.registers(np.concatenate([both, a])), near.registers(np.concatenate([both, b]))
            assert np.array_equal(near.registers(np.concatenate([both, a, b])), np.maximum(x, y))
            est.append(near.likeliest(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(np.mean(est) - j) < 0.03, (j, np.mean(est))


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus(160) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "just three words"), (2004, "JUST three\nwords")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS component_id", "2 AS n", "3 AS id")
    out = near.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows) and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    out = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in near.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 1, True), (1, 1, True), (-1, None, True), (3, 1, False), (4, 4, True)], key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_stage_keeps_columns_of_clashing_names(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, 5, "a"), (2, text, 6, "b"), (1, "x y", 7, "c"), (None, text, 8, "d"), (None, text, 8, "d"), (4, None, 9, "e"), (5, "", 0, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept long, id string").withColumn("_row", F.lit(1))
    got = near.stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.where("doc_id IS NULL OR doc_id <> 2").collect()))
    assert near.stage(spark, docs.limit(0), "").count() == 0
