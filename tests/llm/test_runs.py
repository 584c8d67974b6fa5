import hashlib
import random
import re
import zlib

import numpy as np

from wayfold.llm import runs


def brute(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def some_words(r):
    w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 60))]
    if r.random() < 0.5 and len(w) > 4:
        a, p = r.randrange(len(w)), r.randint(1, 9)
        w = [w[i if i < a else min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
    return w


def test_runs_equal_all_periods_tried():
    r = random.Random(1)
    for _ in range(1500):
        w = some_words(r)
        for least in (2, 5, 12):
            want = brute(w, least)
            assert runs.runs(w, least) == want
            parts = [(a + s, a + e, p) for a, z in runs.stretches(np.array(w, np.int64), least) for s, e, p in runs.runs(w[a:z], least)]
            assert parts == want


def test_factors_are_longest_earlier_stretches():
    r = random.Random(2)
    for _ in range(300):
        w, at = some_words(r), 0
        for start, size, source in runs.factors(w):
            assert start == at
            earlier = lambda n, start=start: any(w[j : j + n] == w[start : start + n] for j in range(start))
            if source >= 0:
                assert w[source : source + size] == w[start : start + size] and source < start and (start + size == len(w) or not earlier(size + 1))
            else:
                assert size == 1 and not earlier(1)
            at += size
        assert at == len(w)


def test_long_words_of_few_kinds_stay_linear():
    a, b = [0], [0, 1]
    while len(b) < 20000:
        a, b = b, b + a
    assert len(runs.runs(b, 2)) < len(b)


def whole_query(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(found), *top, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", "  \n ", "a " * 11, "a " * 12, "a b " * 30, "x y z " * 4 + "x", ("ab " * 7 + "cd ") * 9, "ü\x0bü\x0cü " * 10, "one two\tthree\n" * 5]
    texts += [" ".join(str(x) for x in some_words(r)) for _ in range(120)]
    texts.append(" ".join(str(r.randrange(50)) for _ in range(400)) * 3)
    rows = [(i, t, "en", 7) for i, t in enumerate(texts)] + [(None, "b " * 30, None, 1), (3, texts[3], "en", 7), (3, texts[3], "en", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((whole_query(i, t) for i, t, *_ in rows), key=repr)


def test_whole_table_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, runs.op13_runs(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(whole_query(r.doc_id, r.text) for r in docs.collect())
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op13_runs(spark, str(tmp_path)).count() == 0


def test_operator_returns_texts_without_repeats(spark):
    (row,) = runs.word_runs(spark.createDataFrame([("d", "go " + "a b c " * 5 + "end", 1)], "doc_id string, text string, id int"), least=6).collect()
    assert row.collapsed == "go a b c end" and [(x.start, x.length, x.period) for x in row.runs] == [(1, 15, 3)]
