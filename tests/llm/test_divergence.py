import random

import duckdb
import numpy as np
import pyarrow as pa

from wayfold.llm import divergence, tries


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return sorted(con.execute(divergence.OP12_SQL).fetchall())


def query(spark, path):
    df = divergence.op12_divergence(spark, str(path))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_trie_pieces_come_back(spark):
    r = random.Random(1)
    terms = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))).encode() for _ in range(400)})
    lists = []
    for _ in range(3):
        own = r.sample(terms, 250)
        at = np.array([i for i in range(250) for _ in range(r.randint(1, 3))])
        lists.append((pa.array(own, pa.large_binary()), np.array([r.randint(1, 5) for _ in own]), at, np.array([r.randrange(4) for _ in at]), np.array([r.randint(1, 9) for _ in at])))
    trie = tries.merged(lists)
    want = {}
    for own, docs, at, code, n in lists:
        for t, d in zip(own.to_pylist(), docs.tolist(), strict=True):
            want.setdefault(t, [0, {}])[0] += d
        for a, c, k in zip(at.tolist(), code.tolist(), n.tolist(), strict=True):
            x = want[own[a].as_py()][1]
            x[c] = x.get(c, 0) + k

    def leaves(trie, names):
        out = {t: [d, {}] for t, d in zip(trie.terms.to_pylist(), trie.docs.tolist(), strict=True)}
        for a, c, k in zip(trie.at.tolist(), trie.code.tolist(), trie.n.tolist(), strict=True):
            out[trie.terms[a].as_py()][1][names[c]] = k
        return out

    assert trie.terms.to_pylist() == sorted(want) and leaves(trie, range(4)) == want
    names, codes = ["w", "x", "y", "z"], {"z": 0}
    rows = list(trie.pieces("l", names, [t[:2] for t in trie.terms.to_pylist()]))
    assert [row["prefix"] for row in rows] == sorted({t[:2] for t in want})
    back = tries.merged([tries.unpacked(row, codes) for row in rows])
    assert leaves(back, {c: names.index(s) for s, c in codes.items()}) == want


def rows():
    r = random.Random(2)
    words = ["the", "The", "thé", "über", "x" * 400, "日本", "a_b", "it's", "q1w2", "", "Straße", "zz"]
    out = [(i, " ".join(r.choice(words) + r.choice(["", "a", "b"]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "é", None, ""])) for i in range(150)]
    out += [(200, None, "fr", "only"), (201, None, "es", "a"), (202, "...", "es", "b"), (203, "one two", "it", "a"), (204, "rare", "it", "b"), (None, "the " * 50000, "en", "a")]
    return out + out[:20]


def test_query_equals_sql(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "'x' AS item", "2 AS prefix")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, tmp_path)
    assert got == by_sql(tmp_path)
    assert ("es", "a", "pair", "b", 0, 1) in got and not [x for x in got if x[0] == "fr"]


def test_refined_ranges_and_early_flushes_change_nothing(spark, tmp_path, monkeypatch):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name, value in (("TEXT_BYTES", 1), ("NODE", 1), ("LEAST_RANGE", 8), ("RANGES", 1 << 20), ("WALK", 40)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(tries, "DEEPEST", 2)
    assert query(spark, tmp_path) == by_sql(tmp_path)


def test_whole_table_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert query(spark, tmp_path / "a") == by_sql(tmp_path / "a")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert query(spark, tmp_path / "b") == []


def test_shares_are_exact_beyond_64_bits():
    count = np.array([[10**13, 3]])
    assert divergence._share(count, np.array([10**13 + 5, 10**13 + 5])).tolist() == [[1 + 10**9 * (10**13 + 1) // (10**13 + 5), 1 + 10**9 * 4 // (10**13 + 5)]]
