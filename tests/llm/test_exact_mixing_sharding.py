import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import xxhash

from wayfold.llm import exact, mixing, sharding

ROWS = [
    (1, "Same Text", "a", "en"), (2, "same text", "a", "en"), (3, "SAME TEXT", "b", "de"), (4, "É same", "b", None), (5, "é same", None, "fr"),
    (6, None, None, "fr"), (7, "", "c", "fr"), (8, "word " * 30000, "a", "en"), (9, "x", "a", "en"), (9, "x", "a", "en"), (None, "x", "a", "en"), (None, "only null", "d", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS size", "2 AS target", "'k' AS keep_id", "3 AS shard", "4 AS hash", "5 AS id")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, keep):
    groups = defaultdict(list)
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for d, t, *_ in ROWS:
        groups[norm(t)].append(d)
    want = Counter()
    for d, t, *_ in ROWS:
        ids = [x for x in groups[norm(t)] if x is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want[(d, best, len(groups[norm(t)]), best is None or d == best, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    got = exact.exact_duplicates(frame(spark), keep=keep).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact.exact_duplicates(frame(spark).limit(0)).count() == 0


def test_a_text_that_crosses_partitions_is_one_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'unique ' || id ELSE 'hot text' END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = exact.exact_duplicates(df).where("group_size > 1").selectExpr("count(*) n", "max(group_size) g", "count(DISTINCT keep_id) k", "sum(int(kept)) kept").first()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tuple(got) == (2000, 2000, 1, 1)


def test_mix_equals_sql_and_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 50)), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = {r[0]: r[1:] for r in con.execute(mixing.OP2_SQL).fetchall()}
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in got.itertuples()} == want
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby(got.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 50).all()


def test_mix_of_odd_rows(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(ROWS) and {r["size"] for r in got if r.doc_id in (6, 7)} == {0}
    assert mixing.mix(frame(spark).limit(0)).count() == 0


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i % 700 * 37 % 900), f"s{i % 3}", "en") for i in range(1200)]
    rows += [(5000 + i, "copied many times " * 20, "hot", "de") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = check_shards(rows, got, 8)
    assert max(sizes) <= 1.1 * min(sizes)
    text = {d: t for d, t, *_ in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(i, "hot " * 50, "a", "en") for i in range(500)] + [(1000 + i, f"{i} " * 60, "b", "en") for i in range(500)]
    sizes = check_shards(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect(), 8)
    assert max(sizes) <= 1.25 * min(sizes)


def test_shards_of_odd_rows(spark):
    check_shards(ROWS, sharding.shard(frame(spark)).collect(), 8)
    assert sharding.shard(frame(spark).limit(0)).count() == 0


def plain_tree(rows, shards):
    """Shard of each text by a k-d tree built one node after another, for texts of which none is heavy."""
    signed = lambda s: xxhash.xxh64_intdigest(s.encode(), seed=42) % (1 << 20)
    groups = {}
    for i, text, lang, source in rows:
        t = text or ""
        g = groups.setdefault(t, {"w": 0, "id": [], "len": [], "src": [], "lang": []})
        g["w"] += len(t.encode()) + 1
        for k, v in (("id", i), ("len", len(t.encode()) + 1), ("src", signed(source)), ("lang", signed(lang))):
            g[k].append(v)
    atoms, dims = [], ("id", "len", "src", "lang")
    for t, g in groups.items():
        name = hashlib.md5(t.encode()).hexdigest() + ":0"
        tie = int(hashlib.md5(name.encode()).hexdigest()[:15], 16) >> 36
        atoms.append((t, g["w"], [min(g["id"]), max(g["len"]), min(g["src"]), min(g["lang"])], tie))
    lo, hi = [min(a[2][k] for a in atoms) for k in range(4)], [max(a[2][k] for a in atoms) for k in range(4)]
    unit = [(t, w, [math.floor((float(x[k]) - float(lo[k])) / max(float(hi[k]) - float(lo[k]), 1.0) * float((1 << 36) - 1)) for k in range(len(dims))], tie) for t, w, x, tie in atoms]
    target, out = sum(a[1] for a in unit) / shards, {}

    def split(first, many, some):
        if many == 1 or not some:
            out.update({a[0]: first for a in some})
            return
        widths = [max(a[2][k] for a in some) - min(a[2][k] for a in some) for k in range(4)]
        k = widths.index(max(widths))
        left = (many + 1) // 2
        need, total, cut = sum(a[1] for a in some) * (left * target) / (many * target), 0, []
        for h in sorted({(a[2][k] << 24) + a[3] for a in some}):
            own = [a for a in some if (a[2][k] << 24) + a[3] == h]
            if total + sum(a[1] for a in own) > need:
                break
            total += sum(a[1] for a in own)
            cut += own
        split(first, left, cut)
        split(first + left, many - left, [a for a in some if a not in cut])

    split(0, shards, unit)
    return out


@pytest.mark.parametrize("shards", [1, 3, 6])
def test_any_number_of_shards_equals_a_plain_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randrange(1, 60) + str(rng.randrange(250)), rng.choice(["en", "de"]), f"s{rng.randrange(6)}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.shard for r in sharding.shard(df, shards).collect()}
    want = plain_tree(rows, shards)
    assert {i: want[t] for i, t, *_ in rows} == got and set(got.values()) == set(range(shards))


def test_sharding_stage_keeps_columns_of_clashing_names(spark):
    df = frame(spark).selectExpr("*", "1 AS _crc", "2 AS _n", "3 AS _id", "4 AS shard")
    out = sharding.stage(spark, df, "")
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"] and out.count() == df.count()
    assert sharding.stage(spark, df.limit(0), "").count() == 0


def test_mixing_keeps_columns_of_clashing_names(spark):
    df = frame(spark).selectExpr("*", "1 AS key", "2 AS _n", "3 AS plan", "4 AS row", "5 AS passes", "6 AS _key")
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns and {(r.key, r["size"], r.passes, r["_key"]) for r in out.collect()} == {(1, 1, 5, 6)}
    assert {r["_key"] for r in mixing.mix(df).collect()} == {6}
    assert mixing.stage(spark, df.limit(0), "").count() == 0


def test_mixing_takes_documents_without_words_twice_at_most(spark):
    rows = [(i, "" if i % 2 else None, "a") for i in range(40)] + [(100 + i, "w " * 10, "a") for i in range(3)] + [(200 + i, "w " * 50, "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r.doc_id for r in mixing.stage(spark, docs, "").collect())
    assert max(times.values()) == 2 and mixing.stage(spark, docs.limit(0), "").count() == 0
