"""The window index and its segments against scans of the documents and full rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import lexical, segments

WORDS = ["topic", "guide", "aaaa", "aaaaaa", "wasm", "Reader", "数据库", "数据", "straße", "x1", "compare", "pathkeep"]


def url_rows(spark, ids, seed):
    r = random.Random(seed)
    rows = [("p", i, f"https://{r.choice(WORDS)}.org/{r.choice(WORDS)}/{i}", " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5))) or None) for i in ids]
    return spark.createDataFrame(rows, "profile_id string, url_id long, url string, title string")


def documents(spark, urls, notes=()):
    none = lambda s: spark.createDataFrame([], s)
    return lexical.documents(urls, none("profile_id string, url_id long, term string"), spark.createDataFrame(list(notes), "url string, notes string"), none("url string, tag string"), none("url string, summary string, metadata string"))


def index_of(docs):
    docs = docs.cache()
    grams = lexical.gram_index(docs).cache()
    return lexical.Index(docs, lexical.index(docs), grams, lexical.gram_counts(grams), *lexical.totals(docs))


def ids(spark, numbers):
    return spark.createDataFrame([(f"p:{i}",) for i in numbers], "doc_id string")


@pytest.mark.parametrize("text", ["aaa", "aaaa", "topicguide", "数据库", "wasmreader", "missingtext", "org"])
def test_occurrences_equal_a_scan(spark, text):
    index = index_of(documents(spark, url_rows(spark, range(80), 1)))
    got = {r.doc_id: (r["size"], r.f) for r in lexical.occurrences(index, text).collect()}
    scan = {r.doc_id: (max(len(r.compact) - 2, 0), r.compact.count(text)) for r in index.docs.collect()}
    assert got == {k: v for k, v in scan.items() if v[1]}


def test_search_reads_no_documents(spark, tmp_path):
    segments.create(documents(spark, url_rows(spark, range(40), 2)), str(tmp_path))
    index = segments.read(spark, str(tmp_path))
    found = lexical.scored(index, lexical.analyze("topic guide OR wasm"))
    assert found.count() > 0 and found.inputFiles() and not [f for f in found.inputFiles() if "/documents/" in f]


def same(a, b):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a.docs.select(*b.docs.columns)) == rows(b.docs)
    assert rows(a.postings.select(*b.postings.columns)) == rows(b.postings)
    assert rows(a.grams.select(*b.grams.columns)) == rows(b.grams)
    assert (a.n, a.size, a.windows) == (b.n, b.size, b.windows)
    for text in ("topic guide OR 数据库", "compering"):
        assert rows(lexical.search(a, text)) == rows(lexical.search(b, text))


def test_segments_equal_a_rebuild(spark, tmp_path):
    folder = str(tmp_path)
    first, late, edited = url_rows(spark, range(50), 3), url_rows(spark, range(50, 70), 4), url_rows(spark, range(40, 55), 5)
    segments.create(documents(spark, first), folder)
    segments.refresh(folder, ids(spark, range(50, 70)), documents(spark, late))
    segments.refresh(folder, ids(spark, range(40, 55)), documents(spark, edited))
    segments.refresh(folder, ids(spark, [0, 1, 45, 69, 999]), documents(spark, first.where("url_id = 1")))  # three go, one is as before, one never was
    end = first.where("url_id BETWEEN 1 AND 39").unionByName(late.where("url_id BETWEEN 55 AND 68")).unionByName(edited.where("url_id <> 45"))
    want = index_of(documents(spark, end))
    same(segments.read(spark, folder), want)
    segments.merge(spark, folder)
    same(segments.read(spark, folder), want)
    note = [(end.where("url_id = 7").first().url, "Only here: zebra")]
    segments.refresh(folder, ids(spark, [7]), documents(spark, end.where("url_id = 7"), note))
    assert [r.doc_id for r in lexical.search(segments.read(spark, folder), "zebra").collect()] == ["p:7"]


def test_folders_of_touched_documents_are_read_alone(spark, tmp_path):
    segments.create(documents(spark, url_rows(spark, range(60), 6)), str(tmp_path))
    docs = segments.read(spark, str(tmp_path)).docs
    files = [r[0] for r in docs.where(F.col("bucket").isin([3])).select(F.input_file_name()).distinct().collect()]
    assert files and all("bucket=3/" in f for f in files) and docs.where("bucket = 3 AND bucket <> pmod(xxhash64(doc_id), 16)").count() == 0


def test_a_stream_of_changes_makes_segments_and_merges_them(spark, tmp_path):
    now = url_rows(spark, range(30), 7).cache()
    folder, source = f"{tmp_path}/index", f"{tmp_path}/changes"
    segments.create(documents(spark, now.where("url_id < 20")), folder)
    for k in range(5):
        now.where(f"url_id % 5 = {k}").select("profile_id", "url_id").coalesce(1).write.mode("append").parquet(source)
    build = lambda keys: documents(spark, now.join(keys, ["profile_id", "url_id"]))
    sink = segments.sink(folder, build, most=2)
    stream = spark.readStream.schema("profile_id string, url_id long").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    known = segments._manifest(spark, folder)
    assert known[0].base and known[0].generation > 1
    same(segments.read(spark, folder), index_of(documents(spark, now)))
    sink(now.limit(0), known[-1].batch)  # tried again after it was finished: nothing happens
    assert segments._manifest(spark, folder) == known


def test_empty_collections(spark, tmp_path):
    segments.create(documents(spark, url_rows(spark, range(3), 8).limit(0)), str(tmp_path))
    index = segments.read(spark, str(tmp_path))
    assert (index.n, index.size, index.windows) == (0, 0, 0) and lexical.search(index, "topic guide").count() == 0
    segments.refresh(str(tmp_path), ids(spark, [1]), documents(spark, url_rows(spark, [1], 9)))
    assert segments.read(spark, str(tmp_path)).n == 1
    with pytest.raises(ValueError):
        segments.read(spark, str(tmp_path / "nothing"))


def test_fuzzy_scores_every_document(spark):
    """A near word counts however many documents share more windows with the target; targets that may share none are looked for everywhere."""
    rows = [("p", i, f"https://xxx.org/{i}", "com omp mpe per eri rin ing") for i in range(230)] + [("p", 1000, "https://yyy.org/", "comparing"), ("p", 1001, "https://yyy.org/2", "badge")]
    index = index_of(documents(spark, spark.createDataFrame(rows, "profile_id string, url_id long, url string, title string")))
    got = {r.doc_id: r.score for r in lexical.search(index, "compering").collect()}
    assert got == {"p:1000": round(1 / 9, 9)}
    assert {r.doc_id for r in lexical.search(index, "bodge").collect()} == {"p:1001"}


def test_hybrid_lists_are_reckoned_once(spark):
    from pyspark.sql import functions as F

    from wayfold.operators import hybrid

    seen = spark.sparkContext.accumulator(0)

    def nearness(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    hits = spark.range(20).select(F.col("id").cast("string").alias("page"), F.col("id").cast("double").alias("nearness")).mapInArrow(nearness, "page string, nearness double")
    visits = spark.range(20).select(F.col("id").cast("string").alias("page"), F.col("id").alias("doc_id"), F.col("id").alias("ms"), F.col("id").alias("visit_id"))
    lexical_ = hybrid.lexical_list(visits, visits.where("doc_id < 3"), 5)
    fused = hybrid.fuse(lexical_, hybrid.semantic_list(hits, visits, 5), spark.createDataFrame([("19",)], "page string"))
    rows = hybrid.page_of(fused, 10).collect()
    assert rows[0].page == "19" and len(rows) == 8 and seen.value == 20
