"""Longest-match folding with a small dictionary, of documents and queries."""

import pytest

from wayfold.functions import folding
from wayfold.operators import lexical

DIRECT = [("漢", "汉"), ("語", "语"), ("開", "开"), ("發", "发"), ("髮", "发"), ("頭髮", "头发"), ("乾坤", "乾坤"), ("乾", "干"), ("乾", "x"), ("資", "资"), ("訊", "讯"), ("軟", "软"), ("體", "体"), ("件", "件")]
REGIONAL = [("資訊", "信息"), ("軟體", "軟件")]


def test_the_longest_phrase_wins_and_of_equal_ones_the_first():
    p = folding.Phrases([("ab", "1"), ("abc", "2"), ("a", "3"), ("ab", "4"), ("", "5"), ("z", "")])
    assert p.convert("abcabaxbz") == "213xbz"
    f = folding.Folder(DIRECT, REGIONAL)
    assert f.variants("乾坤 乾 頭髮 plain") == ["乾坤 干 头发 plain"] and f.variants("資訊軟體") == ["资讯软体", "信息软件"] and f.variants("ascii") == ["ascii"]


def test_tables_in_both_directions(spark):
    rows = [("direct", i, k, v, False) for i, (k, v) in enumerate(DIRECT)] + [("regional", 50, "信息", "資訊", True)]
    f = folding.Folder.of(spark.createDataFrame(rows, "kind string, ordinal int, key string, value string, reversed boolean"))
    assert f.variants("資訊") == ["资讯", "信息"]
    with pytest.raises(ValueError):
        folding.Folder([(str(i), "x") for i in range(folding.MOST + 1)])


def test_documents_and_queries_meet(spark):
    none = lambda s: spark.createDataFrame([], s)
    f = folding.Folder(DIRECT, REGIONAL)
    urls = spark.createDataFrame([("p", 1, "https://a.org/", "漢語資訊 Page"), ("p", 2, "https://b.org/", "汉语信息"), ("p", 3, "https://c.org/", "開發"), ("p", 4, "https://d.org/", None)], "profile_id string, url_id long, url string, title string")
    docs = lexical.documents(urls, none("profile_id string, url_id long, term string"), none("url string, notes string"), none("url string, tag string"), none("url string, summary string, metadata string"), f).cache()
    title = {r.url_id: r.normalized_title for r in docs.collect()}
    assert title == {1: "汉语资讯 page 汉语信息 page", 2: "汉语信息", 3: "开发", 4: ""}
    grams = lexical.gram_index(docs).cache()
    index = lexical.Index(docs, lexical.index(docs), grams, lexical.gram_counts(grams), *lexical.totals(docs))
    hits = lambda q, fold=f: {r.doc_id for r in lexical.search(index, q, fold).collect()}
    assert hits("漢語") == hits("汉语") == {"p:1", "p:2"} and hits("資訊") == {"p:1", "p:2"} and hits("信息") == {"p:1", "p:2"} and hits("開發 OR 资讯") == {"p:1", "p:3"}
    assert hits("漢語", None) == set()
