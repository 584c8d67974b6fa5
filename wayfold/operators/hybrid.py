"""Hybrid search: lexical and semantic lists of bounded size fused by rank, starred pages lifted, a page by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import vectors
from wayfold.store import table

LEXICAL, SEMANTIC, BOTH = "Lexical match", "Semantic match", "Lexical + semantic match"
#: Rows of a page at most, and how many times a page a list has under a facet.
MOST, EXPANSION = 1000, 8


def _limit(limit: int) -> int:
    return min(max(limit, 1), MOST)


def lexical_list(visits: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """visits: page, doc_id, ms, visit_id (those that pass the facets). found: doc_id. The newest matching visits and one more, by page: page, rank (from 0), ms, visit_id."""
    newest = visits.join(found.select("doc_id"), "doc_id").orderBy(F.desc("ms"), F.desc("visit_id")).limit(_limit(limit) + 1)
    ranked = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ms"), F.desc("visit_id"))) - 1)  # a bounded list
    first = F.min(F.struct("rank", "ms", "visit_id")).alias("b")
    return ranked.groupBy("page").agg(first).select("page", "b.*")


def semantic_list(hits: DataFrame, visits: DataFrame, limit: int, faceted: bool = False) -> DataFrame:
    """hits: page, nearness, of pages that pass the facets. The nearest pages with their newest visit: page, rank, ms, visit_id."""
    size = _limit(limit) * (EXPANSION if faceted else 1)
    best = table(hits.orderBy(F.desc("nearness"), "page").limit(size), "hybrid-near")  # read twice, reckoned once
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nearness"), "page")) - 1)  # a bounded list
    newest = visits.join(ranked.select("page"), "page", "left_semi").groupBy("page").agg(F.max(F.struct("ms", "visit_id")).alias("v"))
    return ranked.join(newest, "page").select("page", "rank", "v.ms", "v.visit_id")


def fuse(lexical: DataFrame, semantic: DataFrame, starred: DataFrame, k: int = vectors.RRF_K, boost: float = vectors.STAR_BOOST) -> DataFrame:
    """page, visit_id, ms, match, score: reciprocal ranks of both lists added, as a share of the best, and the boost on top for starred pages (page).

    A page in both lists is shown by the visit of the semantic one.
    """
    a = lexical.select("page", F.col("rank").alias("ra"), F.col("ms").alias("ma"), F.col("visit_id").alias("va"))
    b = semantic.select("page", F.col("rank").alias("rb"), F.col("ms").alias("mb"), F.col("visit_id").alias("vb"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    match = F.when(F.col("ra").isNull(), SEMANTIC).when(F.col("rb").isNull(), LEXICAL).otherwise(BOTH)
    both = a.join(b, "page", "full").select("page", F.coalesce("vb", "va").alias("visit_id"), F.coalesce("mb", "ma").alias("ms"), match.alias("match"), F.round(part("ra") + part("rb"), 9).alias("score"))
    return vectors.starred_boost(table(both, "hybrid-fused"), starred, "page", boost)


def page_of(fused: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Rows of a page with total, has_more and next_cursor beside each. The cursor is an offset; of equal scores the older visit is first."""
    size, start = _limit(limit), int(cursor) if cursor and cursor.isdigit() else 0
    counted = fused.withColumn("total", F.count("*").over(Window.partitionBy()))  # two bounded lists
    rows = counted.orderBy(F.desc("score"), "ms", "page").offset(start).limit(size)
    end = F.least(F.lit(start + size), F.col("total"))
    return rows.withColumn("has_more", F.col("total") > size).withColumn("next_cursor", F.when(end < F.col("total"), end.cast("string")))
