"""Small composed outputs: overview sections, highlight cards, a public snapshot, and reports by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections of overviews and how many rows each has, if not ten; fixed values where the reads have a limit.
SECTIONS = {"top_sites": 40, "query_families": 10, "search_concepts": 50, "refind_pages": 5}
#: Sections that show all they have: a row a day or week, an engine, a category, a habit or a browser.
WHOLE = {"discovery_trend_day": 400, "discovery_trend_week": 400, "search_engine_ranking": 100, "search_effectiveness": 100, "activity_mix": 100, "habit_patterns": 100, "interrupted_habits": 100, "multi_browser_diff": 100}
CARDS_MOST, HIGHLIGHTS_MOST, PUBLIC_DOMAINS = 6, 4, 5


def overview(sections: dict[str, DataFrame]) -> DataFrame:
    """section, rank, entity, value: the sections' first rows in one frame. Each section has columns entity and value; ranks follow value, then entity."""
    out = None
    for name, rows in sections.items():
        top = rows.select("entity", F.col("value").cast("double").alias("value")).orderBy(F.desc("value"), "entity").limit((SECTIONS | WHOLE).get(name, 10))
        listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), "entity"))).alias("l")).select(F.posexplode("l").alias("rank", "x"))
        one = listed.select(F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), "x.entity", (-F.col("x.o")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def cards(values: dict[str, DataFrame], most: int = CARDS_MOST) -> DataFrame:
    """card, label, value: one-row frames (label, value) in the order given, at most ``most`` of them; cards without a value are left out."""
    out = None
    for i, (name, row) in enumerate(values.items()):
        one = row.select(F.lit(i).alias("n"), F.lit(name).alias("card"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL").limit(1)
        out = one if out is None else out.unionByName(one)
    return out.orderBy("n").limit(most).drop("n")


def public_snapshot(domains: DataFrame, engines: DataFrame, discovery: DataFrame) -> DataFrame:
    """What may be shown to others: kind, label, value of the first domains, all engines and weekly discovery; no URLs, no visits."""
    top = domains.orderBy(F.desc("visits"), "domain").limit(PUBLIC_DOMAINS)
    parts = [top.select(F.lit("domain").alias("kind"), F.col("domain").alias("label"), F.col("visits").cast("double").alias("value")), engines.select(F.lit("engine").alias("kind"), F.col("engine").alias("label"), F.col("searches").cast("double").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(discovery.select(F.lit("discovery").alias("kind"), F.col("period").alias("label"), F.col("rate").cast("double").alias("value")))


def report(reports: dict[str, Callable[[], DataFrame]], name: str) -> DataFrame:
    """One of the reports by name."""
    if name not in reports:
        raise ValueError(f"unknown report: {name}; there are {', '.join(sorted(reports))}")
    return reports[name]()
