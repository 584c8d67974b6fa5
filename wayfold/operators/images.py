"""Preview images of pages: stored once by content, refreshed, and evicted by age of use until they fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def upsert(images: DataFrame, batch: DataFrame) -> DataFrame:
    """page_url, blob_hash, bytes, fetched_ms, shown_ms: the last fetch of a page counts; when it was shown is the last time of all."""
    both = images.unionByName(batch).groupBy("page_url").agg(F.max_by(F.struct("blob_hash", "bytes", "fetched_ms"), F.struct("fetched_ms", "blob_hash")).alias("n"), F.max("shown_ms").alias("shown_ms"))
    return both.select("page_url", "n.*", "shown_ms")


def stats(images: DataFrame) -> DataFrame:
    """One row: pages, blobs and bytes, of which copies count once."""
    blobs = images.groupBy("blob_hash").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    return blobs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.count("blob_hash").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def coverage(pages: DataFrame, images: DataFrame) -> DataFrame:
    """One row: distinct https pages, and those that have an image."""
    wanted = pages.where(F.startswith("url", F.lit("https://"))).select(F.col("url").alias("page_url")).distinct()
    have = images.where("blob_hash IS NOT NULL").select("page_url").distinct().withColumn("has", F.lit(1))
    return wanted.join(have, "page_url", "left").agg(F.count("*").alias("pages"), F.coalesce(F.sum("has"), F.lit(0)).alias("covered"))


def due(pages: DataFrame, images: DataFrame, now_ms: int, days: int, limit: int) -> DataFrame:
    """https pages to fetch, the last seen first: without an image yet, or with one that is older than so many days."""
    fresh = images.where(F.col("fetched_ms") > now_ms - days * DAY_MS).select(F.col("page_url").alias("url")).distinct()
    seen = pages.where(F.startswith("url", F.lit("https://"))).groupBy("url").agg(F.max("last_ms").alias("last_ms"))
    return seen.join(fresh, "url", "left_anti").orderBy(F.desc("last_ms"), "url").limit(limit)


def evict(images: DataFrame, most_bytes: int) -> DataFrame:
    """Pages whose images go so that the rest takes at most so many bytes: those shown longest ago first (then by page).

    A copy frees nothing until the last page that shows it goes. What each day's pages free is summed
    first; only within a day are pages put in order, so no task sorts all of them.
    """
    order = ["shown_ms", "page_url"]
    last = F.row_number().over(Window.partitionBy("blob_hash").orderBy(F.desc("shown_ms"), F.desc("page_url"))) == 1
    rows = images.withColumn("frees", F.when(last, F.col("bytes")).otherwise(0)).withColumn("day", F.floor(F.col("shown_ms") / DAY_MS))
    days = rows.groupBy("day").agg(F.sum("frees").alias("freed"))
    before = F.coalesce(F.sum("freed").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    excess = F.sum("freed").over(Window.partitionBy()) - most_bytes  # one row a day
    plan = days.select("day", before.alias("before"), excess.alias("excess"))
    inside = Window.partitionBy("day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("before") + F.coalesce(F.sum("frees").over(inside), F.lit(0))
    return rows.join(plan, "day").withColumn("freed", freed).where("freed < excess").select("page_url", "blob_hash", "frees")
