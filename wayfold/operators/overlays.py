"""Notes, tags and stars that users put over the archive: writes as changes, reads with what the archive knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import urls

LIST_DEFAULT, LIST_MOST = 500, 2000


def set_stars(stars: DataFrame, changes: DataFrame) -> DataFrame:
    """stars: kind, key, starred_at. changes: the same and seq, starred (false takes the star away). Keys are canonical; the last change of one counts, and a star that is set again keeps its time."""
    key = F.when(F.col("kind") == "url", F.coalesce(urls.normalize(F.col("key")), F.col("key"))).otherwise(F.lower("key"))
    last = changes.withColumn("key", key).groupBy("kind", "key").agg(F.max_by("starred", "seq").alias("on"), F.min("starred_at").alias("at"))
    both = stars.join(last, ["kind", "key"], "full").where(F.coalesce("on", F.lit(True)))
    return both.select("kind", "key", F.coalesce("starred_at", "at").alias("starred_at"))


def set_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """notes: url, notes, updated_at. The last change of a URL counts; empty notes are removed."""
    best = notes.unionByName(changes).groupBy("url").agg(F.max_by(F.struct("notes", "updated_at"), "updated_at").alias("n"))
    return best.select("url", "n.*").where(F.trim("notes") != "")


def replace_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """tags: url, tag, created_at. changes: url, tags (array), at. All tags of a changed URL are replaced; spellings that differ in case are one, the first."""
    last = changes.groupBy("url").agg(F.max_by(F.struct("tags", "at"), "at").alias("c"))
    rows = last.select("url", F.posexplode("c.tags").alias("n", "tag"), F.col("c.at").alias("created_at")).withColumn("tag", F.trim("tag")).where("tag <> ''")
    first = F.row_number().over(Window.partitionBy("url", F.lower("tag")).orderBy("n"))
    fresh = rows.withColumn("r", first).where("r = 1").select("url", "tag", "created_at")
    return tags.join(last.select("url"), "url", "left_anti").unionByName(fresh)


def list_stars(stars: DataFrame, url_rows: DataFrame, kind: str | None = None, sort: str = "recent", limit: int = LIST_DEFAULT) -> DataFrame:
    """Stars with domain, title and all visits of the URLs whose canonical form (or domain) is starred: newest first, or most visited."""
    rows, u = urls.with_parts(url_rows, "url")
    known = rows.select(F.coalesce(urls.normalize(u), u.url).alias("canonical"), u.domain.alias("domain"), "title", "visit_count", "last_ms")
    total = lambda key, k: known.groupBy(F.col(key).alias("key")).agg(F.first("domain").alias("domain"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("last_ms"))).alias("title"), F.sum("visit_count").alias("visits")).withColumn("kind", F.lit(k))
    some = stars if kind is None else stars.where(F.col("kind") == kind)
    out = some.join(total("canonical", "url").unionByName(total("domain", "domain")), ["kind", "key"], "left").fillna(0, ["visits"])
    order = [F.desc("visits"), F.desc("starred_at"), "key"] if sort == "revisited" else [F.desc("starred_at"), "key"]
    return out.orderBy(*order).limit(min(max(limit, 1), LIST_MOST))


def starred_visits(facts: DataFrame, stars: DataFrame) -> DataFrame:
    """Visits whose page or domain is starred."""
    pages = stars.where("kind = 'url'").select(F.col("key").alias("url")).distinct().withColumn("p", F.lit(True))
    domains = stars.where("kind = 'domain'").select(F.col("key").alias("domain")).distinct().withColumn("q", F.lit(True))
    return facts.join(pages, "url", "left").join(domains, "domain", "left").where("p OR q").drop("p", "q")


def is_starred(keys: DataFrame, stars: DataFrame, kind: str = "url") -> DataFrame:
    """keys: key, as users give them. Whether the canonical form of each is starred."""
    own = keys.select("key").distinct().withColumn("canonical", F.coalesce(urls.normalize(F.col("key")), F.col("key")) if kind == "url" else F.lower("key"))
    known = stars.where(F.col("kind") == kind).select(F.col("key").alias("canonical")).distinct().withColumn("s", F.lit(True))
    return own.join(known, "canonical", "left").select("key", F.coalesce("s", F.lit(False)).alias("starred"))


def list_annotations(notes: DataFrame, tags: DataFrame, limit: int = LIST_DEFAULT) -> DataFrame:
    """URLs with notes or tags, the last changed first: url, notes, tags (sorted), updated_at."""
    g = tags.groupBy("url").agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.max("created_at").alias("tagged_at"))
    both = notes.join(g, "url", "full").withColumn("updated_at", F.greatest("updated_at", "tagged_at"))
    return both.select("url", "notes", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "updated_at").orderBy(F.desc("updated_at"), "url").limit(min(limit, 5000))


def search_notes(notes: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Notes that hold a text, in any case; all of them for an empty one."""
    found = notes.where(F.contains(F.lower("notes"), F.lit(text.strip().lower()))) if text.strip() else notes
    return found.orderBy(F.desc("updated_at"), "url").limit(min(limit, 5000))
