"""Ingest: upserts, deduplication on two keys, watermarks, reverts, integrity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of observed interactions, and the keys of engagement evidence that fill them; fixed values.
ENGAGEMENT = {
    "foreground_duration_ms": ("engagement.total_foreground_duration_ms", "engagement.total_view_time_ms", "engagement.visit_duration_ms"),
    "scrolling_time_ms": ("engagement.scrolling_time_ms",),
    "scrolling_distance": ("engagement.scrolling_distance", "engagement.scrolling_distance_px"),
    "key_presses": ("engagement.key_presses",),
    "typing_time_ms": ("engagement.typing_time_ms",),
    "load_successful": ("engagement.load_successful",),
}
CONTEXT_KEYS = {"load_successful": "context.load_successful", "page_end_reason": "context.page_end_reason"}
SIGNALS = (*ENGAGEMENT, "page_end_reason")


def fingerprint(kind: Column, url: Column, time: Column, title: Column, transition: Column, app: Column) -> Column:
    parts = F.named_struct(*[x for n, c in (("sourceKind", kind), ("url", url), ("visitTime", time), ("title", title), ("transition", transition), ("appId", app)) for x in (F.lit(n), c)])
    return F.sha2(F.to_json(parts), 256)


def upsert_urls(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Columns url, title, last_ms, visit_count, typed_count by key: the strictly newer row's url and
    title win, an equal time keeps the existing or first row, counts are the greatest. A null time never wins over another."""
    both = existing.withColumn("arrival", F.lit(-1).cast("long")).unionByName(batch)
    # a row without a time is older than any other
    newest = F.min(F.struct((-F.coalesce("last_ms", F.lit(-(1 << 62)))).alias("o"), "arrival", "url", "title", "last_ms"))
    return both.groupBy(*key).agg(newest.alias("w"), F.max("visit_count").alias("visit_count"), F.max("typed_count").alias("typed_count")).select(*key, "w.url", "w.title", "w.last_ms", "visit_count", "typed_count")


def dedup_visits(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """New rows of the batch: neither their (profile_id, source_id) nor their fingerprint has been seen, in the archive or before in the batch."""
    by_id = ["profile_id", "source_id"]
    fresh = batch.join(existing.select(*by_id), by_id, "left_anti")
    fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*by_id).orderBy("arrival"))).where("_r = 1").drop("_r")
    by_print = ["profile_id", "fingerprint"]
    fresh = fresh.join(existing.where("fingerprint <> ''").select(*by_print), by_print, "left_anti")
    once = F.row_number().over(Window.partitionBy(*by_print).orderBy("arrival"))
    return fresh.withColumn("_r", F.when(F.col("fingerprint") != "", once).otherwise(1)).where("_r = 1").drop("_r")


def watermarks(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """Per profile the greatest visit id and time ever seen."""
    cols = ["profile_id", "visit_id", "ms"]
    return previous.select(*cols).unionByName(batch.select(*cols)).groupBy("profile_id").agg(F.max("visit_id").alias("visit_id"), F.max("ms").alias("ms"))


def visible(visits: DataFrame, reverted: DataFrame) -> DataFrame:
    """Visits whose import batch isn't reverted. reverted: batch_id."""
    return visits.join(reverted.select("batch_id").distinct(), "batch_id", "left_anti")


def broken_chain(manifests: DataFrame) -> DataFrame:
    """Manifests whose parent hash isn't the hash of the one before in their chain."""
    w = Window.partitionBy("profile_id").orderBy("seq")
    return manifests.withColumn("expected", F.lag("hash").over(w)).where(~F.col("parent").eqNullSafe(F.col("expected")))


def observed_interactions(engagement: DataFrame, context: DataFrame) -> DataFrame:
    """One row a visit (profile_id, source_id) that has a signal, signals as columns: of engagement, else of context.

    engagement: profile_id, source_id, metric_key, value_int, value_real, arrival. A number counts as it is, else the
    real one rounded; of several keys of a signal, the one that arrived last. context: profile_id, source_id, context_key,
    value_json, arrival. Whether the page loaded comes from context only where engagement doesn't say; why it ended always does.
    """
    by, last = ["profile_id", "source_id"], lambda value, cond: F.max_by(value, F.when(cond, F.struct("arrival", "key")))
    number = F.coalesce("value_int", F.round("value_real").cast("long"))
    rows = engagement.withColumn("key", F.col("metric_key"))
    wide = rows.groupBy(*by).agg(*[last(F.col("value_int") if name == "load_successful" else number, F.col("key").isin(*keys)).alias(name) for name, keys in ENGAGEMENT.items()])
    wide = wide.withColumn("load_successful", F.col("load_successful") != 0)
    said = context.withColumn("key", F.col("context_key")).groupBy(*by).agg(*[last(F.col("value_json"), F.col("key") == k).alias(f"_{name}") for name, k in CONTEXT_KEYS.items()])
    loaded = F.when(F.col("_load_successful").isin("true", "false"), F.col("_load_successful") == "true")
    reason = F.when(F.col("_page_end_reason").rlike('^".*"$'), F.from_json(F.concat(F.lit('{"v":'), F.col("_page_end_reason"), F.lit("}")), "v string")["v"])
    both = wide.join(said, by, "full").withColumn("load_successful", F.coalesce("load_successful", loaded)).withColumn("page_end_reason", reason)
    return both.where(F.coalesce(*[F.col(c).cast("string") for c in SIGNALS]).isNotNull()).select(*by, *SIGNALS)


def merge_takeout_urls(records: DataFrame) -> DataFrame:
    """records: url, title, ms, ordinal. Visits of each url and its newest title that isn't null; ties take the later record."""
    title = F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("ms", "ordinal")))
    return records.groupBy("url").agg(F.count("*").alias("visit_count"), title.alias("title"), F.max("ms").alias("last_ms"))


def totals(profiles: DataFrame, urls: DataFrame, visits: DataFrame) -> DataFrame:
    """One row: profiles, urls, visible visits, and when the first and last of them were."""
    one = lambda df, n: df.agg(F.count("*").alias(n))  # noqa: E731  one line each
    seen = visits.agg(F.count("*").alias("visits"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    return one(profiles, "profiles").join(one(urls, "urls")).join(seen)


def upsert_profiles(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Profiles by profile_key: the last row of the batch replaces all but the id and discovered_at, and enables the profile again. batch: and seq."""
    names = [c for c in existing.columns if c not in ("profile_key", "id", "discovered_at", "enabled")]
    last = batch.groupBy("profile_key").agg(F.max_by(F.struct("discovered_at", *names), "seq").alias("n"), F.min_by("discovered_at", "seq").alias("first"))
    both = existing.join(last, "profile_key", "full")
    fresh = F.col("n").isNotNull()
    return both.select("profile_key", "id", F.coalesce("discovered_at", "first").alias("discovered_at"), *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in names], (fresh | F.coalesce("enabled", F.lit(False))).alias("enabled"))


def insert_new(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key is neither in the table nor before in the batch (by arrival): downloads by (profile_id, source_id), search terms by
    (profile_id, url_id, normalized_term), favicons by (profile_id, page_url, icon_url, width, height, last_updated_ms). Nulls are values."""
    names = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*names), "arrival").alias("r")).select(*key, "r.*")
    old = existing.select(*[F.col(k).alias(f"old_{k}") for k in key]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in key]
    return first.join(old, on, "left_anti")


def favicon_blobs(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Images by content: blob_hash, image of what isn't stored yet. batch: image."""
    rows = batch.where("image IS NOT NULL").select(F.sha2("image", 256).alias("blob_hash"), "image").groupBy("blob_hash").agg(F.first("image").alias("image"))
    return rows.join(existing.select("blob_hash"), "blob_hash", "left_anti")


CURSORS = ("visit_id", "url_ms", "download_id", "favicon_ms")


def save_watermarks(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """Per profile the greatest of each of the CURSORS, ever; a batch that lacks one leaves it as it was."""
    cols = ["profile_id", *CURSORS]
    return previous.select(*cols).unionByName(batch.select(*cols)).groupBy("profile_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in CURSORS])


def checkpoint_due(state: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Per profile, whether a snapshot is due and why: the schema changed, or the last one is ``days`` old (0: never by age). state: schema_hash, last_schema_hash, last_checkpoint_ms."""
    changed = ~F.col("schema_hash").eqNullSafe(F.col("last_schema_hash"))
    old = F.lit(days > 0) & (F.col("last_checkpoint_ms").isNull() | (F.lit(now_ms) - F.col("last_checkpoint_ms") >= days * 86_400_000))
    reason = F.when(changed, "source-schema-changed").when(old, "periodic-checkpoint")
    return state.select("profile_id", reason.isNotNull().alias("due"), reason.alias("reason"))


def restore(reverted: DataFrame, batches: DataFrame) -> DataFrame:
    """Reverted batches without those that are restored."""
    return reverted.join(batches.select("batch_id").distinct(), "batch_id", "left_anti")


def batch_review(visits: DataFrame, reverted: DataFrame) -> DataFrame:
    """One row an import batch: visits, URLs, first and last time, and whether it is reverted."""
    gone = reverted.select("batch_id").distinct().withColumn("is_reverted", F.lit(True))
    g = visits.groupBy("batch_id").agg(F.count("*").alias("visits"), F.count_distinct("profile_id", "url_id").alias("urls"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    return g.join(gone, "batch_id", "left").withColumn("is_reverted", F.coalesce("is_reverted", F.lit(False)))


def batch_preview(visits: DataFrame, batch_id: int, limit: int = 50) -> DataFrame:
    return visits.where(F.col("batch_id") == batch_id).orderBy(F.desc("ms"), F.desc("visit_id")).limit(limit)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_ms"), F.desc("run_id")).limit(limit)


def dashboard(totals_row: DataFrame, runs: DataFrame) -> DataFrame:
    """The totals with the last run that ended well and the number of runs that failed since."""
    ok = runs.agg(F.max(F.when(F.col("status") == "ok", F.col("started_ms"))).alias("last_ok_ms"))
    failed = runs.join(ok).agg(F.max("last_ok_ms").alias("last_ok_ms"), F.sum(((F.col("status") != "ok") & (F.col("started_ms") > F.coalesce("last_ok_ms", F.lit(0)))).cast("long")).alias("failed_since"))
    return totals_row.join(failed)


def integrity(visits: DataFrame, urls: DataFrame, derived: DataFrame) -> DataFrame:
    """check, n: visits without a URL, URLs without a visit, and derived rows without a visit."""
    key = ["profile_id", "url_id"]
    parts = {
        "visit-without-url": visits.join(urls.select(*key).distinct(), key, "left_anti"), "url-without-visit": urls.join(visits.select(*key).distinct(), key, "left_anti"),
        "stale-derived-row": derived.join(visits.select("visit_id").distinct(), "visit_id", "left_anti"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
