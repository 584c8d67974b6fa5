"""The icon of a page as of a time: lookups and icons in one sorted stream, with what was newest carried along.

Each lookup asks four series: icons of its page in its profile, of its page in others, of its host in its
profile and of its host in others (the last two without its page). All are swept at once, cut into ranges of (series,
time) of even size; where a range begins inside a series, it starts with what the ranges before carry to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import urls
from wayfold.store import table

#: By tier: whether an icon of the lookup's profile, and one of its page, is passed over.
PASSED = ((False, False), (True, False), (False, True), (True, True))
_ROW = ["series", "at", "kind", "width", "height", "id", "profile_id", "page"]
Icon = tuple[str, str, str]  # id, profile, page
ANY_TIME = (1 << 63) - 1


def blocked(icon: Icon, tier: int, profile: str | None, page: str | None) -> bool:
    by_profile, by_page = PASSED[tier]
    return (by_profile and icon[1] == profile) or (by_page and icon[2] == page)


def needed(icons: list[Icon], tier: int) -> list[Icon]:
    """Of icons, newest first, those that some lookup may still get: one that passes over all that are newer.

    A lookup passes over one profile and one page, so six icons at most remain, however many there were.
    """
    kept: list[Icon] = []
    by_profile, by_page = PASSED[tier]
    for icon in icons:
        profiles = {None, *(k[1] for k in kept)} - {icon[1]} if by_profile else {None}
        pages = {None, *(k[2] for k in kept)} - {icon[2]} if by_page else {None}
        if not kept or any(all(blocked(k, tier, p, u) for k in kept) for p in profiles for u in pages):
            kept.append(icon)
    return kept


def _added(icon: Icon, icons: list[Icon], tier: int) -> list[Icon]:
    return [icon, *icons[1:]] if icons and icons[0][1:] == icon[1:] else needed([icon, *icons], tier)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range carries out of its last series: one row a range, and whether that series is all of it."""
    part, series, icons, whole, out = None, None, [], True, []
    for p, key, _, kind, _, _, row_id, profile, page in _streams(batches):
        if p != part:
            if part is not None:
                out.append((part, series, whole, icons))
            part, series, icons, whole = p, key, [], True
        if key != series:
            series, icons, whole = key, [], False
        if kind == 0:
            icons = _added((row_id, profile, page), icons, int(key[0]))
    if part is not None:
        out.append((part, series, whole, icons))
    kind = pa.list_(pa.struct([("id", pa.string()), ("profile_id", pa.string()), ("page", pa.string())]))
    cols = [[x[0] for x in out], [x[1] for x in out], [x[2] for x in out], [[dict(zip(("id", "profile_id", "page"), i, strict=True)) for i in x[3]] for x in out]]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.bool_(), kind), strict=True)], ["part", "series", "whole", "icons"])


def carried(ends: list[tuple[int, str, bool, list[Icon]]]) -> dict[int, tuple[str, list[Icon]]]:
    """By range, the series that goes on into it and its icons, from what every range carries out."""
    out, series, icons = {}, None, []
    for part, key, whole, own in sorted(ends, key=lambda e: e[0]):
        out[part] = series, icons
        icons = needed([*own, *icons], int(key[0])) if whole and key == series else own
        series = key
    return out


def _sweep(batches: Iterator[pa.RecordBatch], start: dict[int, tuple[str, list[Icon]]]) -> Iterator[pa.RecordBatch]:
    part, series, icons = None, None, []
    for batch in batches:
        found = []
        for p, key, _, kind, _, _, row_id, profile, page in _streams([batch]):
            if p != part:
                part = p
                series, icons = start[p]
            if key != series:
                series, icons = key, []
            tier = int(key[0])
            if kind == 0:
                icons = _added((row_id, profile, page), icons, tier)
            else:
                hit = next((i for i in icons if not blocked(i, tier, profile, page)), None)
                if hit:
                    found.append((row_id, tier, hit[0]))
        cols = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["lookup", "tier", "icon"])


def favicons_of(lookups: DataFrame, favicons: DataFrame) -> DataFrame:
    """lookups: id, profile_id, url, ms, the rows that a page shows. favicons: id, profile_id, page_url, page_host, last_updated_ms, width, height, blob.

    The icon of each as of its time (any time, if that is 0 or less): of the page in the profile, of
    the page in another one, of the host in the profile, of the host in another one; within a tier
    the newest, then the greatest, then the last id as text. Icons without an image don't count. Null if there is none.
    """
    spark = lookups.sparkSession
    icons = favicons.where("blob IS NOT NULL").withColumns({"id": F.col("id").cast("string"), "profile_id": F.col("profile_id").cast("string")})
    asked = lookups.withColumn("host", urls.host(F.col("url"))).where("host <> ''")

    def series(profile: str, page: str, host: str):
        mark = lambda c: F.coalesce(F.col(c), F.lit(""))
        keys = [F.concat(F.lit("0"), mark(profile), F.lit("\n"), mark(page)), F.concat(F.lit("1"), mark(page)), F.concat(F.lit("2"), mark(profile), F.lit("\n"), mark(host)), F.concat(F.lit("3"), mark(host))]
        return F.explode(F.array(*keys)).alias("series")

    size = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("width", "height")]
    had = icons.select(series("profile_id", "page_url", "page_host"), F.col("last_updated_ms").cast("long").alias("at"), F.lit(0).alias("kind"), *size, "id", "profile_id", F.col("page_url").alias("page")).where("at IS NOT NULL")
    time = F.when(F.col("ms") <= 0, ANY_TIME).otherwise(F.col("ms"))
    want = asked.select(series("profile_id", "url", "host"), time.alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("width"), F.lit(0).cast("long").alias("height"), F.col("id").cast("string").alias("id"), F.col("profile_id").cast("string"), F.col("url").alias("page"))
    order = ["series", "at", "kind", "width", "height", "id"]
    ranged = table(had.unionByName(want).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "icon-ranges")
    dealt = ranged.repartitionByRange("part").sortWithinPartitions("part", *order).select("part", *_ROW)
    ends = dealt.mapInArrow(_ends, "part int, series string, whole boolean, icons array<struct<id:string,profile_id:string,page:string>>").collect()  # a line a range, six icons at most
    start = carried([(r.part, r.series, r.whole, [tuple(i) for i in r.icons]) for r in ends])
    found = dealt.mapInArrow(lambda b: _sweep(b, start), "lookup string, tier int, icon string")
    best = found.groupBy("lookup").agg(F.min(F.struct("tier", "icon")).alias("b")).select("lookup", "b.*")
    seen = best.join(icons.select(F.col("id").alias("icon"), "blob"), "icon").select(F.col("lookup").alias("_lookup"), "tier", "blob")
    return lookups.select(F.col("id").alias("lookup")).join(seen, F.col("lookup").cast("string") == F.col("_lookup"), "left").drop("_lookup")
