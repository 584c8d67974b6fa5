"""History pages: filters, counts, envelopes and cursors, favicons as of a time, a day's summary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import sites, urls
from wayfold.operators.recall import PAGE_DEFAULT, PAGE_MOST

#: Low byte of a browser's transition, by kind; fixed values.
LINK, TYPED, SEARCHES = 0, 1, (5, 10)
GAP_MS = 30 * 60_000


@dataclass(frozen=True)
class Browse:
    """What a history page asks for; both bounds of time are included. cursor is what the page before gave."""

    profile: str | None = None
    browser: str | None = None
    text: str | None = None
    domain: str | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    regex: str | None = None
    sort: str | None = None
    cursor: str | None = None
    page: int = 1
    limit: int = PAGE_DEFAULT

    def size(self) -> int:
        return min(max(self.limit, 1), PAGE_MOST)


def history(archive: dict[str, DataFrame]) -> DataFrame:
    """Visible visits with their URLs and profiles."""
    seen = archive["visits"].join(archive["reverted"].select("batch_id").distinct(), "batch_id", "left_anti")
    return seen.join(archive["urls"].select("profile_id", "url_id", "url", "title"), ["profile_id", "url_id"]).join(archive["profiles"], "profile_id")


def like(c: Column, part: str) -> Column:
    """SQL's LIKE '%part%' without case; % and _ of the part are wildcards."""
    return F.lower(c).like(f"%{part.lower()}%")


def matching(rows: DataFrame, q: Browse) -> DataFrame:
    """Rows that the filters leave; only those asked for are in the plan, so they reach the scan."""
    parts = [F.col("profile_id") == q.profile] if q.profile is not None else []
    parts += [F.col("browser") == q.browser] if q.browser is not None else []
    parts += [like(F.col("url"), q.text) | like(F.coalesce("title", F.lit("")), q.text)] if q.text else []
    parts += [like(F.col("url"), q.domain)] if q.domain else []
    parts += [F.col("ms") >= q.start_ms] if q.start_ms is not None else []
    parts += [F.col("ms") <= q.end_ms] if q.end_ms is not None else []
    parts += [F.col("url").rlike(f"(?i){q.regex}") | F.coalesce("title", F.lit("")).rlike(f"(?i){q.regex}")] if q.regex else []
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def sort_of(q: Browse, lexical: bool = False) -> str:
    """oldest or newest if asked for; relevance only of a lexical search, where it is the default."""
    if q.sort in ("oldest", "newest"):
        return q.sort
    return "relevance" if lexical and q.sort in (None, "relevance") else "newest"


def cursor_of(text: str | None) -> tuple[float | None, int, int] | None:
    """(score or null, ms, visit_id) of ``ms|id`` or ``r|score|ms|id``; null if it is neither."""
    parts = (text or "").split("|")
    try:
        if parts[0] == "r" and len(parts) == 4:
            return float(parts[1]), int(parts[2]), int(parts[3])
        return (None, int(parts[0]), int(parts[1])) if len(parts) == 2 else None
    except ValueError:
        return None


def ordered(rows: DataFrame, sort: str) -> DataFrame:
    orders = {"oldest": ("ms", "visit_id"), "newest": (F.desc("ms"), F.desc("visit_id")), "relevance": ("score", F.desc("ms"), F.desc("visit_id"))}
    return rows.orderBy(*orders[sort])


def after(rows: DataFrame, sort: str, cursor: str | None) -> DataFrame:
    """Rows that follow a cursor strictly; another kind of cursor than the sort's is ignored."""
    at = cursor_of(cursor)
    if at is None or (sort == "relevance") != (at[0] is not None):
        return rows
    score, t, i = at
    older = (F.col("ms") < t) | ((F.col("ms") == t) & (F.col("visit_id") < i))
    newer = (F.col("ms") > t) | ((F.col("ms") == t) & (F.col("visit_id") > i))
    return rows.where({"newest": older, "oldest": newer}[sort] if sort != "relevance" else (F.col("score") > score) | ((F.col("score") == score) & older))


def page_of(rows: DataFrame, q: Browse, lexical: bool = False) -> DataFrame:
    """One page: by cursor, or by its number. A top of bounded size, whatever is before it."""
    sort = sort_of(q, lexical)
    if cursor_of(q.cursor) is not None:
        return ordered(after(rows, sort, q.cursor), sort).limit(q.size())
    return ordered(rows, sort).offset((max(q.page, 1) - 1) * q.size()).limit(q.size())


def envelope(rows: DataFrame, q: Browse, lexical: bool = False) -> DataFrame:
    """One row about a page: total, page, page_size, page_count (never 0), has_previous, has_next, next_cursor."""
    sort, size = sort_of(q, lexical), q.size()
    by_cursor = cursor_of(q.cursor) is not None
    place = F.concat_ws("|", F.col("ms").cast("string"), F.col("visit_id").cast("string"))
    key = F.concat_ws("|", F.lit("r"), F.col("score").cast("string"), place) if sort == "relevance" else place
    shown = page_of(rows, q, lexical).withColumn("n", F.row_number().over(Window.orderBy(*_order_columns(sort))))  # a page: bounded
    last = shown.agg(F.count("*").alias("shown"), F.max_by(key, "n").alias("last"))
    out = rows.agg(F.count("*").alias("total")).join(last)
    count = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    start = F.lit(0 if by_cursor else (max(q.page, 1) - 1) * size)
    more = start + F.col("shown") < F.col("total")
    return out.select(
        "total", F.least(F.greatest(F.lit(q.page), F.lit(1)), count).cast("long").alias("page"), F.lit(size).alias("page_size"), count.alias("page_count"), (start > 0).alias("has_previous"), more.alias("has_next"), F.when(more, F.col("last")).alias("next_cursor")
    )


def _order_columns(sort: str) -> list:
    return {"oldest": ["ms", "visit_id"], "newest": [F.desc("ms"), F.desc("visit_id")], "relevance": ["score", F.desc("ms"), F.desc("visit_id")]}[sort]


def browse_day(rows: DataFrame, day: str) -> DataFrame:
    """One row about a local day: totals, kinds of visits, sessions, busiest hour, and the tops as arrays of structs."""
    start = F.unix_millis(F.lit(day).cast("timestamp"))
    end = F.unix_millis((F.lit(day).cast("date") + 1).cast("timestamp"))
    today = rows.where((F.col("ms") >= start) & (F.col("ms") < end)).withColumns({"host": urls.host(F.col("url")), "low": F.col("transition").bitwiseAND(255), "asked": sites.day_query(F.col("url")), "hour": F.hour(F.timestamp_millis("ms"))})
    engine = F.regexp_replace("host", r"^www\.", "").isin(*sites.DAY_ENGINES)
    order = Window.orderBy("ms", "visit_id")  # one day of one person
    gaps = today.withColumn("begins", F.coalesce(F.col("ms") - F.lag("ms").over(order) > GAP_MS, F.lit(True)).cast("int")).withColumn("session", F.sum("begins").over(order))
    spans = gaps.groupBy("session").agg((F.max("ms") - F.min("ms")).alias("span")).agg(F.count("*").alias("session_count"), F.max("span").alias("longest_session_ms"))
    totals = today.agg(
        F.count("*").alias("total_pages"), F.coalesce(F.sum((F.col("low") == TYPED).cast("long")), F.lit(0)).alias("typed_count"), F.coalesce(F.sum((F.col("low") == LINK).cast("long")), F.lit(0)).alias("link_count"),
        F.coalesce(F.sum((F.coalesce(F.col("low").isin(*SEARCHES), F.lit(False)) | engine).cast("long")), F.lit(0)).alias("search_count"), F.count_distinct(F.nullif("host", F.lit(""))).alias("distinct_domains"), F.min("ms").alias("first_visit_ms"), F.max("ms").alias("last_visit_ms"),
    )
    hours = today.groupBy("hour").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("hour_buckets"), F.min_by("hour", F.struct(-F.col("n"), "hour")).alias("peak_hour"), F.coalesce(F.max("n"), F.lit(1)).alias("hour_peak"))

    def top(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
        counted = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)
        return counted.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k")))), lambda x: F.struct(x.k.alias("key"), (-x.o).alias("n"))).alias(name))

    parts = [spans, hours, top(today.where("host <> ''"), "host", 4, "top_domains"), top(today, "url", 3, "top_urls"), top(today.where("asked IS NOT NULL").withColumn("asked", F.lower("asked")), "asked", 6, "top_queries")]
    return reduce(lambda a, b: a.join(b), parts, totals).withColumn("date", F.lit(day))
