"""Sessions, search trails and what is built on them: window functions over one profile's visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.sites import site_name
from wayfold.functions.text import query_kind, query_terms
from wayfold.store import table

SESSION_GAP_MS, TRAIL_GAP_MS = 30 * 60_000, 15 * 60_000
#: Least depth, domains, visits and new domains of a deep dive.
DEEP = (4, 5, 8, 1)


DAY_MS = 86_400_000
#: Visits of a session are sorted hour by hour.
SLOT_MS = 3_600_000
_SLOT = ["profile_id", "session_id", "slot_"]


def _inside() -> WindowSpec:
    return Window.partitionBy(*_SLOT).orderBy("ms", "visit_id")


def _along() -> WindowSpec:
    return Window.partitionBy(*_SLOT[:2]).orderBy("slot_")


def _slotted(visits: DataFrame) -> DataFrame:
    """A busy profile never pauses, so one session may hold all its visits: they are sorted within hours, and a row an hour goes along the session."""
    return visits.withColumn("slot_", F.floor(F.col("ms") / SLOT_MS))


def _span(gap_ms: int) -> Column:
    return F.floor(F.col("ms") / max(gap_ms, 1)).alias("span_")


def session_spans(visits: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """profile_id, span_, session_id: the session of each stretch of gap_ms in which a profile has visits.

    Visits of one stretch are never further apart than gap_ms, so only its first one can begin a session, and all of them
    are in the same. Visits are only counted up by hash, never sorted; a row a stretch goes along the profile.
    """
    along = Window.partitionBy("profile_id").orderBy("span_")
    spans = visits.groupBy("profile_id", _span(gap_ms)).agg(F.min("ms").alias("first_"), F.max("ms").alias("last_"))
    begins = F.coalesce(F.col("first_") - F.lag("last_").over(along) > gap_ms, F.lit(True))
    begun = spans.select("profile_id", "span_", F.when(begins, F.col("first_")).alias("ms"))
    ids = visits.join(begun.where("ms IS NOT NULL"), ["profile_id", "ms"]).groupBy("profile_id", "span_").agg(F.min("visit_id").alias("begin_"))
    first = F.last("begin_", ignorenulls=True).over(along)
    return begun.join(ids, ["profile_id", "span_"], "left").select("profile_id", "span_", F.concat_ws(":", F.lit("session"), "profile_id", first.cast("string")).alias("session_id"))


def in_sessions(visits: DataFrame, spans: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Visits with the session_id of their stretch. spans: of session_spans, for the same gap."""
    return visits.select("*", _span(gap_ms)).join(spans, ["profile_id", "span_"]).select(*visits.columns, "session_id")


def sessionize(visits: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """Add session_id: a new one begins where a profile's gap is longer than gap_ms (exactly that long still joins)."""
    return in_sessions(visits, session_spans(visits, gap_ms), gap_ms)


def sessions(visits: DataFrame) -> DataFrame:
    """One row a session, deep dives marked. visits: with session_id and is_new_domain."""
    out = visits.groupBy("profile_id", "session_id").agg(
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
        F.count("*").alias("visits"),
        F.count("search").alias("searches"),
        F.count_distinct("domain").alias("domains"),
        F.sum("is_new_domain").alias("new_domains"),
        F.count("from_visit").alias("depth"),
    )
    d, n, v, w = DEEP
    return out.withColumn("deep_dive", (F.col("depth") >= d) & (F.col("domains") >= n) & (F.col("visits") >= v) & (F.col("new_domains") >= w))


def session_titles(visits: DataFrame) -> DataFrame:
    """profile_id, session_id, title: the name of the domain with most visits (the first by name of several), and the first query."""
    counts = visits.groupBy("profile_id", "session_id", "domain").agg(F.count("*").alias("n"), F.min(F.when(F.col("query").isNotNull(), F.struct("ms", "visit_id", "query"))).alias("q"))
    top = counts.groupBy("profile_id", "session_id").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"), F.min("q").alias("q"))
    name = F.coalesce(site_name(F.col("domain")), F.col("domain"))
    return top.select("profile_id", "session_id", F.concat_ws(" · ", name, "q.query").alias("title"))


def trail_members(visits: DataFrame, gap_ms: int = TRAIL_GAP_MS) -> DataFrame:
    """Members of search trails: trail_id, ordinal and role beside the visit's columns.

    A search opens a trail; a later visit of the session belongs to it while no gap since the
    search is longer than gap_ms. As all visits of an open trail are members, the gap to the last
    member is the gap to the visit before; so a visit is in a trail if the last mark is a search, of the
    marks that searches and other visits after a longer gap make. From hour to hour go the last time, the
    number of visits and the last mark with its place in the session.
    """
    rows = _slotted(visits)
    sums = rows.groupBy(*_SLOT).agg(F.max("ms").alias("last_"), F.count("*").alias("n_"))
    before = sums.select(*_SLOT, F.lag("last_").over(_along()).alias("before_"), F.coalesce(F.sum("n_").over(_along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    since = F.col("ms") - F.coalesce(F.lag("ms").over(_inside()), F.col("before_"))
    placed = rows.join(before, _SLOT).withColumns({"since_": since, "at_": F.col("ahead_") + F.row_number().over(_inside())})
    mark = lambda by: F.struct(by.alias("by"), F.col("at_").alias("at"))
    marked = placed.withColumn("mark_", F.when(F.col("search").isNotNull(), mark(F.col("visit_id"))).when(F.col("since_") > gap_ms, mark(F.lit(None).cast(visits.schema["visit_id"].dataType))))
    ends = marked.groupBy(*_SLOT).agg(F.max_by("mark_", F.when(F.col("mark_").isNotNull(), F.struct("ms", "visit_id"))).alias("end_"))
    open_ = ends.select(*_SLOT, F.last("end_", ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, -1)).alias("open_"))
    own = F.last("mark_", ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0))
    members = marked.withColumn("own_", own).join(open_, _SLOT).withColumn("mark_", F.coalesce("own_", "open_")).where("mark_.by IS NOT NULL")
    n = (F.col("at_") - F.col("mark_.at")).cast("int")
    role = F.when(n == 0, "search_event").when(n == 1, "landing").otherwise("click")
    trail = F.concat_ws(":", F.lit("trail"), "profile_id", F.col("mark_.by").cast("string"))
    return members.select(*visits.columns, trail.alias("trail_id"), n.alias("ordinal"), role.alias("role"))


def trails(members: DataFrame) -> DataFrame:
    return members.groupBy("profile_id", "session_id", "trail_id").agg(
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
        F.count("*").alias("visits"),
        F.max(F.when(F.col("ordinal") == 0, F.col("search"))).alias("query"),
        F.max(F.when(F.col("ordinal") == 0, F.col("engine"))).alias("engine"),
        F.max(F.when(F.col("role") == "landing", F.col("domain"))).alias("landing_domain"),
        F.max(F.when(F.col("role") == "landing", F.col("url"))).alias("landing_url"),
        F.max("ordinal").alias("depth"),
        F.lit(0).cast("long").alias("reformulations"),  # each search opens a trail of its own, so none has a second query
    )


def hub_pages(members: DataFrame, first_ms: int, end_ms: int, limit: int = 10) -> DataFrame:
    """Pages by the number of trails they are in, searches included, of visits from first_ms up to end_ms."""
    pages = members.where((F.col("ms") >= first_ms) & (F.col("ms") < end_ms)).groupBy("url", "domain").agg(F.max("title").alias("title"), F.count_distinct("trail_id").alias("trails"))
    return pages.orderBy(F.desc("trails"), "url", "domain").limit(limit)


def digest(summary: DataFrame, session_rows: DataFrame, refinds: DataFrame, days: tuple[str, str], before: tuple[str, str]) -> DataFrame:
    """kpi, now, before, change, direction: five figures of a range of days beside those of another.

    Visits, searches and new domains are sums of daily summaries (facts.summary_rollup); deep dives count in
    the range in which they begin, pages found again in every range that their visits overlap.
    """
    every = None
    for part, (first, last) in (("now", days), ("before", before)):
        start, end = (F.unix_millis(F.lit(x).cast("timestamp")) for x in (first, last))
        inside = (F.col("first_ms") >= start) & (F.col("first_ms") < end + DAY_MS)
        sums = summary.where(F.col("date_key").between(first, last)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("visits", "total_visits"), ("searches", "total_searches"), ("new_domains", "new_domains"))])
        deep = session_rows.where(F.col("deep_dive") & inside).agg(F.count("*").alias("deep_read_pages"))
        again = refinds.where((F.col("last_ms") >= start) & (F.col("first_ms") < end + DAY_MS)).agg(F.count("*").alias("refind_pages"))
        for one in (sums, deep, again):
            rows = one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))]))).select(F.lit(part).alias("part"), F.col("key").alias("kpi"), "value")
            every = rows if every is None else every.unionByName(rows)
    wide = every.groupBy("kpi").agg(*[F.sum(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in ("now", "before")])
    way = F.when(F.col("now") > F.col("before"), "up").when(F.col("now") < F.col("before"), "down").otherwise("flat")
    return wide.select("kpi", "now", "before", (F.col("now") - F.col("before")).alias("change"), way.alias("direction"))


def friction(trail_rows: DataFrame, limit: int = 10) -> DataFrame:
    """Trails that were asked again and again, or that led nowhere."""
    hard = trail_rows.where("reformulations >= 2 OR (landing_domain IS NULL AND visits >= 3)").orderBy(F.desc("reformulations"), F.desc("visits"), "trail_id").limit(limit)
    kind = F.when(F.col("reformulations") >= 2, "excessive_reformulation").otherwise("bounce_pattern")
    return hard.select("trail_id", "landing_domain", kind.alias("kind"), F.greatest("visits", "reformulations").alias("occurrences"))


#: Weights of days, trails, arrivals and typed visits in a page's refind score.
REFIND = (2.0, 1.5, 1.0, 1.2)


def refind_pages(visits: DataFrame, members: DataFrame, newest: int = 50) -> DataFrame:
    """Pages that were found again: on two days, in two trails, or typed twice, with their newest visits.

    Counts are made once a page and day; the newest visits of a page are the newest of its days'
    newest, so that no task holds all visits of a common page. Members are merged: what Spark reckons of their files
    is a tenth of what sending them to all takes.
    """
    tagged = visits.where("search IS NULL").join(members.select("visit_id", "trail_id").hint("merge"), "visit_id", "left").withColumn("day", F.floor(F.col("ms") / DAY_MS))
    ranked = tagged.withColumn("r", F.row_number().over(Window.partitionBy("profile_id", "url", "day").orderBy(F.desc("ms"), F.desc("visit_id"))))
    best = lambda c: F.slice(F.sort_array(c, asc=False), 1, newest)
    daily = ranked.groupBy("profile_id", "url", "day").agg(
        F.first("domain").alias("domain"), F.collect_set("trail_id").alias("trail_ids"), F.count("trail_id").alias("arrivals"), F.sum(F.col("from_visit").isNull().cast("long")).alias("typed"),
        F.count("*").alias("visits"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.collect_list(F.when(F.col("r") <= newest, F.struct("ms", "visit_id"))).alias("recent"),
    )
    # a trail may span two days, so its ids are counted over all of them
    trails_ = daily.select("profile_id", "url", F.explode("trail_ids").alias("t")).distinct().groupBy("profile_id", "url").agg(F.count("*").alias("trails"))
    out = daily.groupBy("profile_id", "url").agg(
        F.first("domain").alias("domain"), F.count("*").alias("days"), F.sum("arrivals").alias("arrivals"), F.sum("typed").alias("typed"), F.sum("visits").alias("visits"), F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"), F.sort_array(F.transform(best(F.flatten(F.collect_list("recent"))), lambda x: x.visit_id)).alias("evidence"),
    )
    out = out.join(trails_, ["profile_id", "url"], "left").fillna(0, ["trails"])
    score = sum((F.col(c) * w for c, w in zip(("days", "trails", "arrivals", "typed"), REFIND, strict=True)), F.lit(0.0))
    return out.withColumn("score", score).where("days >= 2 OR trails >= 2 OR typed >= 2")


def source_effectiveness(trail_rows: DataFrame, refinds: DataFrame) -> DataFrame:
    """Domains by what they gave: landings of trails and pages found again. Times are those of the trails, 0 without any."""
    seen = trail_rows.where("landing_domain IS NOT NULL").groupBy("profile_id", F.col("landing_domain").alias("domain"))
    landings = seen.agg(F.count("*").alias("landings"), F.count_distinct("trail_id").alias("trails"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    references = refinds.groupBy("profile_id", "domain").agg(F.count("*").alias("refs"))
    both = landings.join(references, ["profile_id", "domain"], "full").fillna(0, ["landings", "trails", "refs", "first_ms", "last_ms"])
    score = 2 * F.col("landings") + 1.5 * F.col("refs") + 0.5 * F.col("trails")
    return both.withColumn("score", score).withColumn("role", F.when((F.col("refs") >= F.col("landings")) & (F.col("refs") > 0), "reference").otherwise("landing"))


def habits(visits: DataFrame, now_ms: int) -> DataFrame:
    """Domains visited on at least five days over at least two weeks, if the gaps between days have a rhythm.

    Daily below 2 days (variation under .5), weekly from 5 to 10 (.6), periodic above 10 (.8);
    interrupted if more than twice the usual gap has passed from the last visit to now_ms.
    """
    days = visits.groupBy("profile_id", "domain", F.to_date(F.timestamp_millis("ms")).alias("d")).agg(F.max("ms").alias("ms"))
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("profile_id", "domain").orderBy("d")))
    rows = days.withColumn("gap", gap).groupBy("profile_id", "domain").agg(
        F.count("*").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.max("ms").alias("last_ms"), F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv")
    )
    kind = (
        F.when((F.col("mean_gap") < 2) & (F.col("cv") < 0.5), "daily_habit")
        .when(F.col("mean_gap").between(5, 10) & (F.col("cv") < 0.6), "weekly_habit")
        .when((F.col("mean_gap") > 10) & (F.col("cv") < 0.8), "periodic_reference")
    )
    rows = rows.where((F.col("days") >= 5) & (F.datediff("last_day", "first_day") >= 14)).withColumn("kind", kind).where("kind IS NOT NULL")
    # in whole numbers: the mean is the span of days over one gap less than days
    waited = F.greatest(F.lit(now_ms) - F.col("last_ms"), F.lit(0)) * (F.col("days") - 1)
    return rows.withColumn("interrupted", waited > F.datediff("last_day", "first_day").cast("long") * (2 * DAY_MS))


def runs(visits: DataFrame) -> DataFrame:
    """The last visit of each run of one domain within a session: domain, ms, visit_id, and the next run's domain (null at the end)."""
    rows = _slotted(visits).select(*_SLOT, "ms", "visit_id", "domain")
    firsts = rows.groupBy(*_SLOT).agg(F.min_by(F.struct("domain"), F.struct("ms", "visit_id")).alias("first_"))
    later = firsts.select(*_SLOT, F.lead("first_").over(_along()).alias("later_"))
    next_ = F.coalesce(F.lead(F.struct("domain")).over(_inside()), F.col("later_"))
    rows = rows.join(later, _SLOT).select(*_SLOT, "ms", "visit_id", "domain", next_["domain"].alias("next_domain"))
    return rows.where(F.coalesce(F.col("next_domain") != F.col("domain"), F.lit(True)))


def following(rows: DataFrame, most: int) -> DataFrame:
    """rows of runs(), with the ``most`` rows after each in its session (ms, visit_id, domain), in order, as ``following``."""
    if most < 1:
        return rows.withColumn("following", F.array().cast("array<struct<ms:bigint,visit_id:bigint,domain:string>>"))
    one = F.struct("ms", "visit_id", "domain")
    heads = rows.withColumn("r_", F.row_number().over(_inside())).where(F.col("r_") <= most).groupBy(*_SLOT).agg(F.array_sort(F.collect_list(one)).alias("head_"))
    later = heads.select(*_SLOT, F.flatten(F.collect_list("head_").over(_along().rowsBetween(1, most))).alias("later_"))
    own = F.collect_list(one).over(_inside().rowsBetween(1, most))
    return rows.join(later, _SLOT).withColumn("following", F.slice(F.concat(own, "later_"), 1, most)).drop("later_")


def path_flows(visits: DataFrame, steps: int) -> DataFrame:
    """Sequences of ``steps`` domains within sessions, runs of one domain collapsed; when last seen is the last visit of the last run."""
    rows = following(runs(visits), steps - 1)
    later = [F.get("following", F.lit(i)) for i in range(steps - 1)]
    flows = rows.select("profile_id", F.concat_ws(" → ", "domain", *[x["domain"] for x in later]).alias("pattern"), later[-1]["domain"].alias("tail"), later[-1]["ms"].alias("seen"))
    return flows.where("tail IS NOT NULL").groupBy("profile_id", "pattern").agg(F.count("*").alias("occurrences"), F.max("seen").alias("last_ms"))


#: Page categories that can be compared; fixed values.
COMPARABLE = ("article_page", "category_page", "docs_page", "forum_thread", "issue", "product_page", "pull_request", "repo", "video_page")


def compare_sets(members: DataFrame, near_ms: int = 10 * 60_000) -> DataFrame:
    """Trails that go to and fro between pages of one kind, over two domains or over sibling paths of one.

    Of one domain, there must be two first path segments and two changes of page within near_ms.
    members: with page (its category), url, raw_url, domain, query of the trail's search.
    """
    order = Window.partitionBy("trail_id", "page").orderBy("ordinal")
    pages = members.where(F.col("page").isin(*COMPARABLE))
    rows = pages.select("profile_id", "trail_id", "page", "ordinal", "ms", "url", "domain", F.regexp_extract("raw_url", r"^[^/]*//[^/]*/+([^/]+)", 1).alias("prefix"))
    turned = F.lag("url").over(order) != F.col("url")
    near = turned & (F.lag("domain").over(order) == F.col("domain")) & (F.abs(F.col("ms") - F.lag("ms").over(order)) <= near_ms)
    # whether there are two is told by the least and the greatest, in the window's own order; what is kept is counted
    out = rows.withColumn("turned", turned.cast("int")).withColumn("near", near.cast("int")).groupBy("trail_id", "page").agg(
        F.first("profile_id").alias("profile_id"), F.coalesce(F.sum("turned"), F.lit(0)).alias("alternations"), F.coalesce(F.sum("near"), F.lit(0)).alias("siblings"),
        (F.min("domain") != F.max("domain")).alias("over_domains"), (F.min("prefix") != F.max("prefix")).alias("over_prefixes"),
    )
    kept = out.where("alternations >= 2 AND (over_domains OR (over_prefixes AND siblings >= 2))").drop("over_domains", "over_prefixes")
    counts = pages.select("trail_id", "page", "url", "domain").join(kept.select("trail_id", "page"), ["trail_id", "page"], "left_semi").groupBy("trail_id", "page")
    sets = kept.join(counts.agg(F.count_distinct("url").alias("pages"), F.count_distinct("domain").alias("domains")), ["trail_id", "page"])
    return sets.select("profile_id", "trail_id", "page", "pages", "domains", "alternations", "siblings", F.concat_ws(":", F.lit("compare"), "trail_id", "page").alias("compare_set_id"))


def compare_set_pages(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The pages of compare sets: visits, and whether the trail landed there."""
    inside = members.join(sets.select("compare_set_id", "trail_id", "page"), ["trail_id", "page"])
    return inside.groupBy("compare_set_id", "url").agg(F.first("domain").alias("domain"), F.count("*").alias("visits"), F.max((F.col("role") == "landing").cast("int")).alias("is_landing"))


def search_events(members: DataFrame) -> DataFrame:
    """One row a search: its trail, query, kind (once the trail's landing domain is known) and, of keyword queries, its distinct terms."""
    landing = members.where("role = 'landing'").select("trail_id", F.col("domain").alias("landing_domain"))
    first = members.where("role = 'search_event'").join(landing, "trail_id", "left")
    kind = query_kind(F.col("search"), F.col("landing_domain"))
    normal = F.lower(F.trim(F.regexp_replace("search", r"\s+", " ")))
    rows = first.select("visit_id", "profile_id", "engine", "ms", "trail_id", F.col("search").alias("raw_query"), normal.alias("normalized_query"), kind.alias("query_kind"))
    terms = F.when(F.col("query_kind") == "keyword", F.array_sort(F.array_distinct(query_terms(F.col("normalized_query"))))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("terms", terms)


def reopened(families: DataFrame, refinds: DataFrame, titles: DataFrame) -> DataFrame:
    """Families of several searches, and pages found again on several days, as investigations that were taken up again.

    families: of families.family_rows. titles: profile_id, url, title; a page without one is named by its address.
    """
    shape = lambda kind, key, label, n, days: [F.concat_ws(":", F.lit("reopened"), "profile_id", key).alias("investigation_id"), F.col("profile_id"), F.lit(kind).alias("anchor_type"), F.col(key).alias("anchor_id"), label.alias("anchor_label"), F.col(n).alias("occurrences"), F.col(days).alias("distinct_days"), F.col("first_ms"), F.col("last_ms")]
    f = families.where("queries > 1 OR members > 1").select(*shape("query_family", "family_id", F.col("anchor_query"), "members", "queries"))
    pages = refinds.where("days > 1").join(titles.groupBy("profile_id", "url").agg(F.max("title").alias("title")), ["profile_id", "url"], "left")
    return f.unionByName(pages.select(*shape("reference_page", "url", F.coalesce("title", "url"), "days", "days")))


def navigation_paths(visits: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaves: visit_id, profile_id. Each one's way back to its root by from_visit: leaf, depth from the root, visit_id.

    Pointers double each round: every row knows an ancestor 2**k steps up, so a chain of n visits
    takes log n rounds of joins, each written. A visit counts once a leaf, at its first step; a round
    that reaches no further visit is the last, so a chain that comes back to itself ends there too.
    """
    known = visits.select("profile_id", "visit_id").distinct()
    parents = visits.where("from_visit IS NOT NULL").select("profile_id", F.col("visit_id").alias("known"), F.col("from_visit").alias("next"))
    there = known.select("profile_id", F.col("visit_id").alias("next"))
    jump = table(parents.join(there, ["profile_id", "next"], "left_semi").select("profile_id", "known", "next"), "navigation-jump")
    start = leaves.select("profile_id", F.col("visit_id").alias("leaf"), "visit_id", F.lit(0).cast("long").alias("up"))
    out = table(start.join(known, ["profile_id", "visit_id"], "left_semi").select("profile_id", "leaf", "visit_id", "up").distinct(), "navigation-paths")
    size, step = out.count(), 0
    while True:
        o, j = out.alias("o"), jump.alias("j")
        moved = o.join(j, (F.col("o.profile_id") == F.col("j.profile_id")) & (F.col("o.visit_id") == F.col("j.known"))).select(
            "o.profile_id", "o.leaf", F.col("j.next").alias("visit_id"), (F.col("o.up") + (1 << step)).alias("up")
        )
        out = table(out.unionByName(moved).groupBy("profile_id", "leaf", "visit_id").agg(F.min("up").alias("up")), "navigation-paths")
        before, size = size, out.count()
        if size == before:
            break
        a, b = jump.alias("a"), jump.alias("b")
        jump = table(a.join(b, (F.col("a.profile_id") == F.col("b.profile_id")) & (F.col("a.next") == F.col("b.known"))).select("a.profile_id", "a.known", "b.next"), "navigation-jump")
        step += 1
    depth = F.max("up").over(Window.partitionBy("profile_id", "leaf")) - F.col("up")
    return out.select("profile_id", "leaf", depth.cast("int").alias("depth"), "visit_id")
