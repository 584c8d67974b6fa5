"""Read models over visits: rollups, sessions, trails and what follows from them. Each has DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import sites, text
from wayfold.operators import facts, families, ingest, stages, structure
from wayfold.sources.testdata import VISITS_SQL, archive, visits
from wayfold.store import once, shared_folder

#: The range that ranged reads ask for, the one before it, and "today", as parameters of the queries.
RANGE, BEFORE, TODAY = ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15"), "2024-01-31"
IN_RANGE = f"date_key BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'"

S = SparkSession
ENGINE_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sites.ENGINE_NAMES.items()) + "}"
QUERIES: dict = {}
SQL: dict[str, str] = {}

DOMAINS_SQL = f"""{VISITS_SQL},
k AS (SELECT date_key, profile_id, domain, category, count(*) AS visits, count(search) AS searches, sum(is_new_domain) AS new_domain_visits FROM v GROUP BY ALL),
u AS (SELECT date_key, profile_id, domain, count(DISTINCT url) AS unique_urls FROM v GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY date_key, profile_id, domain ORDER BY visits DESC, category = 'unknown', category) AS r FROM k),
d AS (SELECT date_key, profile_id, domain, max(CASE WHEN r = 1 THEN category END) AS category, sum(visits)::BIGINT AS visits, sum(searches)::BIGINT AS searches,
  sum(new_domain_visits)::BIGINT AS new_domain_visits, max(unique_urls) AS unique_urls FROM m JOIN u USING (date_key, profile_id, domain) GROUP BY ALL)"""
SESSIONS_SQL = f"""{VISITS_SQL},
g AS (SELECT *, CASE WHEN coalesce(ms - lag(ms) OVER w > 1800000, true) THEN visit_id END AS b, ms - lag(ms) OVER w > 900000 AS wide0 FROM v WINDOW w AS (PARTITION BY profile_id ORDER BY ms, visit_id)),
s AS (SELECT *, 'session:' || profile_id || ':' || last_value(b IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY ms, visit_id) AS session_id FROM g)"""
TRAILS_SQL = f"""{SESSIONS_SQL},
o AS (SELECT *, last_value(CASE WHEN search IS NOT NULL THEN visit_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ms, visit_id) AS ob,
  coalesce(ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms, visit_id) > 900000, false) AS wide FROM s),
br AS (SELECT *, bool_or(wide AND search IS NULL) OVER (PARTITION BY session_id, ob ORDER BY ms, visit_id) AS broken FROM o WHERE ob IS NOT NULL),
tm AS (SELECT *, 'trail:' || profile_id || ':' || ob AS trail_id, row_number() OVER (PARTITION BY session_id, ob ORDER BY ms, visit_id) - 1 AS ordinal FROM br WHERE NOT broken),
tr AS (SELECT profile_id, session_id, trail_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS visits, max(CASE WHEN ordinal = 0 THEN search END) AS query,
  max(CASE WHEN ordinal = 0 THEN engine END) AS engine, max(CASE WHEN ordinal = 1 THEN domain END) AS landing_domain, max(CASE WHEN ordinal = 1 THEN url END) AS landing_url, max(ordinal) AS depth, 0::BIGINT AS reformulations FROM tm GROUP BY ALL)"""
REFIND_SQL = f"""{TRAILS_SQL},
rf0 AS (SELECT v.*, t.trail_id, row_number() OVER (PARTITION BY v.profile_id, v.url ORDER BY v.ms DESC, v.visit_id DESC) AS r FROM v LEFT JOIN (SELECT visit_id, trail_id FROM tm) t USING (visit_id) WHERE search IS NULL),
rf AS (SELECT profile_id, url, any_value(domain) AS domain, count(DISTINCT date_key) AS days, count(DISTINCT trail_id) AS trails, count(trail_id) AS arrivals,
  sum((from_visit IS NULL)::INT)::BIGINT AS typed, count(*) AS visits, min(ms) AS first_ms, max(ms) AS last_ms,
  list_sort(list(visit_id) FILTER (r <= 50)) AS evidence FROM rf0 GROUP BY ALL),
rp AS (SELECT *, 2.0 * days + 1.5 * trails + 1.0 * arrivals + 1.2 * typed AS score FROM rf WHERE days >= 2 OR trails >= 2 OR typed >= 2)"""


def query(name: str, sql: str, base: str = ""):
    """Register a query under a name, with SQL after the common table expressions of ``base``."""

    def register(f):
        QUERIES[name] = f
        SQL[name] = (f"WITH {base} " if base else "") + sql
        return f

    return register


def _stored(name: str, spark: S, d: str, build: Callable[[], DataFrame], *partition: str) -> DataFrame:
    """A plane that read models share: built at its first use, read after that."""
    return once(spark, name, [f"{d}/events.parquet"], build, partition)


def _facts(spark: S, d: str) -> DataFrame:
    return visits(spark, d)


def _domains(spark: S, d: str) -> DataFrame:
    return _stored("domains", spark, d, lambda: facts.domain_rollup(_facts(spark, d)), "date_key")


def _sessions(spark: S, d: str) -> DataFrame:
    """Visits with their sessions; what is stored is a row for each half an hour of a profile."""
    return structure.in_sessions(_facts(spark, d), _stored("session-spans", spark, d, lambda: structure.session_spans(_facts(spark, d))))


#: What is read of the members of trails, beside their trail, place and role.
MEMBER = ("visit_id", "profile_id", "session_id", "ms", "raw_url", "url", "title", "domain", "page", "engine", "search")


def _members(spark: S, d: str) -> DataFrame:
    return _stored("trail-members", spark, d, lambda: structure.trail_members(_sessions(spark, d).select(*MEMBER)))


def _trails(spark: S, d: str) -> DataFrame:
    return _stored("trails", spark, d, lambda: structure.trails(_members(spark, d)))


def _refinds(spark: S, d: str) -> DataFrame:
    return _stored("refinds", spark, d, lambda: structure.refind_pages(_facts(spark, d), _members(spark, d)))


def _events(spark: S, d: str) -> DataFrame:
    return _stored("search-events", spark, d, lambda: structure.search_events(_members(spark, d)))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


#: Orders of top sites: what the reads ask for, as columns that go down before the domain goes up.
SITE_ORDERS = {"visits": ("visits", "days"), "days": ("days", "per_day"), "per_day": ("per_day", "visits")}


def _top_sites(spark: S, d: str, by: str, most: int) -> DataFrame:
    g = _domains(spark, d).where(IN_RANGE).groupBy("domain").agg(
        F.min("category").alias("category"), F.sum("visits").alias("visits"), F.count_distinct("date_key").alias("days"), F.sum("unique_urls").alias("unique_urls")
    )
    return g.withColumn("per_day", F.round(F.col("visits") / F.col("days"), 6)).orderBy(*map(F.desc, SITE_ORDERS[by]), "domain").limit(most)


def _sites(name: str, by: str) -> None:
    order = ", ".join(f"{c} DESC" for c in SITE_ORDERS[by])

    @query(name, f"""SELECT domain, min(category) AS category, sum(visits)::BIGINT AS visits, count(DISTINCT date_key) AS days, round(sum(visits) / count(DISTINCT date_key), 6) AS per_day,
  sum(unique_urls)::BIGINT AS unique_urls FROM d WHERE {IN_RANGE} GROUP BY domain ORDER BY {order}, domain LIMIT 20""", DOMAINS_SQL)
    def sites_by(spark: S, d: str) -> DataFrame:
        return _top_sites(spark, d, by, 20)


_sites("top_sites", "visits")
_sites("top_sites_by_days", "days")
_sites("top_sites_by_average", "per_day")


@query("rollup_domain", "SELECT * FROM d", DOMAINS_SQL)
def rollup_domain(spark: S, d: str) -> DataFrame:
    return _domains(spark, d)


@query("rollup_category", "SELECT date_key, profile_id, category, sum(visits)::BIGINT AS visits, count(*) AS domains FROM d GROUP BY ALL", DOMAINS_SQL)
def rollup_category(spark: S, d: str) -> DataFrame:
    return facts.category_rollup(_domains(spark, d))


@query("rollup_engine", "SELECT date_key, profile_id, engine, count(*) AS searches FROM v WHERE engine IS NOT NULL GROUP BY ALL", VISITS_SQL)
def rollup_engine(spark: S, d: str) -> DataFrame:
    return facts.engine_rollup(_facts(spark, d))


@query("hhi_daily", """SELECT date_key, profile_id, sum(visits)::BIGINT AS visits, sum(searches)::BIGINT AS searches, sum((new_domain_visits > 0)::INT)::BIGINT AS new_domains, count(*) AS domains,
  round(sum(visits * visits) / (sum(visits) * sum(visits)), 6) AS hhi, round(sum((new_domain_visits > 0)::INT) / count(*), 6) AS discovery_rate FROM d GROUP BY ALL""", DOMAINS_SQL)
def hhi_daily(spark: S, d: str) -> DataFrame:
    return _round(facts.summary_rollup(_domains(spark, d)), "hhi", "discovery_rate")


@query("domain_trend", "SELECT date_key, sum(visits)::BIGINT AS visits FROM d WHERE domain = 'github.com' GROUP BY ALL", DOMAINS_SQL)
def domain_trend(spark: S, d: str) -> DataFrame:
    one = _facts(spark, d).where("domain = 'github.com'")  # before the rollup, so that only this site is counted
    return one.groupBy("date_key").agg(F.count("*").alias("visits"))


@query("domain_deep_dive", f"""SELECT domain, count(*) AS visits, count(DISTINCT date_key) AS active_days, count(DISTINCT t.trail_id) AS trails, count(t.trail_id) AS from_search,
  count(from_visit) AS from_link, sum((t.trail_id IS NULL AND from_visit IS NULL)::INT)::BIGINT AS typed FROM v LEFT JOIN (SELECT visit_id, trail_id FROM tm) t USING (visit_id) WHERE {IN_RANGE} GROUP BY domain""", TRAILS_SQL)
def domain_deep_dive(spark: S, d: str) -> DataFrame:
    v = visits(spark, d).where(IN_RANGE).join(_members(spark, d).select("visit_id", "trail_id"), "visit_id", "left")
    typed = (F.col("trail_id").isNull() & F.col("from_visit").isNull()).cast("long")
    return v.groupBy("domain").agg(
        F.count("*").alias("visits"), F.count_distinct("date_key").alias("active_days"), F.count_distinct("trail_id").alias("trails"),
        F.count("trail_id").alias("from_search"), F.count("from_visit").alias("from_link"), F.sum(typed).alias("typed"),
    )


@query("domain_flows", """SELECT a AS domain_from, b AS domain_to, count(*) AS n FROM (SELECT domain AS a, lead(domain) OVER (PARTITION BY session_id ORDER BY ms, visit_id) AS b FROM s) WHERE a <> b
  GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10""", SESSIONS_SQL)
def domain_flows(spark: S, d: str) -> DataFrame:
    flows = structure.runs(_sessions(spark, d)).select(F.col("domain").alias("domain_from"), F.col("next_domain").alias("domain_to")).where("domain_from <> domain_to")
    return flows.groupBy("domain_from", "domain_to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain_from", "domain_to").limit(10)


@query("rhythm_heatmap", "SELECT dayofweek(make_timestamp(ms * 1000))::INT AS dow, hour(make_timestamp(ms * 1000))::INT AS hour, count(*) AS visits FROM v WHERE category = 'docs' GROUP BY ALL", VISITS_SQL)
def rhythm_heatmap(spark: S, d: str) -> DataFrame:
    t = F.timestamp_millis("ms")
    return visits(spark, d).where("category = 'docs'").groupBy((F.dayofweek(t) - 1).alias("dow"), F.hour(t).alias("hour")).agg(F.count("*").alias("visits"))


def _discovery(grain: str, expr: str) -> None:
    @query(f"discovery_{grain}", f"SELECT {expr} AS period, sum(new_domain_visits)::BIGINT AS new_domains, sum(visits)::BIGINT AS visits, round(sum(new_domain_visits) / sum(visits), 6) AS rate FROM d GROUP BY ALL", DOMAINS_SQL)
    def discovery(spark: S, d: str) -> DataFrame:
        p = _facts(spark, d).groupBy(facts.period(F.col("date_key"), grain).alias("period")).agg(F.sum("is_new_domain").alias("new_domains"), F.count("*").alias("visits"))
        return p.withColumn("rate", F.round(F.col("new_domains") / F.col("visits"), 6))


for _grain, _expr in (("day", "date_key"), ("week", "isoyear(date_key::DATE) || '-W' || lpad(week(date_key::DATE)::VARCHAR, 2, '0')"), ("month", "substr(date_key, 1, 7)"), ("year", "substr(date_key, 1, 4)")):
    _discovery(_grain, _expr)


@query("on_this_day", """SELECT date_key, domain, visits FROM (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY visits DESC, domain) AS r
  FROM (SELECT date_key, domain, count(*) AS visits FROM v WHERE substr(date_key, 6) = '01-20' AND date_key < '2025-01-20' GROUP BY date_key, domain)) WHERE r <= 3""", VISITS_SQL)
def on_this_day(spark: S, d: str) -> DataFrame:
    v = visits(spark, d).where("substr(date_key, 6) = '01-20' AND date_key < '2025-01-20'")
    g = v.groupBy("date_key", "domain").agg(F.count("*").alias("visits"))
    r = F.row_number().over(Window.partitionBy("date_key").orderBy(F.desc("visits"), "domain"))
    return g.withColumn("r", r).where("r <= 3").drop("r")


@query("engine_ranking", "SELECT engine, count(*) AS searches FROM v WHERE engine IS NOT NULL GROUP BY engine", VISITS_SQL)
def engine_ranking(spark: S, d: str) -> DataFrame:
    return facts.engine_rollup(_facts(spark, d)).groupBy("engine").agg(F.sum("searches").alias("searches"))


#: Search events: kind after the landing domain, distinct terms of keyword queries.
EVENTS_SQL = rf"""{TRAILS_SQL},
se0 AS (SELECT t.visit_id, t.profile_id, t.engine, t.ms, t.trail_id, t.search AS raw_query, lower(trim(regexp_replace(t.search, '\s+', ' ', 'g'))) AS normalized_query, l.domain AS landing_domain,
  trim(trim(trim(t.search), '"'), chr(39)) AS asked FROM tm t LEFT JOIN (SELECT trail_id, domain FROM tm WHERE ordinal = 1) l USING (trail_id) WHERE t.ordinal = 0),
se1 AS (SELECT *, CASE WHEN NOT regexp_matches(asked, '\s') AND contains(asked, '.') THEN string_split(regexp_extract('https://' || lower(asked), '^https://([^/?#:]*)', 1), '.') END AS asked_labels FROM se0),
se2 AS (SELECT *, array_to_string(asked_labels[-2:], '.') AS asked_domain FROM se1),
ev AS (SELECT visit_id, profile_id, engine, ms, trail_id, raw_query, normalized_query, CASE WHEN normalized_query = '' OR (asked_domain IS NOT NULL AND (landing_domain IS NULL OR landing_domain = asked_domain OR ends_with(landing_domain, '.' || asked_domain)
  OR ends_with(asked_domain, '.' || landing_domain))) THEN 'navigational' ELSE 'keyword' END AS query_kind FROM se2),
et AS (SELECT *, CASE WHEN query_kind = 'keyword' THEN list_sort(list_distinct(list_filter(regexp_split_to_array(normalized_query, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND w NOT IN {text.STOP_WORDS}))) ELSE [] END AS terms FROM ev)"""


@query("search_events", "SELECT visit_id, profile_id, engine, ms, trail_id, raw_query, normalized_query, query_kind, array_to_string(terms, ' ') AS terms FROM et", EVENTS_SQL)
def search_events(spark: S, d: str) -> DataFrame:
    return _events(spark, d).withColumn("terms", F.array_join("terms", " "))


@query("search_concepts", """SELECT term, count(*) AS uses, count(DISTINCT engine) AS engines, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engine_list FROM
  (SELECT visit_id, engine, unnest(terms) AS term FROM et) GROUP BY term""", EVENTS_SQL)
def search_concepts(spark: S, d: str) -> DataFrame:
    words = _events(spark, d).select("engine", F.explode("terms").alias("term"))
    engines = F.array_sort(F.collect_set("engine"))
    return words.groupBy("term").agg(F.count("*").alias("uses"), F.count_distinct("engine").alias("engines"), F.array_join(engines, ",").alias("engine_list"))


@query("search_queries", """SELECT engine, search, visit_id, ms, n AS exact_repeats FROM (SELECT *, row_number() OVER (PARTITION BY engine, search ORDER BY ms DESC, visit_id DESC) AS r,
  count(*) OVER (PARTITION BY engine, search) AS n FROM v WHERE search IS NOT NULL) WHERE r = 1""", VISITS_SQL)
def search_queries(spark: S, d: str) -> DataFrame:
    newest = F.max(F.struct("ms", "visit_id"))  # an aggregate combines map-side, where a window would move every row
    g = visits(spark, d).where("search IS NOT NULL").groupBy("engine", "search").agg(newest.alias("at"), F.count("*").alias("exact_repeats"))
    return g.select("engine", "search", "at.visit_id", "at.ms", "exact_repeats")


_IN, _OUT = (f"date_key BETWEEN '{a}' AND '{b}'" for a, b in (RANGE, BEFORE))


@query("activity_mix", f"""SELECT category, now, before, round(now / greatest(tn, 1), 6) AS share, round(before / greatest(tb, 1), 6) AS share_before, round(now / greatest(tn, 1) - before / greatest(tb, 1), 6) AS change FROM
  (SELECT *, sum(now) OVER () AS tn, sum(before) OVER () AS tb FROM (SELECT category, sum(visits) FILTER ({_IN})::BIGINT AS now, coalesce(sum(visits) FILTER ({_OUT}), 0)::BIGINT AS before FROM d WHERE {_IN} OR {_OUT} GROUP BY category)) WHERE now IS NOT NULL""", DOMAINS_SQL)
def activity_mix(spark: S, d: str) -> DataFrame:
    """Categories of the range (a domain's day counts in its main one), their shares and what these were before."""
    rows = _domains(spark, d).where(f"{_IN} OR {_OUT}")
    g = rows.groupBy("category").agg(F.sum(F.expr(f"CASE WHEN {_IN} THEN visits END")).alias("now"), F.coalesce(F.sum(F.expr(f"CASE WHEN {_OUT} THEN visits END")), F.lit(0)).alias("before"))
    w = Window.partitionBy()  # one row a category
    now, before = (F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)) for c in ("now", "before"))
    out = g.select("category", "now", "before", now.alias("_now"), before.alias("_before")).where("now IS NOT NULL")
    return out.select("category", "now", "before", F.round("_now", 6).alias("share"), F.round("_before", 6).alias("share_before"), F.round(F.col("_now") - F.col("_before"), 6).alias("change"))


@query("activity_mix_trend", "SELECT period, category, n AS visits, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM (SELECT isoyear(date_key::DATE) || '-W' || lpad(week(date_key::DATE)::VARCHAR, 2, '0') AS period, category, sum(visits)::BIGINT AS n FROM d GROUP BY ALL)", DOMAINS_SQL)
def activity_mix_trend(spark: S, d: str) -> DataFrame:
    g = _domains(spark, d).groupBy(facts.period(F.col("date_key"), "week").alias("period"), "category").agg(F.sum("visits").alias("visits"))
    return g.withColumn("share", F.round(F.col("visits") / F.sum("visits").over(Window.partitionBy("period")), 6))


def _ms(day: str, after: int = 0) -> int:
    return int((dt.datetime.fromisoformat(day) + dt.timedelta(days=after) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


#: First and end of the range and of the one before, in milliseconds.
_SPANS = {"now": (_ms(RANGE[0]), _ms(RANGE[1], 1)), "before": (_ms(BEFORE[0]), _ms(BEFORE[1], 1))}
_KPIS = ("total_visits", "total_searches", "new_domains", "deep_read_pages", "refind_pages")
_PART = lambda days, a, b: f"""SELECT unnest(['total_visits', 'total_searches', 'new_domains', 'deep_read_pages', 'refind_pages']) AS kpi, unnest([(SELECT coalesce(sum(visits), 0) FROM d WHERE {days}), (SELECT coalesce(sum(searches), 0) FROM d WHERE {days}),
  (SELECT coalesce(sum((new_domain_visits > 0)::INT), 0) FROM d WHERE {days}), (SELECT count(*) FROM ds WHERE first_ms >= {a} AND first_ms < {b}), (SELECT count(*) FROM rp WHERE last_ms >= {a} AND first_ms < {b})])::BIGINT AS value"""  # noqa: E731


@query("digest_kpis", f"SELECT kpi, n.value AS now, b.value AS before, n.value - b.value AS change, CASE WHEN n.value > b.value THEN 'up' WHEN n.value < b.value THEN 'down' ELSE 'flat' END AS direction FROM ({_PART(_IN, *_SPANS['now'])}) n JOIN ({_PART(_OUT, *_SPANS['before'])}) b USING (kpi)",
       REFIND_SQL + "," + DOMAINS_SQL[len(VISITS_SQL) + 1 :] + """, ds AS (SELECT session_id, min(ms) AS first_ms FROM s GROUP BY profile_id, session_id HAVING count(from_visit) >= 4 AND count(DISTINCT domain) >= 5 AND count(*) >= 8 AND sum(is_new_domain) >= 1)""")
def digest_kpis(spark: S, d: str) -> DataFrame:
    """The five figures of the range beside those of the one before: visits, searches, new domains, deep dives begun, pages found again."""
    return structure.digest(facts.summary_rollup(_domains(spark, d)), structure.sessions(_sessions(spark, d)), _refinds(spark, d), RANGE, BEFORE)


@query("breadth_index", f"""SELECT count(*) AS domains, round((1 - sum(n * n) / (sum(n) * sum(n))) * 100, 6) AS breadth, sum((coalesce(before, 0) * 2 < total)::INT)::BIGINT AS domains_for_half FROM
  (SELECT n, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT domain, count(*) AS n FROM v WHERE {IN_RANGE} GROUP BY domain))""", VISITS_SQL)
def breadth_index(spark: S, d: str) -> DataFrame:
    g = visits(spark, d).where(IN_RANGE).groupBy("domain").agg(F.count("*").alias("n"))
    # sites of one count are summed first, so the running sum is over distinct counts, not over sites
    same = g.groupBy("n").agg(F.count("*").alias("m"))
    up = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    r = same.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("m")).over(up), F.lit(0))).withColumn("total", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy()))
    need = F.least(F.greatest(F.ceil((F.col("total") / 2 - F.col("before")) / F.col("n")), F.lit(0)), F.col("m"))
    return r.agg(F.sum("m").alias("domains"), F.round((1 - F.sum(F.col("n") * F.col("n") * F.col("m")) / (F.max("total") * F.max("total"))) * 100, 6).alias("breadth"), F.sum(need).cast("long").alias("domains_for_half"))


@query("sessions_30m", """SELECT profile_id, session_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS visits, count(search) AS searches, count(DISTINCT domain) AS domains, sum(is_new_domain)::BIGINT AS new_domains,
  count(from_visit) AS depth, count(from_visit) >= 4 AND count(DISTINCT domain) >= 5 AND count(*) >= 8 AND sum(is_new_domain) >= 1 AS deep_dive FROM s GROUP BY ALL""", SESSIONS_SQL)
def sessions_30m(spark: S, d: str) -> DataFrame:
    return structure.sessions(_sessions(spark, d))


@query("trail_members", "SELECT visit_id, profile_id, session_id, trail_id, ordinal, CASE WHEN ordinal = 0 THEN 'search_event' WHEN ordinal = 1 THEN 'landing' ELSE 'click' END AS role FROM tm", TRAILS_SQL)
def trail_members(spark: S, d: str) -> DataFrame:
    return _members(spark, d).select("visit_id", "profile_id", "session_id", "trail_id", "ordinal", "role")


@query("search_trails", "SELECT * FROM tr", TRAILS_SQL)
def search_trails(spark: S, d: str) -> DataFrame:
    return _trails(spark, d)


@query("hub_pages", f"SELECT url, domain, max(title) AS title, count(DISTINCT trail_id) AS trails FROM tm WHERE ms >= {_SPANS['now'][0]} AND ms < {_SPANS['now'][1]} GROUP BY url, domain ORDER BY trails DESC, url, domain LIMIT 10", TRAILS_SQL)
def hub_pages(spark: S, d: str) -> DataFrame:
    return structure.hub_pages(_members(spark, d), *_SPANS["now"])


#: As of facts.overlapping().
_OVER = f"last_ms >= epoch_ms(TIMESTAMP '{RANGE[0]}') AND first_ms < epoch_ms(TIMESTAMP '{RANGE[1]}') + 86400000"


@query("search_effectiveness", f"""SELECT engine, any_value(({ENGINE_NAMES})[engine]) AS name, avg(reformulations) AS reformulations, count(*) AS trails, round(avg(depth), 6) AS depth, count(landing_domain) AS landed FROM tr
  WHERE {_OVER} GROUP BY engine""", TRAILS_SQL)
def search_effectiveness(spark: S, d: str) -> DataFrame:
    g = facts.overlapping(_trails(spark, d), *RANGE).groupBy("engine").agg(F.avg("reformulations").alias("reformulations"), F.count("*").alias("trails"), F.round(F.avg("depth"), 6).alias("depth"), F.count("landing_domain").alias("landed"))
    return g.withColumn("name", sites.engine_name(F.col("engine")))


@query("friction_signals", """SELECT trail_id, landing_domain, CASE WHEN reformulations >= 2 THEN 'excessive_reformulation' ELSE 'bounce_pattern' END AS kind, greatest(visits, reformulations) AS occurrences FROM tr
  WHERE reformulations >= 2 OR (landing_domain IS NULL AND visits >= 3) ORDER BY reformulations DESC, visits DESC, trail_id LIMIT 10""", TRAILS_SQL)
def friction_signals(spark: S, d: str) -> DataFrame:
    return structure.friction(_trails(spark, d))


@query("refind_pages", "SELECT profile_id, url, domain, days, trails, arrivals, typed, visits, first_ms, last_ms, array_to_string(evidence, ',') AS evidence, round(score, 6)::DOUBLE AS score FROM rp", REFIND_SQL)
def refind_pages(spark: S, d: str) -> DataFrame:
    r = _refinds(spark, d).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))
    return _round(r, "score")


_EFFECT = """, la AS (SELECT profile_id, landing_domain AS domain, count(*) AS landings, count(DISTINCT trail_id) AS trails, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM tr WHERE landing_domain IS NOT NULL GROUP BY ALL),
rr AS (SELECT profile_id, domain, count(*) AS refs FROM rp GROUP BY ALL),
se AS (SELECT profile_id, domain, coalesce(landings, 0) AS landings, coalesce(trails, 0) AS trails, coalesce(refs, 0) AS refs, coalesce(first_ms, 0) AS first_ms, coalesce(last_ms, 0) AS last_ms FROM la FULL JOIN rr USING (profile_id, domain)),
sc AS (SELECT *, round(2 * landings + 1.5 * refs + 0.5 * trails, 6)::DOUBLE AS score, CASE WHEN refs >= landings AND refs > 0 THEN 'reference' ELSE 'landing' END AS role FROM se)"""


@query("source_effectiveness", "SELECT * FROM sc", REFIND_SQL + _EFFECT)
def source_effectiveness(spark: S, d: str) -> DataFrame:
    return _round(structure.source_effectiveness(_trails(spark, d), _refinds(spark, d)), "score")


_STABLE = f"SELECT domain, profile_id, role, trails, landings, score FROM sc WHERE {_OVER} ORDER BY score DESC, domain, profile_id LIMIT 10"


@query("stable_sources", _STABLE, REFIND_SQL + _EFFECT)
def stable_sources(spark: S, d: str) -> DataFrame:
    """The ten sources that gave most, of those seen in the range."""
    rows = facts.overlapping(source_effectiveness(spark, d), *RANGE).select("domain", "profile_id", "role", "trails", "landings", "score")
    return rows.orderBy(F.desc("score"), "domain", "profile_id").limit(10)


HABITS_RAW = f"""SELECT *, greatest({_ms(TODAY)} - last_ms, 0) * (days - 1) > 2 * date_diff('day', first_day, last_day) * 86400000 AS interrupted FROM
  (SELECT *, CASE WHEN mean_gap < 2 AND cv < 0.5 THEN 'daily_habit' WHEN mean_gap BETWEEN 5 AND 10 AND cv < 0.6 THEN 'weekly_habit' WHEN mean_gap > 10 AND cv < 0.8 THEN 'periodic_reference' END AS kind FROM
  (SELECT profile_id, domain, count(*) AS days, min(d) AS first_day, max(d) AS last_day, max(ms) AS last_ms, avg(gap) AS mean_gap, stddev_pop(gap) / avg(gap) AS cv FROM
    (SELECT profile_id, domain, d, ms, date_diff('day', lag(d) OVER (PARTITION BY profile_id, domain ORDER BY d), d) AS gap FROM (SELECT profile_id, domain, date_key::DATE AS d, max(ms) AS ms FROM v GROUP BY ALL)) GROUP BY ALL)
  WHERE days >= 5 AND date_diff('day', first_day, last_day) >= 14) WHERE kind IS NOT NULL"""
HABITS_SQL = f"SELECT * EXCLUDE (mean_gap, cv), round(mean_gap, 6) AS mean_gap, round(cv, 6) AS cv FROM ({HABITS_RAW})"


@query("habits", HABITS_SQL, VISITS_SQL)
def habits(spark: S, d: str) -> DataFrame:
    return _round(structure.habits(visits(spark, d), _ms(TODAY)), "mean_gap", "cv")


def flows_sql(n: int) -> str:
    lead = ", ".join(f"lead(domain, {i}) OVER w AS d{i}" for i in range(1, n))
    pattern = " || ' → ' || ".join(["domain", *[f"d{i}" for i in range(1, n)]])
    return f"""SELECT profile_id, pattern, count(*) AS occurrences, max(seen) AS last_ms FROM (SELECT profile_id, {pattern} AS pattern, seen FROM
  (SELECT *, {lead}, lead(ms, {n - 1}) OVER w AS seen FROM (SELECT *, lead(domain) OVER (PARTITION BY session_id ORDER BY ms, visit_id) AS nx FROM s) WHERE nx IS NULL OR nx <> domain
   WINDOW w AS (PARTITION BY session_id ORDER BY ms, visit_id))) WHERE pattern IS NOT NULL GROUP BY ALL"""


def _flows(n: int) -> None:
    @query(f"path_flows_{n}", flows_sql(n), SESSIONS_SQL)
    def flows(spark: S, d: str) -> DataFrame:
        return structure.path_flows(_sessions(spark, d), n)


for _n in (2, 3, 4):
    _flows(_n)


_COMPARE = TRAILS_SQL + f""",
cs0 AS (SELECT *, lag(url) OVER w <> url AS t, lag(domain) OVER w AS pd, lag(ms) OVER w AS pm, regexp_extract(raw_url, '^[^/]*//[^/]*/+([^/]+)', 1) AS prefix FROM tm WHERE page IN {structure.COMPARABLE} WINDOW w AS (PARTITION BY trail_id, page ORDER BY ordinal)),
cs AS (SELECT 'compare:' || trail_id || ':' || page AS compare_set_id, * FROM (SELECT profile_id, trail_id, page, count(DISTINCT url) AS pages, count(DISTINCT domain) AS domains, coalesce(sum(t::INT), 0)::BIGINT AS alternations,
  coalesce(sum((t AND pd = domain AND ms - pm <= 600000)::INT), 0)::BIGINT AS siblings, count(DISTINCT prefix) AS prefixes FROM cs0 GROUP BY ALL)
  WHERE pages >= 2 AND alternations >= 2 AND (domains >= 2 OR (prefixes >= 2 AND siblings >= 2)))"""


@query("compare_sets", "SELECT compare_set_id, profile_id, trail_id, page, pages, domains, alternations, siblings FROM cs", _COMPARE)
def compare_sets(spark: S, d: str) -> DataFrame:
    return structure.compare_sets(_members(spark, d))


@query("compare_set_detail", "SELECT compare_set_id, url, any_value(domain) AS domain, count(*) AS visits, max((ordinal = 1)::INT) AS is_landing FROM tm JOIN (SELECT compare_set_id, trail_id, page FROM cs) USING (trail_id, page) GROUP BY compare_set_id, url", _COMPARE)
def compare_set_detail(spark: S, d: str) -> DataFrame:
    return structure.compare_set_pages(_members(spark, d), compare_sets(spark, d))


@query("browser_diff", f"SELECT domain, count(DISTINCT profile_id) AS profiles, CASE WHEN count(DISTINCT profile_id) = 1 THEN min(profile_id) END AS only_in, sum(visits)::BIGINT AS visits FROM d WHERE {IN_RANGE} GROUP BY domain", DOMAINS_SQL)
def browser_diff(spark: S, d: str) -> DataFrame:
    """Domains of the range that all profiles share or one has to itself."""
    g = _domains(spark, d).where(IN_RANGE).groupBy("domain").agg(F.count_distinct("profile_id").alias("profiles"), F.min("profile_id").alias("only_in"), F.sum("visits").alias("visits"))
    return g.withColumn("only_in", F.when(F.col("profiles") == 1, F.col("only_in")))


@query("browser_profiles", f"SELECT profile_id, count(DISTINCT domain) AS domains, sum(visits)::BIGINT AS visits FROM d WHERE {IN_RANGE} GROUP BY profile_id HAVING sum(visits) > 0", DOMAINS_SQL)
def browser_profiles(spark: S, d: str) -> DataFrame:
    return _domains(spark, d).where(IN_RANGE).groupBy("profile_id").agg(F.count_distinct("domain").alias("domains"), F.sum("visits").alias("visits")).where("visits > 0")


@query("browser_categories", f"SELECT profile_id, category, visits, round(visits / sum(visits) OVER (PARTITION BY profile_id), 6) AS share FROM (SELECT profile_id, category, sum(visits)::BIGINT AS visits FROM d WHERE {IN_RANGE} GROUP BY ALL)", DOMAINS_SQL)
def browser_categories(spark: S, d: str) -> DataFrame:
    g = facts.category_rollup(_domains(spark, d).where(IN_RANGE)).groupBy("profile_id", "category").agg(F.sum("visits").alias("visits"))
    return g.withColumn("share", F.round(F.col("visits") / F.sum("visits").over(Window.partitionBy("profile_id")), 6))


@query("day_insights", """SELECT hour(make_timestamp(ms * 1000))::INT AS hour, count(*) AS visits, count(search) AS searches, count(from_visit) AS links, count(DISTINCT domain) AS domains, count(DISTINCT session_id) AS sessions
  FROM s WHERE date_key = '2024-01-20' GROUP BY ALL""", SESSIONS_SQL)
def day_insights(spark: S, d: str) -> DataFrame:
    v = _sessions(spark, d).where(facts.day(F.col("ms")) == "2024-01-20")
    return v.groupBy(F.hour(F.timestamp_millis("ms")).alias("hour")).agg(
        F.count("*").alias("visits"), F.count("search").alias("searches"), F.count("from_visit").alias("links"), F.count_distinct("domain").alias("domains"), F.count_distinct("session_id").alias("sessions")
    )


@query("grouping_sets_rollup", "SELECT date_key, domain, category, count(*) AS visits FROM v GROUP BY GROUPING SETS ((date_key, domain), (date_key, category), (date_key), ())", VISITS_SQL)
def grouping_sets_rollup(spark: S, d: str) -> DataFrame:
    v = visits(spark, d)
    sets = [["date_key", "domain"], ["date_key", "category"], ["date_key"], []]
    return v.groupingSets([[F.col(c) for c in s] for s in sets], F.col("date_key"), F.col("domain"), F.col("category")).agg(F.count("*").alias("visits"))


@query("visible_totals", """SELECT (SELECT count(*) FROM (SELECT DISTINCT profile_id FROM av0)) AS profiles, (SELECT count(*) FROM aurls) AS urls, count(*) AS visits, min(ms) AS first_ms, max(ms) AS last_ms FROM avisits""", VISITS_SQL)
def visible_totals(spark: S, d: str) -> DataFrame:
    """Totals of the archive without the visits of reverted import batches."""
    a = archive(spark, d)
    return ingest.totals(a["profiles"], a["urls"], ingest.visible(a["visits"], a["reverted"]))


@query("navigation_path", """SELECT profile_id, leaf, depth, visit_id FROM (WITH RECURSIVE p AS (SELECT profile_id, visit_id AS leaf, visit_id, from_visit, 0 AS up FROM v
  UNION ALL SELECT p.profile_id, p.leaf, v.visit_id, v.from_visit, p.up + 1 FROM p JOIN v ON v.visit_id = p.from_visit AND v.profile_id = p.profile_id)
  SELECT profile_id, leaf, max(up) OVER (PARTITION BY profile_id, leaf) - up AS depth, visit_id FROM p)""", VISITS_SQL)
def navigation_path(spark: S, d: str) -> DataFrame:
    return structure.navigation_paths(visits(spark, d), visits(spark, d))


#: Families one search after the other: of each profile and engine the anchors so far, and the family of each set of terms.
FAMILIES_SQL = f"""RECURSIVE {EVENTS_SQL},
fs AS (SELECT profile_id, engine, terms, pos, row_number() OVER (PARTITION BY profile_id, engine ORDER BY pos) AS r FROM (SELECT profile_id, engine, terms, min(visit_id) AS pos FROM et WHERE len(terms) > 0 GROUP BY ALL)),
fg AS (SELECT profile_id, engine, r, terms, pos, pos AS anchor, [{{'pos': pos, 'terms': terms}}] AS anchors FROM fs WHERE r = 1
  UNION ALL SELECT profile_id, engine, r, terms, pos, coalesce(m, pos), CASE WHEN m IS NULL THEN list_append(anchors, {{'pos': pos, 'terms': terms}}) ELSE anchors END FROM
    (SELECT n.profile_id, n.engine, n.r, n.terms, n.pos, g.anchors, list_filter(g.anchors, lambda a: len(list_intersect(a.terms, n.terms)) >= least(len(a.terms), len(n.terms), ceil((len(a.terms) + len(n.terms)) / 3.0)))[1].pos AS m
     FROM fg g JOIN fs n ON n.profile_id = g.profile_id AND n.engine = g.engine AND n.r = g.r + 1)),
fn AS (SELECT profile_id, pos, 'family:' || profile_id || ':' || lpad(row_number() OVER (PARTITION BY profile_id ORDER BY pos)::VARCHAR, greatest(4, length(row_number() OVER (PARTITION BY profile_id ORDER BY pos)::VARCHAR)::INT), '0') AS family_id FROM fg WHERE pos = anchor),
fm AS (SELECT e.profile_id, e.engine, e.visit_id, e.ms, e.raw_query, e.normalized_query, fn.family_id FROM et e JOIN fg ON fg.profile_id = e.profile_id AND fg.engine = e.engine AND fg.terms = e.terms JOIN fn ON fn.profile_id = fg.profile_id AND fn.pos = fg.anchor),
ff AS (SELECT profile_id, engine, family_id, min_by(raw_query, visit_id) AS anchor_query, count(*) AS members, count(DISTINCT normalized_query) AS queries, min_by(ms, visit_id) AS first_ms, max(ms) AS last_ms FROM fm GROUP BY ALL)"""


def _families(spark: S, d: str) -> DataFrame:
    return _stored("families", spark, d, lambda: families.query_families(_events(spark, d)))


@query("query_families", "SELECT * FROM fm", FAMILIES_SQL)
def query_families(spark: S, d: str) -> DataFrame:
    """The family of each search by keywords."""
    return _families(spark, d)


@query("family_list", f"SELECT * FROM ff WHERE {_OVER} ORDER BY members DESC, last_ms DESC, family_id LIMIT 100", FAMILIES_SQL)
def family_list(spark: S, d: str) -> DataFrame:
    """Families of searches seen in the range, the largest first."""
    return facts.overlapping(families.family_rows(_families(spark, d)), *RANGE).orderBy(F.desc("members"), F.desc("last_ms"), "family_id").limit(100)


_LARGEST = "(SELECT family_id FROM ff ORDER BY members DESC, family_id LIMIT 1)"


@query("family_detail", f"SELECT f.family_id, visit_id, f.ms, raw_query, (f.ms - lag(f.ms) OVER (ORDER BY visit_id)) AS since_ms, t.landing_domain, t.landing_url FROM fm f LEFT JOIN (SELECT profile_id, trail_id, landing_domain, landing_url FROM tr) t ON t.trail_id = 'trail:' || f.profile_id || ':' || f.visit_id WHERE f.family_id = {_LARGEST}", FAMILIES_SQL)
def family_detail(spark: S, d: str) -> DataFrame:
    """The searches of the largest family in order, with where each led."""
    largest = families.family_rows(_families(spark, d)).orderBy(F.desc("members"), "family_id").first()
    own = _families(spark, d).where(F.col("family_id") == (largest.family_id if largest else None))
    return families.detail(own, _trails(spark, d))


@query("hardest_topics", f"SELECT family_id, anchor_query, members, round(greatest(last_ms - first_ms, 0) / 86400000.0::DOUBLE, 6) AS lag_days FROM (SELECT * FROM ff WHERE {_OVER} ORDER BY members DESC, last_ms DESC, family_id LIMIT 5)", FAMILIES_SQL)
def hardest_topics(spark: S, d: str) -> DataFrame:
    """Topics that were searched most often in the range, and over how long."""
    rows = facts.overlapping(families.family_rows(_families(spark, d)), *RANGE).orderBy(F.desc("members"), F.desc("last_ms"), "family_id").limit(5)
    return rows.select("family_id", "anchor_query", "members", F.round(F.greatest(F.col("last_ms") - F.col("first_ms"), F.lit(0)) / 86_400_000.0, 6).alias("lag_days"))


REOPENED_SQL = FAMILIES_SQL + "," + REFIND_SQL[len(TRAILS_SQL) + 1 :] + """,
ro AS (SELECT 'reopened:' || profile_id || ':' || family_id AS investigation_id, profile_id, 'query_family' AS anchor_type, family_id AS anchor_id, anchor_query AS anchor_label, members AS occurrences, queries AS distinct_days, first_ms, last_ms FROM ff WHERE queries > 1 OR members > 1
  UNION ALL SELECT 'reopened:' || profile_id || ':' || url, profile_id, 'reference_page', url, coalesce(t.title, url), days, days, first_ms, last_ms FROM rp LEFT JOIN (SELECT profile_id, url, max(title) AS title FROM v GROUP BY ALL) t USING (profile_id, url) WHERE days > 1)"""


def _reopened(spark: S, d: str) -> DataFrame:
    return structure.reopened(families.family_rows(_families(spark, d)), _refinds(spark, d), _facts(spark, d))


@query("reopened_investigations", "SELECT * FROM ro", REOPENED_SQL)
def reopened_investigations(spark: S, d: str) -> DataFrame:
    """All families and pages that were taken up again."""
    return _reopened(spark, d)


@query("reopened_list", f"SELECT * FROM ro WHERE {_OVER} ORDER BY last_ms DESC, occurrences DESC, investigation_id LIMIT 10", REOPENED_SQL)
def reopened_list(spark: S, d: str) -> DataFrame:
    """The ten last of them that were seen in the range."""
    return facts.overlapping(_reopened(spark, d), *RANGE).orderBy(F.desc("last_ms"), F.desc("occurrences"), "investigation_id").limit(10)


def _staged(spark: S, d: str, stage: str, build: Callable[..., DataFrame]) -> DataFrame:
    """A stage's table after three runs: of the first half of the visits by id, of all, and of all again, which does nothing."""
    a, v = archive(spark, d), _facts(spark, d)
    folder = f"{shared_folder(spark)}/wayfold-stages-{uuid.uuid4().hex}"
    half = v.agg((F.max("visit_id") / 2).cast("long")).first()[0]
    for rows in (v.where(F.col("visit_id") <= half), v, v):
        stages.run(folder, stage, stages.watermarks(rows, a["urls"], a["search_terms"], a["profiles"]), rows, build)
    return stages.load(spark, folder, stage)[0]


@query("staged_rollup", "SELECT * FROM d", DOMAINS_SQL)
def staged_rollup(spark: S, d: str) -> DataFrame:
    """Domain rollups of which only the days of new visits were counted again."""
    return _staged(spark, d, "daily-rollup", stages.daily)


@query("staged_sessions", SQL["sessions_30m"].split(SESSIONS_SQL, 1)[1], SESSIONS_SQL)
def staged_sessions(spark: S, d: str) -> DataFrame:
    """Sessions of which only those that new visits touch, and later ones, were built again."""
    return _staged(spark, d, "structural-rebuild", stages.structural)
