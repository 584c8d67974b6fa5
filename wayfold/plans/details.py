"""Explanations, details, overviews and ingest over the archive of the test data, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import pages, sites, text
from wayfold.operators import archive as derive
from wayfold.operators import explain, facts, families, images, ingest, outputs, structure, vectors
from wayfold.plans import history as h
from wayfold.sources.testdata import VISITS_SQL, archive, visits
from wayfold.store import once

S = SparkSession
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, base: str = VISITS_SQL):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {base} {sql}"
        return f

    return register


def _factors(kind: str, entity: str, weights: dict[str, float], source: str, fractions: dict[str, tuple[str, str]] | None = None) -> str:
    def cell(c: str, w: float) -> str:
        if c not in (fractions or {}):
            return f"{{'factor': '{c}', 'raw': round(({c})::DOUBLE, 6), 'weight': {w}::DOUBLE, 'contribution': round(({c})::DOUBLE * {w}::DOUBLE, 6)}}"
        num, den = fractions[c]
        whole = lambda n, d: f"((2000000 * {n} + {d})::HUGEINT // (2 * {d})) / 1000000.0::DOUBLE"
        return f"{{'factor': '{c}', 'raw': {whole(num, den)}, 'weight': {w}::DOUBLE, 'contribution': {whole(f'{round(w * 100)} * {num}', f'(100 * {den})')}}}"

    cells = ", ".join(cell(c, w) for c, w in weights.items())
    return f"SELECT kind, entity, f.factor AS factor, f.raw AS raw, f.weight AS weight, f.contribution AS contribution FROM (SELECT '{kind}' AS kind, {entity} AS entity, unnest([{cells}]) AS f FROM ({source}))"


_SES = """SELECT session_id, count(*) AS visits, count(search) AS searches, count(DISTINCT domain) AS domains, count(from_visit) AS depth, max(ms) - min(ms) AS span FROM s GROUP BY profile_id, session_id"""


@query("explain_sessions", _factors("session", "session_id", explain.SESSION, _SES, {"duration_minutes": ("span", "60000")}), h.SESSIONS_SQL)
def explain_sessions(spark: S, d: str) -> DataFrame:
    return explain.session_factors(structure.sessions(h._sessions(spark, d)))


@query("explain_trails", _factors("search_trail", "trail_id", explain.TRAIL, "SELECT *, (landing_domain IS NOT NULL)::INT AS landed FROM tr"), h.TRAILS_SQL)
def explain_trails(spark: S, d: str) -> DataFrame:
    return explain.trail_factors(h._trails(spark, d))


@query("explain_refinds", _factors("refind_page", "profile_id || '::' || url", explain.PAGE, "SELECT * FROM rp"), h.REFIND_SQL)
def explain_refinds(spark: S, d: str) -> DataFrame:
    return explain.refind_factors(h._refinds(spark, d))


@query("explain_habits", _factors("habit_pattern", "profile_id || '::' || domain", explain.HABIT, "SELECT hb.*, c.visits, interrupted::INT AS is_interrupted FROM hb JOIN (SELECT profile_id, domain, count(*) AS visits FROM v GROUP BY ALL) c USING (profile_id, domain)", {"mean_gap": ("date_diff('day', first_day, last_day)", "(days - 1)")}), f"{VISITS_SQL}, hb AS ({h.HABITS_RAW})")
def explain_habits(spark: S, d: str) -> DataFrame:
    return explain.habit_factors(structure.habits(visits(spark, d), h._ms(h.TODAY)), visits(spark, d))


@query("explain_flows", _factors("path_flow", "profile_id || '::2::' || pattern", explain.FLOW, "SELECT *, 2 AS steps FROM fl"), f"{h.SESSIONS_SQL}, fl AS ({h.flows_sql(2)})")
def explain_flows(spark: S, d: str) -> DataFrame:
    return explain.flow_factors(structure.path_flows(h._sessions(spark, d), 2), 2)


@query("explain_compare_sets", _factors("compare_set", "compare_set_id", explain.COMPARE, "SELECT * FROM cs"), h._COMPARE)
def explain_compare_sets(spark: S, d: str) -> DataFrame:
    return explain.compare_factors(h.compare_sets(spark, d))


@query("explain_families", _factors("query_family", "family_id", explain.FAMILY, "SELECT * FROM ff"), h.FAMILIES_SQL)
def explain_families(spark: S, d: str) -> DataFrame:
    return explain.family_factors(families.family_rows(h._families(spark, d)))


@query("explain_reopened", _factors("reopened_investigation", "investigation_id", explain.REOPENED, "SELECT * FROM ro"), h.REOPENED_SQL)
def explain_reopened(spark: S, d: str) -> DataFrame:
    return explain.reopened_factors(h._reopened(spark, d))


@query("session_titles", f"""SELECT profile_id, session_id, concat_ws(' · ', coalesce(({{"MAP"}})[domain], domain), first_query) AS title FROM (SELECT profile_id, session_id, min_by(domain, (-n, domain)) AS domain, min(q).query AS first_query FROM
  (SELECT profile_id, session_id, domain, count(*) AS n, min({{'ms': ms, 'visit_id': visit_id, 'query': query}}) FILTER (query IS NOT NULL) AS q FROM s GROUP BY ALL) GROUP BY ALL)""".replace('{"MAP"}', "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sites.SITE_NAMES.items()) + "}"), h.SESSIONS_SQL)
def session_titles(spark: S, d: str) -> DataFrame:
    return structure.session_titles(h._sessions(spark, d))


_LONGEST = "SELECT session_id FROM s GROUP BY session_id ORDER BY count(*) DESC, session_id LIMIT 1"


@query("session_detail", f"SELECT s.visit_id, s.raw_url, s.title, s.domain, s.ms, s.search, s.engine, t.trail_id, s.transition FROM s LEFT JOIN (SELECT visit_id, trail_id FROM tm) t USING (visit_id) WHERE s.session_id = ({_LONGEST})", h.TRAILS_SQL)
def session_detail(spark: S, d: str) -> DataFrame:
    """The visits of the session with most of them."""
    rows = h._sessions(spark, d)
    longest = rows.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return explain.session_detail(rows, h._members(spark, d), longest.session_id if longest else "")


@query("trail_detail", "SELECT visit_id, ordinal, CASE WHEN ordinal = 0 THEN 'search_event' WHEN ordinal = 1 THEN 'landing' ELSE 'click' END AS role, raw_url, url, title, domain, ms, search FROM tm WHERE trail_id = (SELECT trail_id FROM tr ORDER BY visits DESC, trail_id LIMIT 1)", h.TRAILS_SQL)
def trail_detail(spark: S, d: str) -> DataFrame:
    longest = h._trails(spark, d).orderBy(F.desc("visits"), "trail_id").first()
    return explain.trail_detail(h._members(spark, d), longest.trail_id if longest else "")


@query("refind_detail", """SELECT x.profile_id, array_to_string(x.days, ',') AS recent_days, array_to_string(y.trails[1:8], ',') AS related_trails FROM
  (SELECT r.profile_id, list_sort(list_distinct(list(v.date_key)), 'DESC') AS days FROM ri r JOIN v USING (visit_id) GROUP BY ALL) x LEFT JOIN
  (SELECT profile_id, list(trail_id ORDER BY last_ms DESC, trail_id DESC) AS trails FROM (SELECT DISTINCT r.profile_id, tm.trail_id, tr.last_ms FROM ri r JOIN tm USING (visit_id) JOIN tr ON tr.trail_id = tm.trail_id) GROUP BY profile_id) y USING (profile_id)""",
       h.REFIND_SQL + ", best AS (SELECT url FROM rp ORDER BY score DESC, url LIMIT 1), ri AS (SELECT profile_id, unnest(evidence) AS visit_id FROM rp WHERE url = (SELECT url FROM best))")
def refind_detail(spark: S, d: str) -> DataFrame:
    r = h._refinds(spark, d)
    best = r.orderBy(F.desc("score"), "url").first()
    out = explain.refind_detail(r, visits(spark, d), h._members(spark, d), h._trails(spark, d), best.url if best else "")
    return out.select("profile_id", F.array_join("recent_days", ",").alias("recent_days"), F.array_join("related_trails", ",").alias("related_trails"))


@query("sessions_page", f"SELECT session_id, first_ms, visits FROM (SELECT session_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS visits FROM s GROUP BY session_id) WHERE {h._OVER} ORDER BY first_ms DESC, session_id DESC LIMIT 50 OFFSET 50", h.SESSIONS_SQL)
def sessions_page(spark: S, d: str) -> DataFrame:
    rows = facts.overlapping(structure.sessions(h._sessions(spark, d)), *h.RANGE)
    return rows.orderBy(F.desc("first_ms"), F.desc("session_id")).offset(50).limit(50).select("session_id", "first_ms", "visits")


@query("search_queries_context", """SELECT visit_id, engine, normalized_query, exact_repeats, trail_id, landing_domain FROM (SELECT et.*, tr.landing_domain, count(*) OVER (PARTITION BY et.engine, normalized_query) AS exact_repeats,
  row_number() OVER (PARTITION BY et.engine, normalized_query ORDER BY et.ms DESC, visit_id DESC) AS r FROM et JOIN tr USING (trail_id) WHERE query_kind = 'keyword') WHERE r = 1 ORDER BY exact_repeats DESC, visit_id DESC LIMIT 40""", h.EVENTS_SQL)
def search_queries_context(spark: S, d: str) -> DataFrame:
    """Keyword queries once each, the newest, the most repeated first, with the trail that each opened."""
    e = h._events(spark, d).where("query_kind = 'keyword'")
    g = e.groupBy("engine", "normalized_query").agg(F.max_by(F.struct("visit_id", "trail_id"), F.struct("ms", "visit_id")).alias("n"), F.count("*").alias("exact_repeats")).select("engine", "normalized_query", "n.*", "exact_repeats")
    top = g.orderBy(F.desc("exact_repeats"), F.desc("visit_id")).limit(40)
    return top.join(h._trails(spark, d).select("trail_id", "landing_domain"), "trail_id").select("visit_id", "engine", "normalized_query", "exact_repeats", "trail_id", "landing_domain")


@query("domain_paths", "SELECT path, count(*) AS visits FROM (SELECT CASE WHEN regexp_extract(raw_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(raw_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM v WHERE domain = 'github.com') GROUP BY path ORDER BY visits DESC, path LIMIT 10")
def domain_paths(spark: S, d: str) -> DataFrame:
    """The paths of a domain that are visited most."""
    from wayfold.functions import urls

    g = visits(spark, d).where("domain = 'github.com'").groupBy(urls.path(F.col("raw_url")).alias("path")).agg(F.count("*").alias("visits"))
    return g.orderBy(F.desc("visits"), "path").limit(10)


_FIRST = h.REOPENED_SQL + "," + h.DOMAINS_SQL[len(VISITS_SQL) + 1 :] + f""", ds AS (SELECT session_id, min(ms) AS first_ms FROM s GROUP BY profile_id, session_id HAVING count(from_visit) >= 4 AND count(DISTINCT domain) >= 5 AND count(*) >= 8 AND sum(is_new_domain) >= 1),
hb AS ({h.HABITS_RAW}),
ov AS (SELECT 'digest_summary' AS section, kpi AS entity, value::DOUBLE AS value, 5 AS most FROM ({h._PART(h._IN, *h._SPANS["now"])})
  UNION ALL SELECT 'on_this_day', date_key || ' ' || domain, visits::DOUBLE, 10 FROM (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY visits DESC, domain) AS r FROM (SELECT date_key, domain, count(*) AS visits FROM v WHERE substr(date_key, 6) = '01-20' AND date_key < '2025-01-20' GROUP BY ALL)) WHERE r <= 3
  UNION ALL SELECT 'top_sites', domain, sum(visits)::DOUBLE, 40 FROM d WHERE {h.IN_RANGE} GROUP BY domain
  UNION ALL SELECT 'refind_pages', profile_id || ' ' || url, score::DOUBLE, 5 FROM rp WHERE {h._OVER}
  UNION ALL SELECT 'search_engine_ranking', engine, count(*)::DOUBLE, 100 FROM v WHERE engine IS NOT NULL AND {h.IN_RANGE} GROUP BY engine
  UNION ALL SELECT 'search_concepts', term, count(*)::DOUBLE, 50 FROM (SELECT unnest(terms) AS term FROM et WHERE ms >= {h._SPANS["now"][0]} AND ms < {h._SPANS["now"][1]}) GROUP BY term
  UNION ALL SELECT 'query_families', family_id, members::DOUBLE, 10 FROM ff WHERE {h._OVER}
  UNION ALL SELECT 'activity_mix', category, round(sum(visits) / sum(sum(visits)) OVER (), 6), 100 FROM d WHERE {h.IN_RANGE} GROUP BY category
  UNION ALL SELECT 'discovery_trend_day', date_key, round(sum(new_domain_visits) / sum(visits), 6), 400 FROM d WHERE {h.IN_RANGE} GROUP BY date_key
  UNION ALL SELECT 'habit_patterns', profile_id || ' ' || domain, days::DOUBLE, 100 FROM hb UNION ALL SELECT 'interrupted_habits', profile_id || ' ' || domain, days::DOUBLE, 100 FROM hb WHERE interrupted)"""
_SECOND = h.REOPENED_SQL + h._EFFECT + "," + h.DOMAINS_SQL[len(VISITS_SQL) + 1 :] + f""", fl AS ({h.flows_sql(3)}),{h._COMPARE[len(h.TRAILS_SQL) + 1 :]},
ov AS (SELECT 'stable_sources' AS section, domain || ' ' || profile_id AS entity, score::DOUBLE AS value, 10 AS most FROM sc WHERE {h._OVER}
  UNION ALL SELECT 'search_effectiveness', engine, count(*)::DOUBLE, 100 FROM tr WHERE {h._OVER} GROUP BY engine
  UNION ALL SELECT 'friction_signals', trail_id, greatest(visits, reformulations)::DOUBLE, 10 FROM tr WHERE {h._OVER} AND (reformulations >= 2 OR (landing_domain IS NULL AND visits >= 3))
  UNION ALL SELECT 'reopened_investigations', investigation_id, (last_ms // 1000)::DOUBLE, 10 FROM ro WHERE {h._OVER}
  UNION ALL SELECT 'discovery_trend_week', isoyear(date_key::DATE) || '-W' || lpad(week(date_key::DATE)::VARCHAR, 2, '0'), round(sum(new_domain_visits) / sum(visits), 6), 400 FROM d WHERE {h.IN_RANGE} GROUP BY 2
  UNION ALL SELECT 'breadth_index', 'breadth', round((1 - sum(n * n) / (sum(n) * sum(n))) * 100, 6), 1 FROM (SELECT count(*) AS n FROM v WHERE {h.IN_RANGE} GROUP BY domain)
  UNION ALL SELECT 'path_flows', profile_id || ' ' || pattern, occurrences::DOUBLE, 10 FROM fl WHERE last_ms >= {h._SPANS["now"][0]} AND last_ms < {h._SPANS["now"][1]}
  UNION ALL SELECT 'compare_sets', compare_set_id, alternations::DOUBLE, 10 FROM cs
  UNION ALL SELECT 'multi_browser_diff', profile_id, count(DISTINCT domain)::DOUBLE, 100 FROM d WHERE {h.IN_RANGE} GROUP BY profile_id)"""
_RANKED = "SELECT section, r AS rank, entity, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, entity) - 1 AS r FROM ov) WHERE r < most"


def _snapshot(spark: S, d: str, name: str, sections: Callable[[], dict[str, DataFrame]]) -> DataFrame:
    """An overview that is stored for what the events hold, and built again only for others."""
    return once(spark, name, [f"{d}/events.parquet"], lambda: outputs.overview(sections()).withColumn("value", F.round("value", 6)).coalesce(1))


@query("overview", _RANKED, _FIRST)
def overview(spark: S, d: str) -> DataFrame:
    """The eleven sections of the first overview of the range."""
    name = lambda *c: F.concat_ws(" ", *c).alias("entity")

    def sections() -> dict[str, DataFrame]:
        habit = structure.habits(visits(spark, d), h._ms(h.TODAY))
        within = h._domains(spark, d).where(h.IN_RANGE)
        events = h._events(spark, d).where((F.col("ms") >= h._SPANS["now"][0]) & (F.col("ms") < h._SPANS["now"][1]))
        return {
            "digest_summary": h.digest_kpis(spark, d).select(F.col("kpi").alias("entity"), F.col("now").alias("value")),
            "on_this_day": h.on_this_day(spark, d).select(name("date_key", "domain"), F.col("visits").alias("value")),
            "top_sites": within.groupBy(F.col("domain").alias("entity")).agg(F.sum("visits").alias("value")),
            "refind_pages": facts.overlapping(h._refinds(spark, d), *h.RANGE).select(name("profile_id", "url"), F.col("score").alias("value")),
            "search_engine_ranking": visits(spark, d).where(h.IN_RANGE).where("engine IS NOT NULL").groupBy(F.col("engine").alias("entity")).agg(F.count("*").alias("value")),
            "search_concepts": events.select(F.explode("terms").alias("entity")).groupBy("entity").agg(F.count("*").alias("value")),
            "query_families": facts.overlapping(families.family_rows(h._families(spark, d)), *h.RANGE).select(F.col("family_id").alias("entity"), F.col("members").alias("value")),
            "activity_mix": h.activity_mix(spark, d).select(F.col("category").alias("entity"), F.col("share").alias("value")),
            "discovery_trend_day": within.groupBy(F.col("date_key").alias("entity")).agg((F.sum("new_domain_visits") / F.sum("visits")).alias("value")),
            "habit_patterns": habit.select(name("profile_id", "domain"), F.col("days").alias("value")),
            "interrupted_habits": habit.where("interrupted").select(name("profile_id", "domain"), F.col("days").alias("value")),
        }

    return _snapshot(spark, d, "overview", sections)


@query("overview_more", _RANKED, _SECOND)
def overview_more(spark: S, d: str) -> DataFrame:
    """The sections of the second overview of the range that come from visits."""
    name = lambda *c: F.concat_ws(" ", *c).alias("entity")

    def sections() -> dict[str, DataFrame]:
        within = h._domains(spark, d).where(h.IN_RANGE)
        trails = facts.overlapping(h._trails(spark, d), *h.RANGE)
        start, end = h._SPANS["now"]
        flows = structure.path_flows(h._sessions(spark, d), 3).where((F.col("last_ms") >= start) & (F.col("last_ms") < end))
        return {
            "stable_sources": facts.overlapping(h.source_effectiveness(spark, d), *h.RANGE).select(name("domain", "profile_id"), F.col("score").alias("value")),
            "search_effectiveness": trails.groupBy(F.col("engine").alias("entity")).agg(F.count("*").alias("value")),
            "friction_signals": structure.friction(trails).select(F.col("trail_id").alias("entity"), F.col("occurrences").alias("value")),
            "reopened_investigations": facts.overlapping(h._reopened(spark, d), *h.RANGE).select(F.col("investigation_id").alias("entity"), F.floor(F.col("last_ms") / 1000).alias("value")),
            "discovery_trend_week": within.groupBy(facts.period(F.col("date_key"), "week").alias("entity")).agg((F.sum("new_domain_visits") / F.sum("visits")).alias("value")),
            "breadth_index": h.breadth_index(spark, d).select(F.lit("breadth").alias("entity"), F.col("breadth").alias("value")),
            "path_flows": flows.select(name("profile_id", "pattern"), F.col("occurrences").alias("value")),
            "compare_sets": h.compare_sets(spark, d).select(F.col("compare_set_id").alias("entity"), F.col("alternations").alias("value")),
            "multi_browser_diff": h.browser_profiles(spark, d).select(F.col("profile_id").alias("entity"), F.col("domains").alias("value")),
        }

    return _snapshot(spark, d, "overview-more", sections)


@query("public_snapshot", """SELECT 'domain' AS kind, domain AS label, visits::DOUBLE AS value FROM (SELECT domain, sum(visits) AS visits FROM d GROUP BY domain ORDER BY visits DESC, domain LIMIT 5) UNION ALL SELECT 'engine', engine, count(*)::DOUBLE FROM v WHERE engine IS NOT NULL GROUP BY engine
  UNION ALL SELECT 'discovery', isoyear(date_key::DATE) || '-W' || lpad(week(date_key::DATE)::VARCHAR, 2, '0'), round(sum(new_domain_visits) / sum(visits), 6)::DOUBLE FROM d GROUP BY 2""", h.DOMAINS_SQL)
def public_snapshot(spark: S, d: str) -> DataFrame:
    rows = h._domains(spark, d)
    weekly = rows.groupBy(facts.period(F.col("date_key"), "week").alias("period")).agg(F.round(F.sum("new_domain_visits") / F.sum("visits"), 6).alias("rate"))
    return outputs.public_snapshot(rows.groupBy("domain").agg(F.sum("visits").alias("visits")), h.engine_ranking(spark, d), weekly)


@query("embed_cards", "SELECT * FROM (SELECT 'visits' AS card, 'all' AS label, count(*)::DOUBLE AS value FROM v UNION ALL SELECT 'top_site', arg_min(domain, (-n, domain)), max(n)::DOUBLE FROM (SELECT domain, count(*) AS n FROM v GROUP BY domain) UNION ALL SELECT 'searches', 'all', count(search)::DOUBLE FROM v)")
def embed_cards(spark: S, d: str) -> DataFrame:
    v = visits(spark, d)
    sites_ = v.groupBy("domain").agg(F.count("*").alias("n"))
    return outputs.cards({
        "visits": v.agg(F.lit("all").alias("label"), F.count("*").alias("value")),
        "top_site": sites_.agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("label"), F.max("n").alias("value")),
        "searches": v.agg(F.lit("all").alias("label"), F.count("search").alias("value")),
    })


# --- ingest ---

@query("orphan_skip", "SELECT profile_id, count(*) AS skipped FROM av0 WHERE url_id % 9 = 0 GROUP BY profile_id")
def orphan_skip(spark: S, d: str) -> DataFrame:
    a = archive(spark, d)
    return derive.orphans(a["visits"], a["urls"].where("url_id % 9 <> 0"))


@query("download_dedup", "SELECT profile_id, source_id, min(visit_id) AS arrival FROM (SELECT *, visit_id % 700 AS source_id FROM av0) WHERE visit_id >= 900 AND (profile_id, source_id) NOT IN (SELECT (profile_id, visit_id % 700) FROM av0 WHERE visit_id < 900) GROUP BY ALL")
def download_dedup(spark: S, d: str) -> DataFrame:
    rows = archive(spark, d)["visits"].select("profile_id", (F.col("visit_id") % 700).alias("source_id"), F.col("visit_id").alias("arrival"))
    return ingest.insert_new(rows.where("arrival < 900"), rows.where("arrival >= 900"), ["profile_id", "source_id"])


@query("favicon_blob_dedup", "SELECT sha256(url) AS blob_hash, count(DISTINCT url) AS images FROM aurls WHERE url_id % 5 <> 0 AND url NOT IN (SELECT url FROM aurls WHERE url_id % 5 = 0) GROUP BY url")
def favicon_blob_dedup(spark: S, d: str) -> DataFrame:
    u = archive(spark, d)["urls"]
    old = u.where("url_id % 5 = 0").select(F.sha2("url", 256).alias("blob_hash")).distinct()
    fresh = ingest.favicon_blobs(old, u.where("url_id % 5 <> 0").select(F.col("url").cast("binary").alias("image")))
    return fresh.groupBy("blob_hash").agg(F.count("*").alias("images"))


@query("watermarks_all", "SELECT profile_id, max(visit_id) AS visit_id, max(ms) AS url_ms, max(url_id) AS download_id, max(CASE WHEN visit_id % 2 = 0 THEN ms ELSE 0 END) AS favicon_ms FROM av0 GROUP BY profile_id")
def watermarks_all(spark: S, d: str) -> DataFrame:
    rows = archive(spark, d)["visits"].select("profile_id", "visit_id", F.col("ms").alias("url_ms"), F.col("url_id").alias("download_id"), F.when(F.col("visit_id") % 2 == 0, F.col("ms")).alias("favicon_ms"))
    return ingest.save_watermarks(rows.where("visit_id < 400"), rows.where("visit_id >= 400"))


@query("batch_review", "SELECT batch_id, count(*) AS visits, count(DISTINCT (profile_id, url_id)) AS urls, min(ms) AS first_ms, max(ms) AS last_ms, batch_id = 3 AS is_reverted FROM av0 GROUP BY batch_id")
def batch_review(spark: S, d: str) -> DataFrame:
    a = archive(spark, d)
    return ingest.batch_review(a["visits"], a["reverted"])


@query("integrity", """SELECT 'visit-without-url' AS "check", count(*) AS n FROM av0 WHERE url_id % 9 = 0 UNION ALL SELECT 'url-without-visit', count(*) FROM aurls WHERE url_id % 9 > 0 AND (profile_id, url_id) NOT IN (SELECT (profile_id, url_id) FROM av0 WHERE visit_id % 10 <> 4)
  UNION ALL SELECT 'stale-derived-row', count(*) FROM av0 WHERE visit_id % 10 = 4""".replace("FROM av0 WHERE url_id % 9 = 0", "FROM av0 WHERE url_id % 9 = 0 AND visit_id % 10 <> 4"))
def integrity(spark: S, d: str) -> DataFrame:
    a = archive(spark, d)
    return ingest.integrity(a["visits"].where("visit_id % 10 <> 4"), a["urls"].where("url_id % 9 <> 0"), a["visits"])


# --- incremental ---

@query("rollup_incremental", "SELECT * FROM d", h.DOMAINS_SQL)
def rollup_incremental(spark: S, d: str) -> DataFrame:
    """The domain rollup of all but the last days, brought up to date from the days that changed: equal to a full rebuild."""
    rows = visits(spark, d)
    old = facts.domain_rollup(rows.where("date_key < '2024-01-25' AND visit_id % 10 <> 5"))
    dirty = rows.where("date_key >= '2024-01-25' OR visit_id % 10 = 5").select("date_key").distinct()
    return facts.refresh_days(old, rows, dirty)


@query("index_candidates", "SELECT url, sha256('dedup/v1' || chr(10) || 'canonical=' || url || chr(10) || 'title=' || coalesce(title, '') || chr(10) || 'enrichment=') AS hash FROM (SELECT url, max(title) AS title, max(visit_id) AS seen FROM v GROUP BY url) WHERE seen > 5000 OR seen % 2 = 1")
def index_candidates(spark: S, d: str) -> DataFrame:
    """Pages visited after the watermark or whose stored content key is another one."""
    pages = visits(spark, d).groupBy("url").agg(F.max("title").alias("title"), F.max("visit_id").alias("seen"))
    pages = pages.withColumn("hash", text.content_hash(F.col("url"), F.col("title"), F.lit(None).cast("string")))
    stored = pages.select("url", F.when(F.col("seen") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return vectors.index_candidates(pages, stored, 5000).select("url", "hash")


# --- pages and their images ---

_UN = lambda x: "replace(replace(replace(replace(replace(replace(" + x + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_TEXT = _UN(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), 'x^', '')")


@query("page_summaries", rf"""SELECT page_id, nullif(trim(regexp_replace({_UN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')), '') AS title, length(flat) AS chars, CASE WHEN length(flat) <= 280 THEN nullif(flat, '') ELSE rtrim(flat[1:280]) || '…' END AS summary
  FROM (SELECT *, trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')) AS flat FROM pages)""")
def page_summaries(spark: S, d: str) -> DataFrame:
    """Title, length of the text and summary of every page."""
    html = F.col("html")
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", pages.title(html).alias("title"), F.char_length(pages.plain_text(html)).cast("long").alias("chars"), pages.summary(html).alias("summary"))


_IM = VISITS_SQL + ", im AS (SELECT url AS page_url, 'b' || (min(url_id) % 300) AS blob_hash, 100 + min(url_id) % 300 AS bytes, min(first_ms) AS fetched_ms, max(last_ms) AS shown_ms FROM aurls GROUP BY url)"


def _images(spark: S, d: str) -> DataFrame:
    g = archive(spark, d)["urls"].groupBy(F.col("url").alias("page_url")).agg(F.min("url_id").alias("u"), F.min("first_ms").alias("fetched_ms"), F.max("last_ms").alias("shown_ms"))
    return g.select("page_url", F.concat(F.lit("b"), (F.col("u") % 300).cast("string")).alias("blob_hash"), (100 + F.col("u") % 300).alias("bytes"), "fetched_ms", "shown_ms")


@query("image_stats", "SELECT sum(n)::BIGINT AS pages, count(*) AS blobs, sum(bytes)::BIGINT AS bytes FROM (SELECT blob_hash, max(bytes) AS bytes, count(*) AS n FROM im GROUP BY blob_hash)", _IM)
def image_stats(spark: S, d: str) -> DataFrame:
    return images.stats(_images(spark, d))


@query("image_evict", """SELECT page_url, blob_hash, frees FROM (SELECT *, coalesce(sum(frees) OVER (ORDER BY shown_ms, page_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(frees) OVER () - 20000 AS excess FROM
  (SELECT *, CASE WHEN row_number() OVER (PARTITION BY blob_hash ORDER BY shown_ms DESC, page_url DESC) = 1 THEN bytes ELSE 0 END AS frees FROM im)) WHERE freed < excess""", _IM)
def image_evict(spark: S, d: str) -> DataFrame:
    return images.evict(_images(spark, d), 20000)


@query("image_due", "SELECT url, max(last_ms) AS last_ms FROM aurls WHERE starts_with(url, 'https://') AND url NOT IN (SELECT page_url FROM im WHERE fetched_ms > 1706500000000 - 20 * 86400000) GROUP BY url ORDER BY last_ms DESC, url LIMIT 100", _IM)
def image_due(spark: S, d: str) -> DataFrame:
    return images.due(archive(spark, d)["urls"], _images(spark, d), 1706500000000, 20, 100)
