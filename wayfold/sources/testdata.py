"""An archive made from the event table, and the visit facts that follow from it, for queries over the synthetic test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import sites, taxonomy, text, urls
from wayfold.operators import archive as derive
from wayfold.operators import facts
from wayfold.store import once

#: URLs and titles that events are mapped to; {a} {b} {n} are small numbers of the event.
TEMPLATES = (
    "https://www.google.com/search?q=Topic+{a}+guide&utm_source=x", "https://www.bing.com/search?q=topic%20{a}%20review&form=z{b}", "https://duckduckgo.com/?q=site{a}.example.com",
    "https://github.com/org{b}/repo{a}/issues/{n}", "https://github.com/org{b}/repo{a}", "https://gitlab.com/g{b}/p{a}/merge_requests/{n}", "https://docs.site{a}.example.org/guide/page{n}?ref=nav",
    "https://www.reddit.com/r/x{b}/comments/{n}/topic", "https://stackoverflow.com/questions/{n}/how-to-topic-{a}", "https://www.youtube.com/watch?v=v{n}",
    "https://www.youtube.com/results?search_query=topic+{a}+video", "https://chat.deepseek.com/c/{n}", "https://www.bilibili.com/video/{n}", "https://item.taobao.com/item/{n}",
    "https://www.amazon.com/dp/{n}?ref=x", "https://www.amazon.co.uk/dp/{n}", "https://www.cnn.com/2024/article/{n}", "https://news{a}.example.com.au/world/{n}.html", "https://blog{a}.example.net/",
    "https://shop.example.com/compare/{n}", "https://x.com/user{b}", "https://searx.local{b}.net/search?q=topic+{a}", "https://juejin.cn/post/article/{n}", "https://intranet/wiki?id={n}",
)
TITLES = ("Topic {a} guide", None, "Comparing plans {a}", "Daily news {n}", "", "Forum {b}", "What to do")
REVERTED = (3,)


def _filled(texts: tuple, k: Column, a: Column, b: Column, n: Column) -> Column:
    out = F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]), (k % len(texts) + 1).cast("int"))
    for name, value in (("{a}", a), ("{b}", b), ("{n}", n)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """profiles, urls, visits, search_terms and reverted batches. A profile is an event type; every tenth batch is reverted."""
    e, u = F.col("event_id"), F.col("user_id")
    k, a, b, n = (e * 31 + u) % len(TEMPLATES), u % 9, u % 5, e % 40
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("visit_id"), F.col("event_type").alias("profile_id"), (((k * 9 + a) * 5 + b) * 40 + n).alias("url_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"), F.when(e % 3 == 1, e - 1).alias("from_visit"),
        F.when(e % 11 == 0, "https://ref.example.com/").alias("referrer"), F.when(e % 3 == 0, 1).otherwise(0).cast("long").alias("transition"), (e % 10).alias("batch_id"), F.col("value").alias("duration"), k.alias("k"), a.alias("a"), b.alias("b"), n.alias("n"),
    )
    numbers = ("k", "a", "b", "n")
    # texts are filled once a URL; an aggregate of numbers alone is hashed, where one with texts would sort all visits
    url_rows = rows.groupBy("profile_id", "url_id").agg(
        F.count("*").alias("visit_count"), F.sum("transition").alias("typed_count"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), *[F.first(c).alias(c) for c in numbers]
    )
    filled = [_filled(t, *map(F.col, numbers)).alias(c) for t, c in ((TEMPLATES, "url"), (TITLES, "title"))]
    url_rows = url_rows.select("profile_id", "url_id", *filled, "visit_count", "typed_count", "first_ms", "last_ms", *numbers)
    searched = url_rows.where("k < 2 AND n % 2 = 0")
    terms = searched.select("profile_id", "url_id", F.explode(F.array(F.concat(F.lit("topic "), F.col("a").cast("string"), F.lit(" tips")), F.concat(F.lit("zz "), F.col("n").cast("string")))).alias("term"))
    return {
        "profiles": rows.select("profile_id").distinct().withColumn("browser", F.when(F.col("profile_id") < "m", "chrome").otherwise("firefox")),
        "urls": url_rows.drop(*numbers), "visits": rows.drop(*numbers), "search_terms": terms, "reverted": spark.range(0).select(F.col("id").alias("batch_id")).unionAll(spark.createDataFrame([(b,) for b in REVERTED], "batch_id long")),
    }


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the archive's visible visits, with date_key and is_new_domain: derived once a session, stored by day."""
    return once(spark, "facts", [f"{sf_dir}/events.parquet"], lambda: facts.with_new_domains(derive.derive(archive(spark, sf_dir))), ["date_key"])


# --- the same in DuckDB SQL ---

def _sql_fill(texts: tuple) -> str:
    listed = ", ".join("NULL" if t is None else f"'{t}'" for t in texts)
    return f"replace(replace(replace(list_extract([{listed}], (k % {len(texts)} + 1)::INT), '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR), '{{n}}', n::VARCHAR)"


def _under(x: str, suffix: str) -> str:
    return f"({x} = '{suffix}' OR ends_with({x}, '.{suffix}'))"


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def _rule_sql(r: taxonomy.Rule) -> str:
    parts = [_or([_under("host", h) for h in r.hosts])] if r.hosts else []
    parts += [_or([f"starts_with(lower(path), '{p}')" for p in r.starts])] if r.starts else []
    parts += [_or([f"contains(lower(path), '{p}')" for p in r.contains])] if r.contains else []
    parts += [f"len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= {r.segments}"] if r.segments else []
    parts += [f"list_contains(list_transform(ps, lambda p: lower(p.k)), '{r.query_key}')"] if r.query_key else []
    return " AND ".join(parts)


_CASES = [f"WHEN domain = '{r.hosts[0]}' THEN '{r.name}'" for r in taxonomy.EXACT_RULES] + [f"WHEN host <> '' AND {_rule_sql(r)} THEN '{r.name}'" for r in taxonomy.PATH_RULES]
_CASES += [f"WHEN {_or([chr(99) + 'ontains(said, ' + repr(w) + ')' for w in r.words])} THEN '{r.name}'" for r in taxonomy.WORD_RULES]
_RULES = ", ".join(
    f"('{r.name}', '{r.category}', '{r.page}', '{r.interaction}', '{s}', '{r.pack}')"
    for s, rs in (("exact-domain-rule", taxonomy.EXACT_RULES), ("host-path-rule", taxonomy.PATH_RULES), ("lexicon-rule", taxonomy.WORD_RULES)) for r in rs
)
_ENGINE = "CASE " + " ".join(
    f"WHEN ({_under('host', r.host)} OR {_under('domain', r.host)})" + (f" AND starts_with(path, '{r.prefix}')" if r.prefix else "") + f" THEN {i}" for i, r in enumerate(sites.SEARCH_RULES)
) + " END"
_RULE_ROWS = ", ".join(f"({i}, '{r.engine}', '{r.name}', '{r.key}')" for i, r in enumerate(sites.SEARCH_RULES))
_MAP = lambda names: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ENC = lambda x: f"replace(url_encode({x}), '%20', '+')"

#: Columns host, domain, path, query, fragment, ps (parameters that don't track) of a table's url.
URL_COLUMNS_SQL = rf"""h0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qs, regexp_extract(url, '#(.*)$', 1) AS fragment FROM given),
  h1 AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path, string_split(host, '.') AS labels,
    list_filter(list_transform(list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')),
      'v': trim(regexp_replace(replace(url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')), '+', ' '), '\s+', ' ', 'g'))}}), lambda p: true) AS all_ps FROM h0),
  h2 AS (SELECT *, CASE WHEN array_to_string(labels[-2:], '.') IN {_LIST(urls.LONG_SUFFIXES)} THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
    list_filter(all_ps, lambda p: NOT (starts_with(lower(p.k), 'utm_') OR lower(p.k) IN {_LIST(urls.TRACKING)})) AS ps FROM h1),
  h3 AS (SELECT *, CASE WHEN domain IN {_LIST(urls.SEARCH_DOMAINS)} OR starts_with(host, 'www.google.') THEN list_filter(ps, lambda p: lower(p.k) IN {_LIST(urls.SEARCH_KEYS)} AND p.v <> '')[1].v END AS url_query,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_transform(ps, lambda p: {_ENC("p.k")} || '=' || {_ENC("p.v")}), '&') ELSE '' END
      || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS canonical FROM h2)"""
#: Archive tables aprofiles, aurls, avisits, aterms, and facts of visible visits as ``v``.
ARCHIVE_SQL = f"""e0 AS (SELECT event_id AS visit_id, event_type AS profile_id, (event_id * 31 + user_id) % {len(TEMPLATES)} AS k, user_id % 9 AS a, user_id % 5 AS b, event_id % 40 AS n, epoch_us(ts) // 1000 AS ms, ts, value FROM events),
  av0 AS (SELECT visit_id, profile_id, ((k * 9 + a) * 5 + b) * 40 + n AS url_id, {_sql_fill(TEMPLATES)} AS url, {_sql_fill(TITLES)} AS title, ms, ts, CASE WHEN visit_id % 3 = 1 THEN visit_id - 1 END AS from_visit,
    CASE WHEN visit_id % 11 = 0 THEN 'https://ref.example.com/' END AS referrer, (visit_id % 3 = 0)::BIGINT AS transition, visit_id % 10 AS batch_id, value AS duration, k, a, n FROM e0),
  aurls AS (SELECT profile_id, url_id, any_value(url) AS url, max(title) AS title, count(*) AS visit_count, sum(transition)::BIGINT AS typed_count, min(ms) AS first_ms, max(ms) AS last_ms, any_value(k) AS k, any_value(a) AS a, any_value(n) AS n FROM av0 GROUP BY profile_id, url_id),
  aterms AS (SELECT profile_id, url_id, unnest(['topic ' || a || ' tips', 'zz ' || n]) AS term FROM aurls WHERE k < 2 AND n % 2 = 0),
  avisits AS (SELECT * FROM av0 WHERE batch_id NOT IN ({", ".join(map(str, REVERTED))}))"""
VISITS_SQL = rf"""{ARCHIVE_SQL},
  given AS (SELECT u.*, t.term FROM aurls u LEFT JOIN (SELECT profile_id, url_id, min(term) AS term FROM aterms GROUP BY ALL) t USING (profile_id, url_id)),
  {URL_COLUMNS_SQL},
  c0 AS (SELECT *, {_ENGINE} AS hit, lower(concat_ws(' ', coalesce(title, ''), coalesce(term, ''), coalesce(url_query, ''))) AS said FROM h3),
  c1 AS (SELECT c0.*, CASE {" ".join(_CASES)} END AS rule, r.engine AS rule_engine, r.name AS rule_name, list_filter(all_ps, lambda p: lower(p.k) = r.key)[1].v AS rule_value FROM c0 LEFT JOIN (VALUES {_RULE_ROWS}) r(hit, engine, name, key) ON c0.hit = r.hit),
  c2 AS (SELECT *, coalesce(nullif(lower(trim(term)), ''), lower(nullif(rule_value, '')), url_query) AS query, CASE WHEN rule_value <> '' THEN rule_engine END AS ruled FROM c1),
  known AS (SELECT c2.*, coalesce(x.category, 'unknown') AS category, coalesce(x.page, 'unknown') AS page, coalesce(x.interaction, 'unknown') AS interaction, coalesce(x.source, 'unknown') AS source, x.pack,
    coalesce(ruled, CASE WHEN query IS NOT NULL AND host <> '' THEN coalesce(CASE WHEN domain = 'brave.com' AND host = 'search.brave.com' THEN 'brave' END, ({_MAP(sites.ENGINE_IDS)})[domain], CASE WHEN contains(host, 'searx') THEN 'searx' END, host) END) AS engine,
    coalesce(CASE WHEN rule_value <> '' THEN rule_name END, ({_MAP(sites.SITE_NAMES)})[domain]) AS name,
    CASE WHEN term IS NOT NULL OR url_query IS NOT NULL THEN 'tier-a' WHEN host <> '' AND (path <> '/' OR len(ps) > 0) OR len(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN {_LIST(text.TITLE_STOP_WORDS)})) > 0 THEN 'tier-b' ELSE 'tier-c' END AS url_tier
    FROM c2 LEFT JOIN (VALUES {_RULES}) x(rule, category, page, interaction, source, pack) ON c2.rule = x.rule),
  v AS (SELECT a.visit_id, a.profile_id, a.url_id, a.ms, a.from_visit, a.referrer, a.transition, a.batch_id, a.duration, k.url AS raw_url, k.canonical AS url, k.title, k.domain, k.category, k.page, k.interaction, k.source, k.pack, k.rule, k.query, k.engine, k.name,
    CASE WHEN k.engine IS NOT NULL THEN k.query END AS search, CASE WHEN a.referrer IS NOT NULL OR a.from_visit IS NOT NULL THEN 'tier-a' ELSE k.url_tier END AS tier,
    strftime(a.ts, '%Y-%m-%d') AS date_key, (row_number() OVER (PARTITION BY a.profile_id, k.domain ORDER BY a.ms, a.visit_id) = 1)::INT AS is_new_domain FROM avisits a JOIN known k USING (profile_id, url_id))"""
