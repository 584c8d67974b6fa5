"""History pages, lexical search, favicons, overlays and day views over the archive of the test data, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import sites, urls
from wayfold.operators import browse, favicons, hybrid, lexical, overlays, segments, vectors
from wayfold.sources.testdata import VISITS_SQL, archive, visits
from wayfold.store import once, shared_folder

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


def _history(spark: S, d: str) -> DataFrame:
    return browse.history(archive(spark, d))


_H = VISITS_SQL + ", hy AS (SELECT a.visit_id, a.profile_id, CASE WHEN a.profile_id < 'm' THEN 'chrome' ELSE 'firefox' END AS browser, u.url, u.title, a.ms, a.transition FROM avisits a JOIN aurls u USING (profile_id, url_id))"
PAGE = browse.Browse(browser="firefox", text="topic", start_ms=1705000000000, end_ms=1706000000000, limit=40)
_PAGE = "browser = 'firefox' AND (lower(url) LIKE '%topic%' OR lower(coalesce(title, '')) LIKE '%topic%') AND ms BETWEEN 1705000000000 AND 1706000000000"


@query("history_page", f"SELECT visit_id, profile_id, url, title, ms FROM hy WHERE {_PAGE} ORDER BY ms DESC, visit_id DESC LIMIT 40 OFFSET 40", _H)
def history_page(spark: S, d: str) -> DataFrame:
    rows = browse.matching(_history(spark, d), PAGE)
    return browse.page_of(rows, browse.Browse(limit=40, page=2)).select("visit_id", "profile_id", "url", "title", "ms")


@query("count_history", f"SELECT count(*) AS total FROM hy WHERE {_PAGE}", _H)
def count_history(spark: S, d: str) -> DataFrame:
    return browse.matching(_history(spark, d), PAGE).agg(F.count("*").alias("total"))


@query("history_envelope", f"""SELECT total, least(greatest(2, 1), pages) AS page, 40 AS page_size, pages AS page_count, true AS has_previous, 40 + shown < total AS has_next, CASE WHEN 40 + shown < total THEN last END AS next_cursor FROM
  (SELECT (SELECT count(*) FROM hy WHERE {_PAGE}) AS total, greatest(ceil((SELECT count(*) FROM hy WHERE {_PAGE}) / 40.0), 1)::BIGINT AS pages, count(*) AS shown, min_by(ms || '|' || visit_id, ms * 1000000 + visit_id) AS last
   FROM (SELECT * FROM hy WHERE {_PAGE} ORDER BY ms DESC, visit_id DESC LIMIT 40 OFFSET 40))""", _H)
def history_envelope(spark: S, d: str) -> DataFrame:
    rows = browse.matching(_history(spark, d), PAGE)
    return browse.envelope(rows, browse.Browse(limit=40, page=2))


@query("history_oldest", "SELECT visit_id, ms FROM hy WHERE (ms > 1705500000000 OR (ms = 1705500000000 AND visit_id > 7)) AND profile_id = 'view' ORDER BY ms, visit_id LIMIT 30", _H)
def history_oldest(spark: S, d: str) -> DataFrame:
    q = browse.Browse(profile="view", sort="oldest", cursor="1705500000000|7", limit=30)
    return browse.page_of(browse.matching(_history(spark, d), q), q).select("visit_id", "ms")


@query("history_regex", "SELECT visit_id, url FROM hy WHERE regexp_matches(url, '(?i)/(ISSUES|comments)/1\\d') OR regexp_matches(coalesce(title, ''), '(?i)/(ISSUES|comments)/1\\d') ORDER BY ms DESC, visit_id DESC LIMIT 150", _H)
def history_regex(spark: S, d: str) -> DataFrame:
    q = browse.Browse(regex=r"/(ISSUES|comments)/1\d")
    return browse.page_of(browse.matching(_history(spark, d), q), q).select("visit_id", "url")


# --- lexical search ---

def _overlays(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stars, notes, tags and enrichment of the archive's URLs: url_id decides."""
    u = archive(spark, d)["urls"].select("url", "url_id", "last_ms", "profile_id").groupBy("url").agg(F.min("url_id").alias("url_id"), F.max("last_ms").alias("at"))
    stars = u.where("url_id % 7 = 0").select(F.lit("url").alias("kind"), urls.normalize(F.col("url")).alias("key"), F.col("at").alias("starred_at")).groupBy("kind", "key").agg(F.max("starred_at").alias("starred_at"))
    notes = u.where("url_id % 6 = 0").select("url", F.concat(F.lit("Read later "), (F.col("url_id") % 10).cast("string")).alias("notes"), F.col("at").alias("updated_at"))
    tags = u.where("url_id % 5 = 0").select("url", F.explode(F.array(F.lit("work"), F.concat(F.lit("t"), (F.col("url_id") % 3).cast("string")))).alias("tag"), "at").select("url", "tag", F.col("at").alias("created_at"))
    rich = u.where("url_id % 4 = 0").select("url", F.lit("A short summary").alias("summary"), F.lit('{"fullName": "org/name", "topics": ["wasm", "sql"]}').alias("metadata"))
    return stars, notes, tags, rich


_OV = VISITS_SQL + """,
ou AS (SELECT url, min(url_id) AS url_id, max(last_ms) AS last_at FROM aurls GROUP BY url),
stars AS (SELECT 'url' AS kind, canonical AS key, max(last_at) AS starred_at FROM (SELECT o.url, o.last_at, any_value(k.canonical) AS canonical FROM ou o JOIN known k ON k.url = o.url WHERE o.url_id % 7 = 0 GROUP BY ALL) GROUP BY canonical),
notes AS (SELECT url, 'Read later ' || (url_id % 10) AS notes, last_at AS updated_at FROM ou WHERE url_id % 6 = 0),
tags AS (SELECT url, unnest(['work', 't' || (url_id % 3)]) AS tag, last_at AS created_at FROM ou WHERE url_id % 5 = 0),
docs AS (SELECT u.profile_id || ':' || u.url_id AS doc_id, u.url, coalesce(u.title, '') AS title, coalesce(t.terms, '') AS terms, coalesce(n.notes, '') AS notes, coalesce(g.tags, '') AS tags, CASE WHEN o.url_id % 4 = 0 THEN 'A short summary • org/name • wasm sql' ELSE '' END AS enrichment
  FROM aurls u JOIN ou o USING (url) LEFT JOIN (SELECT profile_id, url_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM aterms GROUP BY ALL) t ON t.profile_id = u.profile_id AND t.url_id = u.url_id
  LEFT JOIN notes n ON n.url = u.url LEFT JOIN (SELECT url, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM tags GROUP BY url) g ON g.url = u.url),
compacted AS (SELECT *, array_to_string(list_filter([regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g') for x in [url, title, terms, notes, tags]], lambda x: x <> ''), ' ') AS compact FROM docs)""".replace("\\\\", "\\")
_TOK = r"regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+')"
_LEX = _OV + ", tk0 AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest({_TOK.format(c)}) AS token, {w}::DOUBLE AS w, {n} AS n FROM docs" for c, w, n in (("url", 11, 2), ("title", 22, 2), ("terms", 8, 2), ("enrichment", 7, 1), ("notes", 9, 1), ("tags", 6, 1))) + r"""),
tk AS (SELECT * FROM tk0 WHERE token <> ''), sz AS (SELECT doc_id, sum(n) AS size FROM tk GROUP BY doc_id), st AS (SELECT count(*) AS nd, avg(size) AS mean FROM sz)"""


def _documents(spark: S, d: str) -> DataFrame:
    a = archive(spark, d)
    _, notes, tags, rich = _overlays(spark, d)
    return once(spark, "search-documents", [f"{d}/events.parquet"], lambda: lexical.documents(a["urls"], a["search_terms"], notes, tags, rich))


def _index(spark: S, d: str) -> lexical.Index:
    docs, of = _documents(spark, d), [f"{d}/events.parquet"]
    postings = once(spark, "postings", of, lambda: lexical.index(docs).sort("token", "doc_id"))
    grams = once(spark, "grams", of, lambda: lexical.gram_index(docs).sort("gram", "doc_id", "place"))
    counts = once(spark, "gram-counts", of, lambda: lexical.gram_counts(grams).sort("gram"))
    total = once(spark, "lexical-totals", of, lambda: spark.createDataFrame([lexical.totals(docs)], "n long, size long, windows long")).first()
    return lexical.Index(docs, postings, grams, counts, *total)


@query("search_documents", "SELECT doc_id, lower(url) AS normalized_url, lower(title) AS normalized_title, lower(terms) AS normalized_terms, compact, '' AS cjk, enrichment, notes, tags FROM compacted", _OV)
def search_documents(spark: S, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", "normalized_url", "normalized_title", "normalized_terms", "compact", "cjk", "enrichment", "notes", "tags")


def _lexical(alternatives: list[list[str]], compacts: list[str]) -> tuple[str, str]:
    """SQL of a search: CTEs, and a select of doc_id and score."""
    phrases = ", ".join(f"({i}, '{t}')" for i, a in enumerate(alternatives) for t in a)
    needs = " OR ".join(f"alt = {i} AND c = {len(a)}" for i, a in enumerate(alternatives))
    base = _LEX + f""", ph AS (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM (SELECT tk.doc_id, p.alt, p.t, sum(w) AS f, any_value(sz.size) AS size FROM tk JOIN (VALUES {phrases}) p(alt, t) ON starts_with(tk.token, p.t) JOIN sz ON sz.doc_id = tk.doc_id GROUP BY ALL)),
    lx AS (SELECT doc_id, round(min(score), 9) AS score FROM (
  SELECT doc_id, -sum(greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM ph JOIN st ON true
    WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, alt, count(*) AS c FROM ph GROUP BY ALL) WHERE {needs}) GROUP BY doc_id
  UNION ALL SELECT doc_id, -sum(greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / cmean))) + 0.35::DOUBLE FROM (SELECT *, count(*) OVER (PARTITION BY c) AS df FROM
    (SELECT doc_id, c, (length(compact) - length(replace(compact, c, ''))) / length(c) AS f, greatest(length(compact) - 2, 0) AS size FROM compacted, (VALUES {", ".join(f"('{c}')" for c in compacts)}) v(c)) WHERE f > 0) JOIN st ON true JOIN (SELECT avg(greatest(length(compact) - 2, 0)) AS cmean FROM compacted) ON true GROUP BY doc_id
  ) GROUP BY doc_id)"""
    return base, "SELECT doc_id, round(score, 6) AS score FROM lx"


_BOTH, _SELECT = _lexical([["topic", "gui"], ["wasm", "rea"]], ["topicgui", "wasmrea"])


@query("lexical_search", _SELECT, _BOTH)
def lexical_search(spark: S, d: str) -> DataFrame:
    found = lexical.search(_index(spark, d), "Topic gui OR wasm rea")
    return found.withColumn("score", F.round("score", 6))


@query("lexical_page", "SELECT a.visit_id, u.url, a.ms, round(score, 6) AS score FROM avisits a JOIN aurls u USING (profile_id, url_id) JOIN lx ON lx.doc_id = a.profile_id || ':' || a.url_id ORDER BY lx.score, a.ms DESC, a.visit_id DESC LIMIT 25 OFFSET 25", _lexical([["topic", "guide"]], ["topicguide"])[0])
def lexical_page(spark: S, d: str) -> DataFrame:
    """The second page of a search by relevance."""
    found = lexical.search(_index(spark, d), "topic guide")
    rows = _history(spark, d).withColumn("doc_id", F.concat_ws(":", "profile_id", F.col("url_id").cast("string"))).join(found, "doc_id")
    return browse.page_of(rows, browse.Browse(limit=25, page=2), lexical=True).select("visit_id", "url", "ms", F.round("score", 6).alias("score"))


_GRAMS = ["com", "omp", "mpe", "per", "eri", "rin", "ing"]
_FUZZY = _OV + f""", gh AS (SELECT doc_id, gram, count(*) AS f, any_value(size) AS size FROM (SELECT doc_id, unnest([substr(compact, i, 3) for i in range(1, length(compact) - 1)]) AS gram, greatest(length(compact) - 2, 0) AS size FROM compacted) WHERE gram IN ({", ".join(f"'{g}'" for g in _GRAMS)}) GROUP BY ALL),
near AS (SELECT doc_id, round(-sum(greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / cmean))), 9) AS near
  FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS df FROM gh), (SELECT count(*) AS nd, avg(greatest(length(compact) - 2, 0)) AS cmean FROM compacted) GROUP BY doc_id ORDER BY near, doc_id LIMIT 200),
fz AS (SELECT doc_id, any_value(near) AS near, round(min(s), 9) AS score FROM (SELECT doc_id, near, levenshtein(token, 'compering') / greatest(length(token), 9)::DOUBLE + p AS s FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+')) AS token, 0.0::DOUBLE AS p FROM compacted UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(url), '[^\\p{{L}}\\p{{N}}]+')), 0.08::DOUBLE FROM compacted
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(terms), '[^\\p{{L}}\\p{{N}}]+')), 0.12::DOUBLE FROM compacted
    UNION ALL SELECT doc_id, unnest([substr(r, i, k) for i in range(1, length(r) - k + 2)]), 0.2::DOUBLE FROM (SELECT doc_id, unnest(string_split(compact, ' ')) AS r FROM compacted), (VALUES (7), (8), (9), (10), (11)) k(k) WHERE length(r) >= k) JOIN near USING (doc_id)
    WHERE token <> '' AND levenshtein(token, 'compering') <= 2) GROUP BY doc_id)"""
#: The same over all documents, without candidates.
_FUZZY_ALL = _OV + ", fz AS (SELECT doc_id, round(min(s), 9)" + _FUZZY.split("any_value(near) AS near, round(min(s), 9)")[1].replace("SELECT doc_id, near, levenshtein", "SELECT doc_id, levenshtein").replace(" JOIN near USING (doc_id)", "")


@query("lexical_fuzzy", "SELECT doc_id, round(score, 6) AS score FROM fz", _FUZZY_ALL)
def lexical_fuzzy(spark: S, d: str) -> DataFrame:
    """All documents near a mistyped word: those within its edits."""
    found = lexical.search(_index(spark, d), "compering")
    return found.withColumn("score", F.round("score", 6))


@query("lexical_fuzzy_visits", "SELECT visit_id, round(score, 6) AS score FROM (SELECT a.visit_id, fz.score FROM avisits a JOIN fz ON fz.doc_id = a.profile_id || ':' || a.url_id ORDER BY near, a.ms DESC, a.visit_id DESC LIMIT 400)", _FUZZY)
def lexical_fuzzy_visits(spark: S, d: str) -> DataFrame:
    """Visits of the same: at most 400 are looked at."""
    rows = _history(spark, d).withColumn("doc_id", F.concat_ws(":", "profile_id", F.col("url_id").cast("string")))
    found = lexical.fuzzy_visits(lexical.fuzzy(_index(spark, d), lexical.analyze("compering"), lexical.FUZZY_URLS), rows)
    return found.select("visit_id", F.round("score", 6).alias("score"))


def _buckets(words: str) -> str:
    return f"[list_sum(list_transform(list_filter({words}, lambda w: w <> ''), lambda w: (('0x' || substr(md5(w), 1, 2))::INT % 16 = b)::INT)) FOR b IN range(16)]"


_HYBRID = _lexical([["topic", "review"]], ["topicreview"])[0] + f""", hv AS (SELECT a.visit_id, a.ms, k.canonical AS page, a.profile_id || ':' || a.url_id AS doc_id FROM avisits a JOIN known k USING (profile_id, url_id) WHERE a.profile_id IN ('view', 'click')),
  hl AS (SELECT page, min(rank) AS ra, arg_min(ms, rank) AS ma, arg_min(visit_id, rank) AS va FROM (SELECT *, row_number() OVER (ORDER BY ms DESC, visit_id DESC) - 1 AS rank FROM hv WHERE doc_id IN (SELECT doc_id FROM lx) ORDER BY ms DESC, visit_id DESC LIMIT 31) GROUP BY page),
  ht AS (SELECT page, {_buckets(_TOK.format("page"))} AS x, {_buckets(_TOK.format("'topic review guide'"))} AS q FROM (SELECT DISTINCT page FROM hv)),
  hs AS (SELECT page, row_number() OVER (ORDER BY nearness DESC, page) - 1 AS rb FROM (SELECT page, round(coalesce(list_sum(list_transform(list_zip(x, q), lambda z: coalesce(z[1], 0)::DOUBLE * coalesce(z[2], 0)::DOUBLE)) / nullif(sqrt(list_sum(list_transform(x, lambda z: coalesce(z, 0)::DOUBLE * coalesce(z, 0)::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda z: coalesce(z, 0)::DOUBLE * coalesce(z, 0)::DOUBLE))), 0), 0), 9) AS nearness FROM ht) ORDER BY nearness DESC, page LIMIT 240),
  hb AS (SELECT hs.page, rb, max(hv.ms) AS mb, arg_max(hv.visit_id, (hv.ms, hv.visit_id)) AS vb FROM hs JOIN hv ON hv.page = hs.page GROUP BY ALL),
  hf AS (SELECT page, coalesce(vb, va) AS visit_id, coalesce(mb, ma) AS ms, CASE WHEN ra IS NULL THEN 'Semantic match' WHEN rb IS NULL THEN 'Lexical match' ELSE 'Lexical + semantic match' END AS match, round(coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0), 9) AS score FROM hl FULL JOIN hb USING (page)),
  hx AS (SELECT page, visit_id, ms, match, round(score / (SELECT max(score) FROM hf) + CASE WHEN page IN (SELECT key FROM stars) THEN 0.15::DOUBLE ELSE 0 END, 6) AS score, count(*) OVER () AS total FROM hf)"""


@query("hybrid_search", "SELECT *, total > 30 AS has_more, CASE WHEN least(60, total) < total THEN least(60, total)::VARCHAR END AS next_cursor FROM hx ORDER BY score DESC, ms, page LIMIT 30 OFFSET 30", _HYBRID)
def hybrid_search(spark: S, d: str) -> DataFrame:
    """The second page of a search in two profiles: lexical matches, and pages near by the mean of their words' hashes."""
    profiles = ("view", "click")
    rows = visits(spark, d).where(F.col("profile_id").isin(*profiles)).select("visit_id", "ms", F.col("url").alias("page"), F.concat_ws(":", "profile_id", F.col("url_id").cast("string")).alias("doc_id"))
    found = lexical.search(_index(spark, d), "topic review").select("doc_id")
    near = rows.select("page").distinct().select("page", F.round(vectors.cosine(_slots(lexical.tokens(F.col("page"))), _slots(F.array(*[F.lit(w) for w in ("topic", "review", "guide")]))), 9).alias("nearness"))
    stars = _overlays(spark, d)[0].select(F.col("key").alias("page"))
    fused = hybrid.fuse(hybrid.lexical_list(rows, found, 30), hybrid.semantic_list(near, rows, 30, faceted=True), stars)
    return hybrid.page_of(fused, 30, "30")


def _slots(words: Column) -> Column:
    """How many words fall into each of sixteen slots by hash."""
    slot = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % 16)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(slot, lambda x: x == b)).cast("double"))


_CUT = 1705700000000


@query("projection_refresh", r"""SELECT c.doc_id, c.compact, sz.size::INT AS size, coalesce(w.weight, 0) AS weight, greatest(length(c.compact) - 2, 0)::BIGINT AS grams, t.n, t.tokens FROM lc c JOIN sz ON sz.doc_id = c.doc_id JOIN (SELECT doc_id, sum(w) AS weight FROM tk GROUP BY doc_id) w ON w.doc_id = c.doc_id,
  (SELECT count(*) AS n, sum(size)::BIGINT AS tokens FROM sz JOIN lc USING (doc_id)) t""", _LEX + ", lc AS (SELECT * FROM compacted WHERE doc_id IN (SELECT profile_id || ':' || url_id FROM avisits))")
def projection_refresh(spark: S, d: str) -> DataFrame:
    """The index after inserts, edits and reverts as segments, which equals one built of what is visible at the end.

    At first only pages known before a time are in it, without notes, tags and enrichment; then come later pages, then
    overlays, then pages go whose every visit was reverted; half way, segments are merged.
    """
    a = archive(spark, d)
    stars, notes, tags, rich = _overlays(spark, d)
    key, folder = ["profile_id", "url_id"], f"{shared_folder(spark)}/wayfold-lexical-{uuid.uuid4().hex}"
    doc_ids = lambda df: df.select(F.concat_ws(":", "profile_id", F.col("url_id").cast("string")).alias("doc_id"))
    segments.create(lexical.documents(a["urls"].where(F.col("first_ms") < _CUT), a["search_terms"], *[x.limit(0) for x in (notes, tags, rich)]), folder)
    late = a["urls"].where(F.col("first_ms") >= _CUT)
    segments.refresh(folder, doc_ids(late), lexical.documents(late, a["search_terms"], *[x.limit(0) for x in (notes, tags, rich)]))
    marked = a["urls"].join(notes.select("url").union(tags.select("url")).union(rich.select("url")).distinct(), "url", "left_semi")
    segments.refresh(folder, doc_ids(marked), lexical.documents(marked, a["search_terms"], notes, tags, rich))
    segments.merge(spark, folder)
    gone = a["visits"].join(a["reverted"], "batch_id", "left_semi").select(*key).distinct()
    left = a["urls"].join(gone, key, "left_semi").join(a["visits"].join(a["reverted"], "batch_id", "left_anti"), key, "left_semi")
    segments.refresh(folder, doc_ids(gone), lexical.documents(left, a["search_terms"], notes, tags, rich))
    index = segments.read(spark, folder)
    weights = index.postings.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    grams = index.grams.groupBy("doc_id").agg(F.count("*").alias("grams"))
    out = index.docs.join(weights, "doc_id", "left").join(grams, "doc_id", "left").select("doc_id", "compact", "size", "weight", F.coalesce("grams", F.lit(0)).alias("grams"))
    return out.withColumns({"n": F.lit(index.n).cast("long"), "tokens": F.lit(index.size).cast("long")})


# --- favicons ---

_ICONS = VISITS_SQL + """, icons AS (SELECT profile_id || ':' || lpad(url_id::VARCHAR, 12, '0') AS id, profile_id, url AS page_url, host AS page_host, first_ms + url_id % 5 * 86400000 AS last_updated_ms, 16 * (1 + url_id % 2) AS width, 16 * (1 + url_id % 2) AS height, CASE WHEN url_id % 13 > 0 THEN sha256(profile_id || url) END AS blob FROM known WHERE url_id % 3 = 0),
lk AS (SELECT visit_id AS id, profile_id, raw_url AS url, CASE WHEN visit_id % 500 = 0 THEN 0 ELSE ms END AS ms, string_split(string_split(raw_url, '://')[2], '/')[1] AS host FROM v WHERE visit_id % 100 = 0)"""


@query("favicon_lookup", """SELECT l.id AS lookup, t.tier, t.blob FROM lk l LEFT JOIN (SELECT id, tier, blob FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, last_updated_ms DESC, width DESC, height DESC, icon DESC) AS r FROM
  (SELECT l.id, i.id AS icon, i.last_updated_ms, i.width, i.height, i.blob, CASE WHEN i.page_url = l.url THEN CASE WHEN i.profile_id = l.profile_id THEN 0 ELSE 1 END ELSE CASE WHEN i.profile_id = l.profile_id THEN 2 ELSE 3 END END AS tier
   FROM lk l JOIN icons i ON (i.page_url = l.url OR i.page_host = l.host) AND (l.ms <= 0 OR i.last_updated_ms <= l.ms) WHERE i.blob IS NOT NULL)) WHERE r = 1) t ON t.id = l.id""", _ICONS)
def favicon_lookup(spark: S, d: str) -> DataFrame:
    """Icons of the visits whose id is divisible by 100, a stated query set, as of their times."""


    u = archive(spark, d)["urls"].where("url_id % 3 = 0")
    blob = F.when(F.col("url_id") % 13 > 0, F.sha2(F.concat("profile_id", "url"), 256))
    size = (16 * (1 + F.col("url_id") % 2)).alias("width")
    icons = u.select(F.concat_ws(":", "profile_id", F.lpad(F.col("url_id").cast("string"), 12, "0")).alias("id"), "profile_id", F.col("url").alias("page_url"), urls.host(F.col("url")).alias("page_host"), (F.col("first_ms") + F.col("url_id") % 5 * 86400000).alias("last_updated_ms"), size, size.alias("height"), blob.alias("blob"))
    asked = visits(spark, d).where("visit_id % 100 = 0").select(F.col("visit_id").alias("id"), "profile_id", F.col("raw_url").alias("url"), F.when(F.col("visit_id") % 500 == 0, 0).otherwise(F.col("ms")).alias("ms"))
    return favicons.favicons_of(asked, icons)


# --- a day, stars, notes and tags ---

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sites.DAY_ENGINES.items()) + "}"
_DAY = _H + f""", td AS (SELECT *, regexp_extract(lower(url), '://([^/?#:]*)', 1) AS host, hour(make_timestamp(ms * 1000))::INT AS hour FROM hy WHERE strftime(make_timestamp(ms * 1000), '%Y-%m-%d') = '2024-01-20'),
tq AS (SELECT *, regexp_replace(host, '^www\\.', '') AS bare, ms - lag(ms) OVER (ORDER BY ms, visit_id) AS gap, nullif(trim(replace(url_decode(regexp_extract(url, '[?&]' || ({_MAP})[regexp_replace(host, '^www\\.', '')] || '=([^&#]*)', 1)), '+', ' ')), '') AS asked FROM td),
sp AS (SELECT s, max(ms) - min(ms) AS span FROM (SELECT ms, sum((coalesce(gap, 9e15) > 1800000)::INT) OVER (ORDER BY ms, visit_id) AS s FROM tq) GROUP BY s)""".replace("\\\\", "\\")
_TOP = lambda key, most, where="true": f"(SELECT string_agg(k || '=' || n, ',' ORDER BY n DESC, k) FROM (SELECT {key} AS k, count(*) AS n FROM tq WHERE {where} GROUP BY 1 ORDER BY n DESC, k LIMIT {most}))"


@query("browse_day", f"""SELECT '2024-01-20' AS date, count(*) AS total_pages, sum((transition & 255 = 1)::INT)::BIGINT AS typed_count, sum((transition & 255 = 0)::INT)::BIGINT AS link_count,
  sum((transition & 255 IN (5, 10) OR ({_MAP})[bare] IS NOT NULL)::INT)::BIGINT AS search_count, count(DISTINCT nullif(host, '')) AS distinct_domains, min(ms) AS first_visit_ms, max(ms) AS last_visit_ms, (SELECT count(*) FROM sp) AS session_count, (SELECT max(span) FROM sp) AS longest_session_ms,
  (SELECT string_agg(hour || '=' || n, ',' ORDER BY hour) FROM (SELECT hour, count(*) AS n FROM tq GROUP BY hour)) AS hour_buckets, (SELECT hour FROM (SELECT hour, count(*) AS n FROM tq GROUP BY hour ORDER BY n DESC, hour LIMIT 1)) AS peak_hour, (SELECT max(n) FROM (SELECT count(*) AS n FROM tq GROUP BY hour)) AS hour_peak,
  {_TOP("host", 4, "host <> ''")} AS top_domains, {_TOP("url", 3)} AS top_urls, {_TOP("lower(asked)", 6, "asked IS NOT NULL")} AS top_queries FROM tq""", _DAY)
def browse_day(spark: S, d: str) -> DataFrame:
    out = browse.browse_day(_history(spark, d), "2024-01-20")
    flat = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[k].cast("string"), x["n"].cast("string"))), ",").alias(c)
    tops = [flat("hour_buckets", "hour"), *[flat(c, "key") for c in ("top_domains", "top_urls", "top_queries")]]
    return out.select(*[c for c in out.columns if c not in ("hour_buckets", "top_domains", "top_urls", "top_queries")], *tops)


@query("starred_pages", """SELECT s.kind, s.key, s.starred_at, any_value(k.domain) AS domain, coalesce(sum(k.visit_count), 0)::BIGINT AS visits FROM stars s LEFT JOIN known k ON k.canonical = s.key GROUP BY s.kind, s.key, s.starred_at ORDER BY visits DESC, s.starred_at DESC, s.key LIMIT 500""", _OV)
def starred_pages(spark: S, d: str) -> DataFrame:
    stars, *_ = _overlays(spark, d)
    return overlays.list_stars(stars, archive(spark, d)["urls"], sort="revisited").select("kind", "key", "starred_at", "domain", "visits")


@query("star_counts", "SELECT kind, count(*) AS stars FROM stars GROUP BY kind", _OV)
def star_counts(spark: S, d: str) -> DataFrame:
    return _overlays(spark, d)[0].groupBy("kind").agg(F.count("*").alias("stars"))


@query("starred_history", "SELECT visit_id FROM v WHERE url IN (SELECT key FROM stars)", _OV)
def starred_history(spark: S, d: str) -> DataFrame:
    """Visits of starred pages and domains."""


    return overlays.starred_visits(visits(spark, d), _overlays(spark, d)[0]).select("visit_id")


@query("annotations", """SELECT x.url, n.notes, g.tags, x.updated_at FROM (SELECT url, max(last_at) AS updated_at FROM (SELECT url, updated_at AS last_at FROM notes UNION SELECT url, max(created_at) FROM tags GROUP BY url) GROUP BY url) x
  LEFT JOIN notes n ON n.url = x.url LEFT JOIN (SELECT url, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY url) g ON g.url = x.url ORDER BY x.updated_at DESC, x.url LIMIT 500""", _OV)
def annotations(spark: S, d: str) -> DataFrame:
    _, notes, tags, _ = _overlays(spark, d)
    return overlays.list_annotations(notes, tags).withColumn("tags", F.when(F.size("tags") > 0, F.array_join("tags", ",")))


@query("annotation_search", "SELECT url FROM notes WHERE contains(lower(notes), 'later 4') ORDER BY updated_at DESC, url LIMIT 200", _OV)
def annotation_search(spark: S, d: str) -> DataFrame:
    return overlays.search_notes(_overlays(spark, d)[1], " Later 4 ").select("url")
