"""Search, vector, ingest and URL queries over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import sites, taxonomy, text, urls
from wayfold.operators import archive as derive
from wayfold.operators import ingest, planes, recall, suffixes, vectors
from wayfold.plans import browse
from wayfold.sources.testdata import URL_COLUMNS_SQL, VISITS_SQL, archive, visits
from wayfold.store import once

S = SparkSession
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, base: str = ""):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {base} " if base else "") + sql
        return f

    return register


def _read(spark: S, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- URLs and text ---

_PAGES = f"given AS (SELECT * FROM pages), {URL_COLUMNS_SQL}"


@query("url_normalize", "SELECT page_id, canonical, (len(all_ps) - len(ps))::INT AS dropped FROM h3", _PAGES)
def url_normalize(spark: S, d: str) -> DataFrame:
    url = F.col("url")
    return _read(spark, d, "pages").select("page_id", urls.normalize(url).alias("canonical"), F.size(urls.tracking_params(url)).alias("dropped"))


#: Rules of the query: plain ones, a wildcard with an exception, and a private one.
SUFFIX_RULES = ("com", "org", "net", "example.com", "*.example.org", "!news.example.org", "co.uk", "// a comment")


@query("registrable_by_rules", f"""SELECT page_id, host, coalesce(CASE WHEN len(string_split(listed, '.')) < len(string_split(domain, '.')) THEN domain ELSE listed END, domain) AS domain FROM (SELECT h.page_id, h.host, h.domain, array_to_string(labels[-(b.length + 1):], '.') AS listed FROM h3 h LEFT JOIN
  (SELECT host, max({{'x': x, 'length': length}}).length AS length FROM (SELECT host, len(labels) AS n, r.x, CASE WHEN r.x = 1 THEN len(string_split(r.tail, '.')) - 1 ELSE len(string_split(r.tail, '.')) + r.extra END AS length FROM (SELECT DISTINCT host, labels FROM h3),
    (SELECT regexp_replace(rule, '^(!|\\*\\.)', '') AS tail, starts_with(rule, '*.')::INT AS extra, starts_with(rule, '!')::INT AS x FROM (VALUES {", ".join(f"('{r}')" for r in SUFFIX_RULES if r[0] != "/")}) v(rule)) r WHERE host = r.tail OR ends_with(host, '.' || r.tail)) WHERE x = 1 OR length <= n GROUP BY host, n HAVING max({{'x': x, 'length': length}}).length < n) b ON b.host = h.host)""", _PAGES)
def registrable_by_rules(spark: S, d: str) -> DataFrame:
    """Registrable domains of the pages under a table of rules."""
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    hosts = _read(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return suffixes.with_domains(hosts, rules)


@query("registrable_domain", r"SELECT page_id, host, domain, CASE WHEN host = domain THEN '' ELSE substr(host, 1, length(host) - length(domain) - 1) END AS subdomain, regexp_extract(path, '^/+([^/]+)', 1) AS prefix FROM h3", _PAGES)
def registrable_domain(spark: S, d: str) -> DataFrame:
    url = F.col("url")
    host = urls.host(url)
    return _read(spark, d, "pages").select("page_id", host.alias("host"), urls.registrable_domain(host).alias("domain"), urls.subdomain(host).alias("subdomain"), urls.path_prefix(url).alias("prefix"))


@query("canonical_pages", "SELECT canonical, count(*) AS pages, min(page_id) AS first_page FROM h3 GROUP BY canonical", _PAGES)
def canonical_pages(spark: S, d: str) -> DataFrame:
    return _read(spark, d, "pages").groupBy(urls.normalize(F.col("url")).alias("canonical")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


OVERRIDES = (taxonomy.Override("domain", "cnn.com", "entertainment", "home", "watch"), taxonomy.Override("prefix", "https://github.com/org1/", "work", "repo", "resolve", display_name="Our code"), taxonomy.Override("host", "intranet", "work", engine="wiki"))


@query("taxonomy_overrides", """SELECT profile_id, url_id, CASE WHEN domain = 'cnn.com' THEN 'entertainment' WHEN starts_with(url, 'https://github.com/org1/') OR host = 'intranet' THEN 'work' ELSE category END AS category,
  CASE WHEN domain = 'cnn.com' OR starts_with(url, 'https://github.com/org1/') OR host = 'intranet' THEN 'user-override' ELSE source END AS source, CASE WHEN host = 'intranet' THEN 'wiki' ELSE engine END AS engine,
  CASE WHEN starts_with(url, 'https://github.com/org1/') THEN 'Our code' ELSE name END AS name, url_tier AS tier FROM known""", VISITS_SQL)
def taxonomy_overrides(spark: S, d: str) -> DataFrame:
    """All URLs of the archive classified by the packs and a user's own decisions."""
    a = archive(spark, d)
    known = derive.classified_urls(a["urls"], a["search_terms"], OVERRIDES)
    return known.select("profile_id", "url_id", "category", "source", "engine", "name", F.col("url_tier").alias("tier"))


@query("visit_facts", "SELECT visit_id, profile_id, date_key, ms, url, raw_url, domain, category, page, interaction, source, pack, rule, engine, search, query, name, tier, is_new_domain FROM v", VISITS_SQL)
def visit_facts(spark: S, d: str) -> DataFrame:
    return visits(spark, d).select("visit_id", "profile_id", "date_key", "ms", "url", "raw_url", "domain", "category", "page", "interaction", "source", "pack", "rule", "engine", "search", "query", "name", "tier", "is_new_domain")


@query("search_rules", "SELECT profile_id, url_id, CASE WHEN rule_value <> '' THEN rule_engine END AS engine, CASE WHEN rule_value <> '' THEN rule_name END AS name, nullif(rule_value, '') AS query FROM known", VISITS_SQL)
def search_rules(spark: S, d: str) -> DataFrame:
    rows, u = urls.with_parts(archive(spark, d)["urls"], "url")
    return rows.withColumn("r", sites.search_rule(u)).select("profile_id", "url_id", "r.engine", F.col("r.name").alias("name"), "r.query")


@query("fuzzy_topk", """SELECT doc_id, word, distance FROM (SELECT doc_id, word, distance, row_number() OVER (PARTITION BY doc_id ORDER BY distance, word) AS r FROM
  (SELECT doc_id, word, levenshtein(word, 'thation') AS distance FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents)
   WHERE contains(word, 'tha') OR contains(word, 'hat') OR contains(word, 'ati') OR contains(word, 'tio') OR contains(word, 'ion')) WHERE distance <= 2) WHERE r = 1 ORDER BY distance, doc_id LIMIT 20""".replace("\\\\", "\\"))
def fuzzy_topk(spark: S, d: str) -> DataFrame:
    return recall.fuzzy(_read(spark, d, "documents"), "doc_id", "text", "thation", 20).withColumnRenamed("id", "doc_id")


@query("trigram_sim", """SELECT a, b, round(n * 1.0::DOUBLE / (sa + sb - n), 6) AS sim FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n, any_value(x.s) AS sa, any_value(y.s) AS sb FROM t x JOIN t y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL)
  WHERE n * 1.0::DOUBLE / (sa + sb - n) >= 0.5""", """t AS (SELECT item_id, g, count(*) OVER (PARTITION BY item_id) AS s FROM (SELECT DISTINCT item_id, substr(lower(text), i, 3) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark)))""")
def trigram_sim(spark: S, d: str) -> DataFrame:
    b = _read(spark, d, "benchmark").select("item_id", text.trigrams(F.lower("text")).alias("t"))
    g = b.select("item_id", F.size("t").alias("s"), F.explode("t").alias("g"))
    x, y = (g.select(*[F.col(c).alias(f"{c}_{n}") if c != "g" else F.col(c) for c in g.columns]) for n in "xy")
    n = x.join(y, "g").where("item_id_x < item_id_y").groupBy(F.col("item_id_x").alias("a"), F.col("item_id_y").alias("b")).agg(F.count("*").alias("n"), F.first("s_x").alias("sa"), F.first("s_y").alias("sb"))
    sim = F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))
    return n.withColumn("sim", sim).where("sim >= 0.5").select("a", "b", F.round("sim", 6).alias("sim"))


TERMS = ("thation", "ander", "onin", "ouer")


@query("bm25_topk", rf"""SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {recall.K1 + 1}::DOUBLE / (tf + {recall.K1}::DOUBLE * (1 - {recall.B}::DOUBLE + {recall.B}::DOUBLE * size / mean))), 6) AS score FROM
  (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM w WHERE term IN {TERMS} GROUP BY doc_id, term)), (SELECT count(DISTINCT doc_id) AS n, count(*) / count(DISTINCT doc_id) AS mean FROM w)
  GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""", r"w AS (SELECT doc_id, term, count(*) OVER (PARTITION BY doc_id) AS size FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '')")
def bm25_topk(spark: S, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    n, mean = recall.sizes(docs, "text")
    return recall.bm25(recall.postings(docs, "doc_id", "text", TERMS), list(TERMS), n, mean, 20).withColumnRenamed("id", "doc_id")


# --- browsing ---

@query("list_history", "SELECT visit_id, ms, url, domain FROM v WHERE profile_id = 'view' AND contains(url, 'topic') ORDER BY ms DESC, visit_id DESC LIMIT 150", VISITS_SQL)
def list_history(spark: S, d: str) -> DataFrame:
    return recall.page(visits(spark, d).where((F.col("profile_id") == "view") & F.contains("url", F.lit("topic")))).select("visit_id", "ms", "url", "domain")


@query("keyset_page", "SELECT visit_id, ms FROM v WHERE ms < 1706000000000 OR (ms = 1706000000000 AND visit_id < 500) ORDER BY ms DESC, visit_id DESC LIMIT 50", VISITS_SQL)
def keyset_page(spark: S, d: str) -> DataFrame:
    return recall.page(visits(spark, d), (1706000000000, 500), 50).select("visit_id", "ms")


@query("filter_grammar", """SELECT page_id, url FROM (SELECT *, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS title FROM pages) WHERE contains(regexp_extract(lower(url), '://([^/?#]*)', 1), 'example.com')
  AND NOT contains(lower(url), 'ref=x') AND regexp_matches(lower(url), '\\.html(?:[?#]|$)') AND NOT contains(title, 'zzz')""".replace("\\\\", "\\"))
def filter_grammar(spark: S, d: str) -> DataFrame:
    p = _read(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1)).withColumn("ms", F.lit(0))
    return p.where(recall.condition(recall.parse("site:example.com -inurl:ref=x ext:html -intitle:zzz"))).select("page_id", "url")


@query("regex_filter", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)/(en|de)/[0-9]*7\\.html')".replace("\\\\", "\\"))
def regex_filter(spark: S, d: str) -> DataFrame:
    return _read(spark, d, "pages").where(F.col("url").rlike(r"(?i)/(en|de)/[0-9]*7\.html")).select("page_id", "url")


@query("latest_asof", "SELECT l_orderkey, l_linenumber, o_orderkey AS last_order, o_totalprice AS last_price FROM (SELECT l_orderkey, l_linenumber, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY rid ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM (SELECT l.*, o_custkey, row_number() OVER () AS rid FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey) l LEFT JOIN (SELECT o_custkey AS c, o_orderdate, o_orderkey, o_totalprice FROM orders) o ON l.o_custkey = o.c AND o.o_orderdate <= l.l_shipdate) WHERE r = 1")
def latest_asof(spark: S, d: str) -> DataFrame:
    """The customer's newest order when an item was shipped."""
    o = _read(spark, d, "orders")
    items = _read(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey").select("l_orderkey", "l_linenumber", "cust", "l_shipdate")
    right = o.select(F.col("o_custkey").alias("cust"), "o_orderdate", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))
    return recall.as_of(items, right, "cust", "l_shipdate", "o_orderdate", ["last_order", "last_price"]).select("l_orderkey", "l_linenumber", "last_order", "last_price")


# --- vectors ---

def _asked(spark: S, d: str) -> list[float]:
    return _read(spark, d, "embeddings").where("vec_id = 3").first().embedding


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query("cosine_topk", f"SELECT e.vec_id, round({_DOT} / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark: S, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, d)])
    e = _read(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("score"))
    return e.orderBy(F.desc("score"), "vec_id").limit(10)


@query("hamming_topk", "SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: ((x[1] >= 0) <> (x[2] >= 0))::INT))::INT AS bits FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY bits, vec_id LIMIT 10")
def hamming_topk(spark: S, d: str) -> DataFrame:
    q = vectors.binarize(F.array(*[F.lit(float(x)) for x in _asked(spark, d)]))
    return _read(spark, d, "embeddings").select("vec_id", vectors.hamming(vectors.binarize(F.col("embedding")), q).cast("int").alias("bits")).orderBy("bits", "vec_id").limit(10)


@query("int8_rescore_topk", """SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: (CASE WHEN scale = 0 THEN 0 ELSE round(x[1]::DOUBLE / scale) END) * x[2]::DOUBLE)) * scale, 6) AS score FROM
  (SELECT vec_id, embedding, q, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM
   (SELECT e.vec_id, e.embedding, q.embedding AS q, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: ((x[1] >= 0) <> (x[2] >= 0))::INT)) AS bits FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY bits, vec_id LIMIT 2000)) ORDER BY score DESC, vec_id LIMIT 10""")
def int8_rescore_topk(spark: S, d: str) -> DataFrame:
    return vectors.two_stage_topk(_read(spark, d, "embeddings"), _asked(spark, d), 10)


@query("vector_batch_topk", """SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT query, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: (CASE WHEN scale = 0 THEN 0 ELSE round(x[1]::DOUBLE / scale) END) * x[2]::DOUBLE)) * scale, 6) AS score FROM
    (SELECT *, max(CASE WHEN near <= 2000 THEN bits END) OVER (PARTITION BY query) AS edge, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM
      (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits) AS near FROM (SELECT q.vec_id AS query, e.vec_id, e.embedding, q.embedding AS q, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: ((x[1] >= 0) <> (x[2] >= 0))::INT)) AS bits
        FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0))) WHERE bits <= edge)) WHERE rank <= 10""")
def vector_batch_topk(spark: S, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, a stated query set, from stored planes."""
    e = _read(spark, d, "embeddings")
    plane = once(spark, "vector-plane", [f"{d}/embeddings.parquet"], lambda: planes.build(e))
    return planes.batch_topk(plane, e.where("vec_id % 100 = 0"), 10).select("query", F.col("id").alias("vec_id"), "score", "rank")


def _lists(spark: S, d: str) -> list[tuple[DataFrame, float]]:
    docs = _read(spark, d, "documents").select("doc_id", "n_chars")
    by = lambda *o: F.row_number().over(Window.orderBy(*o)) - 1
    top = lambda *o: docs.orderBy(*o).limit(100).select("doc_id", by(*o).alias("rank"))  # noqa: E731  a bounded list
    return [(top(F.desc("n_chars"), "doc_id"), 1.0), (top(F.expr("doc_id * 7919 % 1009"), "doc_id"), 0.5)]


_RRF = "r AS (SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, 1.0::DOUBLE AS w FROM documents UNION ALL SELECT doc_id, row_number() OVER (ORDER BY doc_id * 7919 % 1009, doc_id) - 1, 0.5::DOUBLE FROM documents) WHERE rank < 100 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50)"


@query("rrf_fusion", "SELECT * FROM r", _RRF)
def rrf_fusion(spark: S, d: str) -> DataFrame:
    return vectors.fuse(_lists(spark, d), "doc_id", 50)


@query("starred_boost", "SELECT r.doc_id, round(score / (SELECT max(score) FROM r) + CASE WHEN s.doc_id IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END, 6) AS score FROM r LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) s USING (doc_id)", _RRF)
def starred_boost(spark: S, d: str) -> DataFrame:
    return vectors.starred_boost(rrf_fusion(spark, d), _read(spark, d, "labels").where("quality = 1"), "doc_id")


@query("working_set", """SELECT url, round(100 * (url IN (SELECT key FROM stars))::INT + 10 * (max(ms) >= 1706000000000)::INT + 25 * bool_or(raw_url IN (SELECT url FROM notes) OR raw_url IN (SELECT url FROM tags))::INT + 5 * ln(1 + count(*)), 6) AS score
  FROM v GROUP BY url ORDER BY score DESC, url LIMIT 100""", browse._OV)
def working_set(spark: S, d: str) -> DataFrame:
    """The pages that matter most now: starred, noted or tagged, seen of late, often visited."""
    stars, notes, tags, _ = browse._overlays(spark, d)
    g = visits(spark, d).groupBy("url", "raw_url").agg(F.max("ms").alias("ms"), F.count("*").alias("visits"))
    marked = notes.select(F.col("url").alias("raw_url")).union(tags.select("url")).distinct().withColumn("marked", F.lit(True))
    g = g.join(marked, "raw_url", "left").groupBy("url").agg((F.max("ms") >= 1706000000000).alias("recent"), F.coalesce(F.max("marked"), F.lit(False)).alias("annotated"), F.sum("visits").alias("visits"))
    starred = stars.select(F.col("key").alias("url"), F.lit(True).alias("starred")).distinct()
    return vectors.working_set(g.join(starred, "url", "left").fillna(False, ["starred"]), 100).select("url", "score")


@query("content_hash_dedup", "SELECT hash, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256('dedup/v1' || chr(10) || 'canonical=' || source || chr(10) || 'title=' || lang || chr(10) || 'enrichment=' || text) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1")
def content_hash_dedup(spark: S, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs > 1")


# --- ingest ---

@query("url_upsert", "SELECT domain, url, title, last_ms, visit_count, typed_count FROM (SELECT domain, url, 't' || visit_id AS title, ms AS last_ms, max(visit_id % 100) OVER (PARTITION BY domain) AS visit_count, max(visit_id % 7) OVER (PARTITION BY domain) AS typed_count, row_number() OVER (PARTITION BY domain ORDER BY ms DESC, CASE WHEN visit_id % 2 = 0 THEN -1 ELSE visit_id END, url, 't' || visit_id) AS r FROM v) WHERE r = 1", VISITS_SQL)
def url_upsert(spark: S, d: str) -> DataFrame:
    v = visits(spark, d).select("domain", "url", F.concat(F.lit("t"), F.col("visit_id").cast("string")).alias("title"), F.col("ms").alias("last_ms"), (F.col("visit_id") % 100).alias("visit_count"), (F.col("visit_id") % 7).alias("typed_count"), F.col("visit_id").alias("arrival"))
    return ingest.upsert_urls(v.where("arrival % 2 = 0").drop("arrival"), v.where("arrival % 2 = 1"), ["domain"])


_BATCH = VISITS_SQL + """, b AS (SELECT profile_id, visit_id % 3000 AS source_id, domain || '/' || (visit_id % 11) AS fingerprint, visit_id AS arrival FROM v),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, source_id ORDER BY arrival) AS r FROM b WHERE arrival >= 1000 AND (profile_id, source_id) NOT IN (SELECT (profile_id, source_id) FROM b WHERE arrival < 1000)) WHERE r = 1)"""


@query("visit_dedup", "SELECT profile_id, source_id, fingerprint, arrival FROM (SELECT n.*, row_number() OVER (PARTITION BY profile_id, fingerprint ORDER BY arrival) AS q FROM n ANTI JOIN (SELECT * FROM b WHERE arrival < 1000) e USING (profile_id, fingerprint)) WHERE q = 1", _BATCH)
def visit_dedup(spark: S, d: str) -> DataFrame:
    b = visits(spark, d).select("profile_id", (F.col("visit_id") % 3000).alias("source_id"), F.concat("domain", F.lit("/"), (F.col("visit_id") % 11).cast("string")).alias("fingerprint"), F.col("visit_id").alias("arrival"))
    return ingest.dedup_visits(b.where("arrival < 1000"), b.where("arrival >= 1000"))


@query("watermark_max", "SELECT profile_id, max(visit_id) AS visit_id, max(ms) AS ms FROM v GROUP BY profile_id", VISITS_SQL)
def watermark_max(spark: S, d: str) -> DataFrame:
    v = visits(spark, d)
    return ingest.watermarks(v.where("visit_id < 500").select("profile_id", "visit_id", "ms"), v.where("visit_id >= 500"))


@query("batch_revert", "SELECT profile_id, count(*) AS visits FROM v WHERE visit_id % 10 NOT IN (3, 4) GROUP BY profile_id", VISITS_SQL)
def batch_revert(spark: S, d: str) -> DataFrame:
    v = visits(spark, d).withColumn("batch_id", F.col("visit_id") % 10)
    return ingest.visible(v, spark.range(3, 5).toDF("batch_id")).groupBy("profile_id").agg(F.count("*").alias("visits"))


_METRICS = [*[k for keys in ingest.ENGAGEMENT.values() for k in keys], "engagement.other"]
_JSON = ["true", "false", "null", '"closed"', "oops"]
_EVIDENCE = f"""ea AS (SELECT event_type AS profile_id, event_id // 4 AS source_id, [{", ".join(f"'{k}'" for k in _METRICS)}][event_id * 7 % {len(_METRICS)} + 1] AS key, CASE WHEN event_id % 3 = 0 THEN (props->>'k')::BIGINT ELSE round(value)::BIGINT END AS value,
    (props->>'k')::BIGINT AS whole, event_id % 3 = 0 AS is_int, event_id AS arrival FROM events WHERE event_id % 5 > 0),
  xa AS (SELECT event_type AS profile_id, event_id // 4 AS source_id, CASE WHEN event_id % 2 = 0 THEN 'load' ELSE 'end' END AS key, [{", ".join(f"'{x}'" for x in _JSON)}][event_id % {len(_JSON)} + 1] AS value, event_id AS arrival FROM events WHERE event_id % 3 = 1)"""
_PIVOT = ", ".join(
    f"max_by({'CASE WHEN is_int THEN whole END' if name == 'load_successful' else 'value'}, arrival) FILTER (key IN ({', '.join(repr(k) for k in keys)}){' AND is_int' if name == 'load_successful' else ''}) AS {name}" for name, keys in ingest.ENGAGEMENT.items()
)


@query("evidence_pivot", f"""SELECT * FROM (SELECT profile_id, source_id, {", ".join(f"e.{n}" for n in ingest.ENGAGEMENT if n != "load_successful")}, coalesce(e.load_successful <> 0, CASE x.load WHEN 'true' THEN true WHEN 'false' THEN false END) AS load_successful,
    CASE WHEN x.ended = '"closed"' THEN 'closed' END AS page_end_reason FROM (SELECT profile_id, source_id, {_PIVOT} FROM ea GROUP BY ALL) e
    FULL JOIN (SELECT profile_id, source_id, max_by(value, arrival) FILTER (key = 'load') AS load, max_by(value, arrival) FILTER (key = 'end') AS ended FROM xa GROUP BY ALL) x USING (profile_id, source_id)) WHERE coalesce({", ".join(f"{n}::VARCHAR" for n in ingest.SIGNALS)}) IS NOT NULL""", _EVIDENCE)
def evidence_pivot(spark: S, d: str) -> DataFrame:
    """Signals of visits from engagement and context evidence that is made from the events' values and properties."""
    e = _read(spark, d, "events")
    base = [F.col("event_type").alias("profile_id"), F.floor(F.col("event_id") / 4).alias("source_id"), F.col("event_id").alias("arrival")]
    key = F.element_at(F.array(*[F.lit(k) for k in _METRICS]), (F.col("event_id") * 7 % len(_METRICS) + 1).cast("int"))
    whole = F.get_json_object("props", "$.k").cast("long")
    # what says whether a page loaded is a whole number only
    engagement = e.where("event_id % 5 > 0").select(*base, key.alias("metric_key"), F.when(F.col("event_id") % 3 == 0, whole).alias("value_int"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value_real"))
    engagement = engagement.where("metric_key <> 'engagement.load_successful' OR value_int IS NOT NULL")
    said = F.when(F.col("event_id") % 2 == 0, "context.load_successful").otherwise("context.page_end_reason")
    context = e.where("event_id % 3 = 1").select(*base, said.alias("context_key"), F.element_at(F.array(*[F.lit(x) for x in _JSON]), (F.col("event_id") % len(_JSON) + 1).cast("int")).alias("value_json"))
    return ingest.observed_interactions(engagement, context)


@query("manifest_chain", "SELECT profile_id, seq FROM (SELECT profile_id, visit_id AS seq, lag('h' || visit_id) OVER (PARTITION BY profile_id ORDER BY visit_id) AS expected, CASE WHEN visit_id % 50 = 7 THEN 'x' ELSE lag('h' || visit_id) OVER (PARTITION BY profile_id ORDER BY visit_id) END AS parent FROM v) WHERE parent IS DISTINCT FROM expected", VISITS_SQL)
def manifest_chain(spark: S, d: str) -> DataFrame:
    v = visits(spark, d).select("profile_id", F.col("visit_id").alias("seq"), F.concat(F.lit("h"), F.col("visit_id").cast("string")).alias("hash"))
    before = F.lag("hash").over(Window.partitionBy("profile_id").orderBy("seq"))
    m = v.withColumn("parent", F.when(F.col("seq") % 50 == 7, "x").otherwise(before))
    return ingest.broken_chain(m).select("profile_id", "seq")


@query("takeout_merge", "SELECT url, count(*) AS visit_count, arg_max(title, (ms, visit_id)) FILTER (title IS NOT NULL) AS title, max(ms) AS last_ms FROM (SELECT url, ms, visit_id, CASE WHEN visit_id % 4 > 0 THEN 'title ' || visit_id END AS title FROM v) GROUP BY url", VISITS_SQL)
def takeout_merge(spark: S, d: str) -> DataFrame:
    title = F.when(F.col("visit_id") % 4 > 0, F.concat(F.lit("title "), F.col("visit_id").cast("string")))
    return ingest.merge_takeout_urls(visits(spark, d).select("url", title.alias("title"), "ms", F.col("visit_id").alias("ordinal")))


@query("time_convert", "SELECT visit_id, least(greatest((ms * 1000 + 999 - 11644473600000000 + 11644473600000000) // 1000, 0), 253402300799999) AS chrome, ms AS firefox, round((round(ms / 1000.0::DOUBLE - 978307200, 3) + 978307200.0::DOUBLE) * 1000)::BIGINT AS safari FROM v", VISITS_SQL)
def time_convert(spark: S, d: str) -> DataFrame:
    ms = F.col("ms")
    chrome = text.chrome_ms(ms * 1000 + 999 + 11644473600000000)
    return visits(spark, d).select("visit_id", chrome.alias("chrome"), text.firefox_ms(ms * 1000 + 1).alias("firefox"), text.safari_ms(F.round(ms / 1000.0 - 978307200, 3)).alias("safari"))


@query("conversation_roles", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_roles(spark: S, d: str) -> DataFrame:
    c = _read(spark, d, "conversations")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), roles.alias("roles"))

