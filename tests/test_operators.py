"""Operators against plain loops over small frames."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from wayfold.functions import sites, taxonomy, text, urls
from wayfold.operators import explain, facts, ingest, overlays, recall, structure, vectors
from wayfold.sources import browsers, export
from wayfold.streaming import live

MIN = 60_000


def visits(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], {p: 0 for p in "ab"}
    for i in range(n):
        p = rng.choice("ab")
        t[p] += rng.choice([0, MIN, 5 * MIN, 15 * MIN, 15 * MIN + 1, 30 * MIN, 30 * MIN + 1, 90 * MIN])
        search = rng.choice(["red apple", "red apples tree", "green tea", "tea green pot"]) if rng.random() < 0.2 else None
        rows.append((i, t[p], p, f"d{rng.randrange(5)}", f"u{rng.randrange(12)}", "docs", "x" if search else None, search, i - 1 if rng.random() < 0.4 and i else None))
    return rows, spark.createDataFrame(rows, "visit_id long, ms long, profile_id string, domain string, url string, category string, engine string, search string, from_visit long")


def loop(rows):
    """Sessions and trails one visit after another."""
    session, trail, state = {}, {}, {}
    for v in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        s = state.get(v[2])
        if s is None or v[1] - s["last"] > 30 * MIN:
            s = state[v[2]] = {"id": v[0], "trail": None}
        elif s["trail"] is not None and v[7] is None and v[1] - s["last"] > 15 * MIN:
            s["trail"] = None
        s["last"] = v[1]
        session[v[0]] = f"session:{v[2]}:{s['id']}"
        if v[7] is not None:
            s["trail"] = v[0]
        if s["trail"] is not None:
            trail[v[0]] = f"trail:{v[2]}:{s['trail']}"
    return session, trail


def test_sessions_and_trails_equal_a_loop(spark):
    rows, df = visits(spark)
    session, trail = loop(rows)
    with_sessions = structure.sessionize(df)
    assert {r.visit_id: r.session_id for r in with_sessions.collect()} == session
    assert {r.visit_id: r.trail_id for r in structure.trail_members(with_sessions).collect()} == trail


def test_path_flows_equal_a_loop(spark):
    rows, df = visits(spark)
    session, _ = loop(rows)
    runs = {}
    for v in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        r = runs.setdefault(session[v[0]], [])
        if r and r[-1] == v[3]:
            continue
        r.append(v[3])
    want = {}
    for s, r in runs.items():
        for i in range(len(r) - 2):
            k = (s.split(":")[1], " → ".join(r[i : i + 3]))
            want[k] = want.get(k, 0) + 1
    got = {(r.profile_id, r.pattern): r.occurrences for r in structure.path_flows(structure.sessionize(df), 3).collect()}
    assert got == want


def test_navigation_goes_back_to_the_root_and_stops_in_a_cycle(spark):
    rows = [("p", 1, None), ("p", 2, 1), ("p", 3, 2), ("p", 4, 3), ("p", 9, 99), ("q", 4, 1), ("p", 20, 21), ("p", 21, 20)]
    df = spark.createDataFrame(rows, "profile_id string, visit_id long, from_visit long")
    got = structure.navigation_paths(df, df.where("profile_id = 'p' AND visit_id IN (4, 9, 20)")).collect()
    assert sorted((r.leaf, r.depth, r.visit_id) for r in got if r.leaf != 20) == [(4, 0, 1), (4, 1, 2), (4, 2, 3), (4, 3, 4), (9, 0, 9)]
    assert {r.visit_id for r in got if r.leaf == 20} == {20, 21}


def test_navigation_of_long_chains_and_cycles_is_whole(spark):
    chain = lambda p, n: [(p, i, i - 1 if i else None) for i in range(n)]
    rows = chain("a", 17) + chain("b", 101) + [("c", i, (i + 1) % 40) for i in range(40)] + [("c", 100, 5), ("c", 101, 100)]
    df = spark.createDataFrame(rows, "profile_id string, visit_id long, from_visit long")
    got = structure.navigation_paths(df, df.where("profile_id = 'a' AND visit_id = 16 OR profile_id = 'b' AND visit_id = 100 OR profile_id = 'c' AND visit_id = 101")).collect()
    ring = [101, 100, *[(5 + k) % 40 for k in range(40)]]
    want = [("a", d, d) for d in range(17)] + [("b", d, d) for d in range(101)] + [("c", len(ring) - 1 - u, v) for u, v in enumerate(ring)]
    assert sorted((r.profile_id, r.depth, r.visit_id) for r in got) == sorted(want)


def test_grammar():
    q = recall.parse('site:Example.com -inurl:ref intitle:"big news" "exact words" -"not this" plain after:2024-01-02 before:2024 tag:a site:example.com')
    assert q.wanted == {"site": ["example.com"], "title": ["big news"], "tag": ["a"]} and q.unwanted == {"url": ["ref"]}
    assert (q.words, q.exact, q.without) == (["plain"], ["exact words"], ["not this"])
    assert q.after == int(datetime(2024, 1, 2).timestamp() * 1000) and q.before == int(datetime(2025, 1, 1).timestamp() * 1000) - 1


def test_url_functions(spark):
    rows = {
        "HTTPS://User@A.B.co.uk.:8080/x/y?utm_source=1&q=a+b%20c&ref=z#f": ("https://a.b.co.uk/x/y?q=a+b+c#f", "b.co.uk", "a", "x", None),
        "http://10.0.0.1/": ("http://10.0.0.1/", "0.1", "10.0", "", None),
        "http://x.com?ref=1": ("http://x.com/", "x.com", "", "", None),
        "nonsense": (None, "", "", "", None),
        "https://www.google.com.:443/search?utm_x=1&oq=z&Q=a%2Bb++c&p=2": ("https://www.google.com/search?oq=z&Q=a+b+c&p=2", "google.com", "www", "search", "a b c"),
    }
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    u, h = F.col("url"), urls.host(F.col("url"))
    got = df.select("url", urls.normalize(u), urls.registrable_domain(h), urls.subdomain(h), urls.path_prefix(u), urls.search_query(u)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == rows


def test_taxonomy_precedence(spark):
    rows = {
        "https://gitlab.com/a/b/issues/1": ("developer", "issue", "github-issue"), "https://x.gitlab.com/a/b": ("developer", "repo", "github-repo"), "https://q.com/docs/x": ("docs", "docs_page", "docs-path"),
        "https://youtube.com/watch?V=1": ("video", "video_page", "video-watch"), "https://youtube.com/watch?w=1": ("unknown", "unknown", None), "https://google.com/docs/": ("search", "search_results", "google-search"),
        "https://mine.com/docs/x": ("work", "home", "mine.com"), "https://q.com/": ("unknown", "unknown", None), "nonsense": ("unknown", "unknown", None), "https://jd.com/item/product/1": ("shopping", "product_page", "taobao-product"),
    }
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    own = [taxonomy.Override("domain", "mine.com", "work", "home")]
    got = df.select("u", taxonomy.classify(F.col("u"), F.lit("x"), own).alias("c")).collect()
    assert {r.u: (r.c.category, r.c.page, r.c.rule) for r in got} == rows
    by_word = df.limit(1).select(taxonomy.classify(F.lit("https://q.com/"), F.lit("of the capital api")).alias("c"), taxonomy.classify(F.lit("x"), F.lit("VS plan")).alias("d")).first()
    assert (by_word.c.rule, by_word.c.confidence, by_word.d.rule) == ("docs-lexicon", 0.62, "compare-lexicon")


def test_search_rules_engines_and_kinds(spark):
    rows = [
        ("https://www.google.com/search?q=Sqlite+WAL", None, "sqlite wal", "google"), ("https://www.google.com/maps?q=x", None, "x", "google"), ("https://www.google.com/search?q=", None, None, None),
        ("https://search.brave.com/search?q=a", None, "a", "brave"), ("https://my.searx.org/?q=a", None, None, None), ("https://x.org/", "Given  term", "given term", "x.org"), ("https://www.youtube.com/results?search_query=b", None, "b", "youtube"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "u string, t string")
    assert [(r.s.query, r.s.engine) for r in df.select(sites.search_of(F.col("u"), F.col("t")).alias("s")).collect()] == [r[2:] for r in rows]
    kinds = [("", None, "navigational"), ("github.com", "github.com", "navigational"), ("github.com", "gist.github.com", "navigational"), ("github.com", "other.org", "keyword"), ("'docs.rs'", None, "navigational"), ("https://a.b.org/x", "b.org", "navigational"), ("two words.com", None, "keyword"), ("word", None, "keyword")]
    df = spark.createDataFrame([k[:2] for k in kinds], "q string, d string")
    assert [r[0] for r in df.select(text.query_kind(F.col("q"), F.col("d"))).collect()] == [k[2] for k in kinds]


def test_tokens_grams_and_texts(spark):
    r = spark.sql("SELECT 'The ＡＢＣ x 设计系统 of go1' AS s, '{\"fullName\":\"a/b\",\"description\":\"sum\",\"topics\":[\"x\",\"y\"]}' AS j").select(
        text.tokenize(F.col("s")), text.normalize_text(F.col("s")), text.compact(F.col("s")), text.han_grams(F.col("s")), text.query_terms(F.lit("How to the API, api v2 a")), text.enrichment_text(F.lit("sum"), F.col("j")),
        text.excerpt(F.lit("é" * 200)), text.excerpt(F.lit("  ")), text.embedding_content(F.lit("p"), F.lit("https://h.org/"), F.lit(None).cast("string"), F.lit("t"), F.lit(" "), F.lit("s"), F.lit("b" * 3000)),
    ).first()
    assert r[0] == ["ａｂｃ", "设计系统", "设计", "计系", "系统", "of", "go1"] and r[1] == "the abc x 设计系统 of go1" and r[2] == "TheＡＢＣx设计系统ofgo1"
    assert r[3] == sorted(["设计", "计系", "系统", "设计系", "计系统"]) and r[4] == ["api", "api", "v2"] and r[5] == "sum • a/b • x y"
    assert r[6] == "é" * 180 + "…" and r[7] is None and r[8] == "Profile: p\nVisited at: t\nURL: https://h.org/\nDomain: h.org\nTitle: (untitled)\nSummary: s\nReadable text:\n" + "b" * 2048


def test_times_and_edits(spark):
    r = spark.sql("SELECT double('NaN') n").select(
        text.chrome_ms(F.lit(11644473600000000 - 1)), text.chrome_ms(F.lit(11644473600001999)), text.firefox_ms(F.lit(1999)), text.safari_ms(F.col("n")), text.safari_ms(F.lit(0.0005)),
        text.bounded_distance(F.lit("helo"), F.lit("hello")), text.bounded_distance(F.lit("cat"), F.lit("car")), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))),
    ).first()
    assert tuple(r) == (0, 1, 1, 0, 978307200001, 1, None, 0.5)


def test_upsert_and_dedup(spark):
    s = "k long, url string, title string, last_ms long, visit_count long, typed_count long"
    old = spark.createDataFrame([(1, "a", "old", 10, 5, 1), (2, "b", "old", 10, 1, 1)], s)
    new = spark.createDataFrame([(1, "a", "tie", 10, 4, 9, 0), (2, "b", "new", 11, 0, 0, 1), (3, "c", "x", 1, 1, 1, 2), (3, "c", "y", 1, 1, 1, 3)], s + ", arrival long")
    got = {r.k: (r.title, r.visit_count, r.typed_count) for r in ingest.upsert_urls(old, new, ["k"]).collect()}
    assert got == {1: ("old", 5, 9), 2: ("new", 1, 1), 3: ("x", 1, 1)}
    v = "profile_id string, source_id long, fingerprint string, arrival long"
    seen = spark.createDataFrame([("p", 1, "f1", 0)], v)
    batch = spark.createDataFrame([("p", 1, "f9", 1), ("p", 2, "f1", 2), ("p", 3, "f3", 3), ("p", 3, "f4", 4), ("p", 4, "f3", 5), ("p", 5, "", 6), ("p", 6, "", 7), ("q", 1, "f1", 8)], v)
    assert sorted(r.arrival for r in ingest.dedup_visits(seen, batch).collect()) == [3, 6, 7, 8]


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float((i * k) % 7 - 3) for k in range(40)]) for i in range(30)], "vec_id long, embedding array<double>")
    a, b = ([float((i * k) % 7 - 3) for k in range(40)] for i in (3, 5))
    bits = df.where("vec_id = 3").select(vectors.hamming(vectors.binarize(F.col("embedding")), vectors.binarize(F.array(*map(F.lit, b))))).first()[0]
    assert bits == sum((x >= 0) != (y >= 0) for x, y in zip(a, b, strict=True))
    q = spark.createDataFrame([([0.0, 0.0],), ([1.0, -2.0],)], "v array<double>").select(vectors.quantize(F.col("v")).alias("q")).collect()
    assert [(r.q.scale, list(r.q.codes)) for r in q] == [(0.0, [0, 0]), (2 / 127, [64, -127])]


def test_as_of_takes_the_newest_row_before(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 0, 2), ("j", 5, 3)], "k string, t long, id long")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 6, "c")], "k string, rt long, v string")
    assert {r.id: r.v for r in recall.as_of(left, right, "k", "t", "rt", ["v"]).collect()} == {1: "b", 2: None, 3: None}


def test_sources(spark, tmp_path):
    spark.createDataFrame([(1, "u1", "t", 3, 1, 13344473600000000), (2, "u2", None, 1, 0, 13344473600000000 - 10**9)], "id long, url string, title string, visit_count long, typed_count long, last_visit_time long").write.parquet(f"{tmp_path}/c/urls")
    spark.createDataFrame([(1, 1, 13344473600000000, 0, 1, 2500), (2, 2, 13344473600000999, 1, 1, 0)], "id long, url long, visit_time long, from_visit long, transition long, visit_duration long").write.parquet(f"{tmp_path}/c/visits")
    u, v = browsers.chromium(spark, f"{tmp_path}/c")
    assert u.count() == 2 and {(r.source_visit_id, r.ms, r.from_visit, r.duration_ms) for r in v.collect()} == {("1", 1700000000000, None, 2), ("2", 1700000000000, 1, 0)}
    u, v = browsers.chromium(spark, f"{tmp_path}/c", since_visit=1, since_time=13344473600000000 + 1)
    assert [r.url for r in u.collect()] == ["u2"] and v.count() == 1
    spark.createDataFrame([(1, "s")], "id long, url string").write.parquet(f"{tmp_path}/s/history_items")
    spark.createDataFrame([(1, 1, "old", 1.0), (2, 1, None, 2.0)], "id long, history_item long, title string, visit_time double").write.parquet(f"{tmp_path}/s/history_visits")
    u, v = browsers.safari(spark, f"{tmp_path}/s")
    assert [(r.title, r.visit_count) for r in u.collect()] == [("old", 2)] and v.count() == 2
    lines = ['{"url":"a","timeUsec":"1700000000000999","title":"t"}', '{"titleUrl":"b","visitedAt":"2023-11-14T22:13:20Z"}', '{"title":"none"}', '{"url":"c"}', '{"url":"d","visitTime":5}']
    got = browsers.takeout(spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string")).collect()
    assert {(r.url, r.ms, r.skipped) for r in got} == {("a", 1700000000000, None), ("b", 1700000000000, None), ("c", None, "no time"), ("d", 5, None)}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/?x=1&y=(2)", "A <b>", 0), ("javascript:alert(1)", "bad", 1)], "url string, title string, ms long")
    for kind in ("jsonl", "markdown", "text", "html"):
        export.export(rows, f"{tmp_path}/{kind}", kind)
    html = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/html").collect())
    assert "A &lt;b&gt;" in html and "javascript" not in html and "x=1&amp;y" in html
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 2


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "p", "d", i) for i, m in enumerate((0, 10, 40, 41))] + [("2024-01-01 01:30:00", "p", "d", 3), ("2024-01-03 00:00:00", "p", "e", 9)]
    spark.createDataFrame(rows, "t string, profile_id string, domain string, source_id long").selectExpr("timestamp(t) AS ts", "profile_id", "domain", "source_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def run(f, name):
        q = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.visits, r.domains) for r in run(live.stream_sessions, "sess")) == [(1, 1), (4, 1)]
    assert [(r.domain, r.visits) for r in run(live.stream_daily, "daily")] == [("d", 5)]
    assert len(run(live.stream_dedup, "dedup")) == 5


def test_streamed_trails_equal_the_batch(spark, tmp_path):
    rows, df = visits(spark)
    half = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, part in enumerate((half[:200], half[200:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.stream_trails(stream).writeStream.format("memory").queryName("trails").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    session, trail = loop(rows)
    got = spark.table("trails").collect()
    assert {r.visit_id: r.session_id for r in got} == session and {r.visit_id: r.trail_id for r in got if r.trail_id} == trail


def test_replay_equals_a_full_rebuild(spark):
    rows, df = visits(spark)
    build = lambda v: structure.sessions(structure.sessionize(facts.with_new_domains(v))).select("profile_id", "session_id", "first_ms", "last_ms", "visits")
    before = df.where("visit_id NOT IN (150, 151, 290, 399)")
    late = df.where("visit_id IN (150, 151, 290, 399)").select("profile_id", "ms")
    full = lambda x: sorted(map(tuple, x.collect()))
    assert full(live.replay(build(before), df, late, build)) == full(build(df))
    gone = df.where("visit_id IN (200, 201)").select("profile_id", "ms")
    left = df.where("visit_id NOT IN (200, 201)")
    assert full(live.replay(build(df), left, gone, build)) == full(build(left))


def test_days_are_replaced(spark, tmp_path):
    rows, df = visits(spark)
    all_facts = facts.with_new_domains(df)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    facts.domain_rollup(all_facts.where("visit_id < 200")).write.partitionBy("date_key").parquet(f"{tmp_path}/r")
    live.refresh_rollups(all_facts.where("visit_id >= 200"), all_facts, f"{tmp_path}/r")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = facts.domain_rollup(all_facts)
    got = spark.read.parquet(f"{tmp_path}/r").selectExpr("string(date_key) AS date_key", *[c for c in kept.columns if c != "date_key"])
    touched = {r.date_key for r in all_facts.where("visit_id >= 200").select("date_key").distinct().collect()}
    assert {tuple(r) for r in got.collect() if r.date_key in touched} == {tuple(r) for r in kept.collect() if r.date_key in touched}


def test_more_sources(spark, tmp_path):
    w = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    t0 = 13344473600000000
    w([(1, "g", "p", t0, 5, 9, 1, "", "text/x")], "id long, guid string, target_path string, start_time long, received_bytes long, total_bytes long, state int, mime_type string, original_mime_type string", "downloads")
    w([(2, 7, " A b ")], "keyword_id long, url_id long, term string", "keyword_search_terms")
    w([(1, "icon", 1)], "id long, url string, icon_type int", "favicons")
    w([("page", 1)], "page_url string, icon_id long", "icon_mapping")
    w([(1, 16, 16, t0, bytearray(b"x")), (1, 32, 32, 5, bytearray(b"y"))], "icon_id long, width int, height int, last_updated long, image_data binary", "favicon_bitmaps")
    more = browsers.chromium_more(spark, str(tmp_path), since_icon=5)
    assert [(r.start_ms, r.mime_type, r.current_path) for r in more["downloads"].collect()] == [(1700000000000, "text/x", None)]
    assert [r.normalized_term for r in more["search_terms"].collect()] == ["a b"] and [(r.icon_url, r.width) for r in more["favicons"].collect()] == [("icon", 16)]
    w([(1, "u", "t", 2, 0, 1700000000000999)], "id long, url string, title string, visit_count long, hidden long, last_visit_date long", "moz_places")
    w([(1, 1, 1700000000000999, 0, 1), (2, 1, 1700000000001999, 1, 2)], "id long, place_id long, visit_date long, from_visit long, visit_type long", "moz_historyvisits")
    u, v = browsers.firefox(spark, str(tmp_path), 1)
    assert [r.last_ms for r in u.collect()] == [1700000000000] and [(r.source_visit_id, r.ms, r.from_visit) for r in v.collect()] == [("2", 1700000000001, 1)]
    seen = {(r.table, r.column): (r.kind, r.present, r.filled) for r in browsers.inspect({"d": spark.read.parquet(f"{tmp_path}/downloads")}, {"d": ["guid", "nothing"], "e": ["x"]}).collect()}
    assert seen == {("d", "guid"): ("string", True, 1), ("d", "nothing"): (None, False, 0), ("e", "x"): (None, False, 0)}


def test_takeout_files(spark):
    paths = {
        "Takeout/Chrome/BrowserHistory.json": "will-import", "Chrome\\Verlauf.json": "will-import", "x/a.jsonl": "will-import", "Chrome/Typed  URL.json": "known-ignored", "archive_browser.html": "known-ignored", "My Activity/Chrome/MyActivity.html": "needs-review",
        "Chrome/Bookmarks.html": "known-ignored", "Chrome/old history.csv": "needs-review", "Mail/all.mbox": "known-ignored", "Kalender/history.txt": "known-ignored", "other/browser dump.txt": "needs-review", "": "known-ignored",
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.k.disposition for r in df.select("p", browsers.takeout_kind(F.col("p")).alias("k")).collect()} == paths
    texts = [("a", '[{"url":"u1","time_usec":5000}, {"url":"u2"}]'), ("b", '{"Browser History": [{"url":"u3","visitTime":7}]}'), ("c", '{"url":"u4","visitTime":1}\n\n{"url":"u5","visitTime":2}\n')]
    records = browsers.takeout_records(spark.createDataFrame(texts, "path string, value string"))
    got = {(r.url, r.ms) for r in browsers.takeout(records).collect()}
    assert got == {("u1", 5), ("u2", None), ("u3", 7), ("u4", 1), ("u5", 2)}
    kept = browsers.native_entities(records.where("path = 'c'"), "typed-url").collect()
    assert len(kept) == 2 and kept[0].metadata["url"] == "u4" and len(kept[0].key) == 64


def test_overlays(spark):
    stars = spark.createDataFrame([("url", "https://a.com/", 5), ("domain", "b.com", 6)], "kind string, key string, starred_at long")
    changes = spark.createDataFrame([("url", "HTTPS://A.com/?utm_x=1", 9, 1, True), ("domain", "B.com", 9, 1, False), ("url", "https://c.com/", 9, 1, False), ("url", "https://c.com/", 10, 2, True)], "kind string, key string, starred_at long, seq long, starred boolean")
    after = overlays.set_stars(stars, changes)
    assert {(r.kind, r.key, r.starred_at) for r in after.collect()} == {("url", "https://a.com/", 5), ("url", "https://c.com/", 9)}
    assert {r.key: r.starred for r in overlays.is_starred(spark.createDataFrame([("https://A.com/?ref=1",), ("x",)], "key string"), after).collect()} == {"https://A.com/?ref=1": True, "x": False}
    notes = spark.createDataFrame([("u", "old", 1), ("w", "stays", 1)], "url string, notes string, updated_at long")
    assert {(r.url, r.notes) for r in overlays.set_notes(notes, spark.createDataFrame([("u", " ", 2), ("v", "new", 2)], "url string, notes string, updated_at long")).collect()} == {("w", "stays"), ("v", "new")}
    tags = spark.createDataFrame([("u", "a", 1), ("w", "b", 1)], "url string, tag string, created_at long")
    new = spark.createDataFrame([("u", [" X ", "x", "y", ""], 3)], "url string, tags array<string>, at long")
    assert {(r.url, r.tag) for r in overlays.replace_tags(tags, new).collect()} == {("w", "b"), ("u", "X"), ("u", "y")}


def test_ingest_of_profiles_and_checkpoints(spark):
    old = spark.createDataFrame([("a", 1, 5, "old", False), ("b", 2, 5, "b", True)], "profile_key string, id long, discovered_at long, profile_name string, enabled boolean")
    new = spark.createDataFrame([("a", 9, "new", 1), ("c", 9, "c", 2)], "profile_key string, discovered_at long, profile_name string, seq long")
    assert {r.profile_key: (r.id, r.discovered_at, r.profile_name, r.enabled) for r in ingest.upsert_profiles(old, new).collect()} == {"a": (1, 5, "new", True), "b": (2, 5, "b", True), "c": (None, 9, "c", True)}
    day = 86_400_000
    state = spark.createDataFrame([("a", "x", "x", 0), ("b", "x", "y", 10 * day), ("c", "x", "x", 9 * day), ("d", "x", None, None)], "profile_id string, schema_hash string, last_schema_hash string, last_checkpoint_ms long")
    assert {r.profile_id: r.reason for r in ingest.checkpoint_due(state, 10 * day, 7).collect()} == {"a": "periodic-checkpoint", "b": "source-schema-changed", "c": None, "d": "source-schema-changed"}
    s = "k long, url string, title string, last_ms long, visit_count long, typed_count long"
    kept = ingest.upsert_urls(spark.createDataFrame([(1, "a", "old", 10, 5, 1)], s), spark.createDataFrame([(1, "a", "new", None, 6, 1, 0)], s + ", arrival long"), ["k"]).first()
    assert (kept.title, kept.last_ms, kept.visit_count) == ("old", 10, 6)
    runs = spark.createDataFrame([(1, "ok", 5), (2, "failed", 6), (3, "failed", 7)], "run_id long, status string, started_ms long")
    assert ingest.dashboard(spark.sql("SELECT 3 AS visits"), runs).first().asDict() == {"visits": 3, "last_ok_ms": 5, "failed_since": 2} and [r.run_id for r in ingest.recent_runs(runs, 2).collect()] == [3, 2]
    assert ingest.restore(spark.range(1, 4).toDF("batch_id"), spark.range(2, 3).toDF("batch_id")).count() == 2


def test_facets_modes_and_static_vectors(spark):
    pages = spark.createDataFrame([("a", 5, "p", "d"), ("b", 3, "p", "e"), ("c", 9, "q", "d")], "key string, visited_at long, profile_id string, domain string").withColumn("url", F.col("key"))
    fused = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "key string, score double")
    assert [r.key for r in vectors.search_pages(fused, pages, "relevance", 5).collect()] == ["b", "a"]
    assert [r.key for r in vectors.search_pages(None, pages, "relevance", 2).collect()] == ["c", "a"] and [r.key for r in vectors.search_pages(fused, pages, "oldest", 5, 1).collect()] == ["a"]
    assert [r.key for r in vectors.with_facets(pages, "p", "d", pages.where("key <> 'x'")).collect()] == ["a"]
    ids = spark.createDataFrame([([1, 2, 9],), ([9],)], "ids array<int>")
    got = [list(r[0]) for r in ids.select(vectors.static_embedding(F.col("ids"), {1: [3.0, 0.0], 2: [0.0, 4.0]})).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0]
    q = spark.createDataFrame([([1.0, -2.0],)], "v array<double>").select(vectors.dequantize(vectors.quantize(F.col("v")))).first()[0]
    assert abs(q[0] - 1.0) < 0.02 and q[1] == -2.0
    seqs = spark.createDataFrame([("a", 1, 7), ("a", 3, 8), ("b", 2, 9)], "k string, seq long, v long")
    assert {(r.k, r.v) for r in vectors.latest(seqs, "k", "seq").collect()} == {("a", 8), ("b", 9)}


def test_latest_flow_and_exports(spark):
    rows = [(i, i * MIN, "a", d, "s") for i, d in enumerate("xyyxyzxy")]
    df = spark.createDataFrame(rows, "visit_id long, ms long, profile_id string, domain string, session_id string")
    r = explain.latest_flow(df, ["x", "y"]).first()
    assert (list(r.visit_ids), r.last_ms) == ([6, 7], 7 * MIN)
    old = spark.createDataFrame([("u", 1, False), ("v", 1, False)], "url string, updated_at long, deleted boolean")
    assert [x.url for x in export.keep_latest(old, spark.createDataFrame([("u", 2, True)], "url string, updated_at long, deleted boolean"), ["url"]).collect()] == ["v"]


def test_urls_of_the_archive_are_counted_by_hash(spark):
    from wayfold.sources import testdata

    urls = testdata.archive(spark, "/root/testdata/sf0.001")["urls"]
    assert "SortAggregate" not in urls._jdf.queryExecution().executedPlan().toString()
