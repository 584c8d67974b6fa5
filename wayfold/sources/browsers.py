"""Browser history staged as Parquet tables, read into the canonical url and visit rows.

Raw tables are staged one folder a table (``urls``, ``visits``, ...), as an export of the source
files writes them; columns that a version lacks are null. Times become Unix milliseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import chrome_ms, firefox_ms, safari_ms


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column that may be missing in this version of the source."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def chromium(spark: SparkSession, folder: str, since_visit: int = 0, since_time: int = 0) -> tuple[DataFrame, DataFrame]:
    """urls and visits after the cursors: visits of greater id, urls visited since or with such a visit."""
    urls, visits = (spark.read.parquet(f"{folder}/{t}") for t in ("urls", "visits"))
    new = visits.where(F.col("id") > since_visit)
    if since_visit or since_time:
        touched = urls.where(F.col("last_visit_time") >= since_time).select("id").union(new.select(F.col("url").alias("id"))).distinct()
        urls = urls.join(touched, "id", "left_semi")
    out = urls.select(
        F.col("id").alias("source_url_id"), "url", "title", F.col("visit_count").cast("long"), F.col("typed_count").cast("long"),
        chrome_ms(F.col("last_visit_time")).alias("last_ms"), F.coalesce(column(urls, "hidden", "int"), F.lit(0)).alias("hidden"),
    )
    rows = new.select(
        F.col("id").cast("string").alias("source_visit_id"), F.col("url").alias("source_url_id"), chrome_ms(F.col("visit_time")).alias("ms"),
        F.when(column(new, "from_visit", "long") > 0, column(new, "from_visit", "long")).alias("from_visit"), column(new, "transition", "long").alias("transition"),
        F.floor(column(new, "visit_duration", "long") / 1000).alias("duration_ms"), column(new, "external_referrer_url", "string").alias("referrer"), column(new, "app_id", "string").alias("app_id"),
    )
    return out, rows


def firefox(spark: SparkSession, folder: str, since_visit: int = 0) -> tuple[DataFrame, DataFrame]:
    places, visits = (spark.read.parquet(f"{folder}/{t}") for t in ("moz_places", "moz_historyvisits"))
    new = visits.where(F.col("id") > since_visit)
    if since_visit:
        places = places.join(new.select(F.col("place_id").alias("id")).distinct(), "id", "left_semi")
    out = places.select(F.col("id").alias("source_url_id"), "url", "title", F.col("visit_count").cast("long"), F.lit(0).cast("long").alias("typed_count"), firefox_ms(F.col("last_visit_date")).alias("last_ms"), F.col("hidden").cast("int"))
    rows = new.select(
        F.col("id").cast("string").alias("source_visit_id"), F.col("place_id").alias("source_url_id"), firefox_ms(F.col("visit_date")).alias("ms"), F.when(F.col("from_visit") > 0, F.col("from_visit")).alias("from_visit"),
        F.col("visit_type").cast("long").alias("transition"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("referrer"), F.lit(None).cast("string").alias("app_id"),
    )
    return out, rows


def safari(spark: SparkSession, folder: str, since_visit: int = 0) -> tuple[DataFrame, DataFrame]:
    """A url's title is that of its newest visit that has one; counts are of all its visits."""
    items, visits = (spark.read.parquet(f"{folder}/{t}") for t in ("history_items", "history_visits"))
    if "load_successful" in visits.columns:
        visits = visits.where(F.coalesce(F.col("load_successful").cast("int"), F.lit(1)) == 1)
    order = F.struct("visit_time", "id")
    seen = visits.groupBy(F.col("history_item").alias("id")).agg(F.count("*").alias("visit_count"), F.max("visit_time").alias("last"), F.max_by("title", F.when(F.col("title").isNotNull(), order)).alias("title"))
    new = visits.where(F.col("id") > since_visit)
    touched = items.join(new.select(F.col("history_item").alias("id")).distinct(), "id", "left_semi") if since_visit else items
    out = touched.join(seen, "id").select(F.col("id").alias("source_url_id"), "url", "title", "visit_count", F.lit(0).cast("long").alias("typed_count"), safari_ms(F.col("last")).alias("last_ms"), F.lit(0).alias("hidden"))
    rows = new.select(
        F.col("id").cast("string").alias("source_visit_id"), F.col("history_item").alias("source_url_id"), safari_ms(F.col("visit_time")).alias("ms"), column(new, "redirect_source", "long").alias("from_visit"),
        F.lit(None).cast("long").alias("transition"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("referrer"), F.lit(None).cast("string").alias("app_id"),
    )
    return out, rows


def takeout(lines: DataFrame) -> DataFrame:
    """lines: value (a JSON record), ordinal. Records with url, title, ms and why one is skipped (null if it isn't).

    A record without a URL is ignored, one without a readable time is skipped.
    """
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    millis = F.coalesce(
        F.try_to_number(F.get_json_object("value", "$.visitTime"), F.lit("9999999999999")).cast("long"),
        F.floor(F.coalesce(get("timeUsec", "time_usec").try_cast("long")) / 1000),
        F.unix_millis(F.try_to_timestamp(get("visitedAt"))),
    )
    out = lines.select(get("url", "titleUrl").alias("url"), get("title", "pageTitle").alias("title"), millis.alias("ms"), "ordinal")
    return out.where("url IS NOT NULL").withColumn("skipped", F.when(F.col("ms").isNull(), "no time"))


def chromium_more(spark: SparkSession, folder: str, since_download: int = 0, since_icon: int = 0) -> dict[str, DataFrame]:
    """downloads, search_terms and favicons after the cursors, as far as they are staged."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}")
    d, k, icons, pages, bitmaps = (read(t) for t in ("downloads", "keyword_search_terms", "favicons", "icon_mapping", "favicon_bitmaps"))
    downloads = d.where(F.col("id") > since_download).select(
        F.col("id").cast("string").alias("source_download_id"), column(d, "guid", "string").alias("guid"), column(d, "current_path", "string").alias("current_path"), F.col("target_path"), chrome_ms(F.col("start_time")).alias("start_ms"),
        F.col("received_bytes").cast("long"), F.col("total_bytes").cast("long"), F.col("state").cast("int"), F.coalesce(F.nullif(column(d, "mime_type", "string"), F.lit("")), column(d, "original_mime_type", "string")).alias("mime_type"),
    )
    terms = k.select(F.col("url_id").alias("source_url_id"), F.col("keyword_id").cast("long"), "term", F.coalesce(column(k, "normalized_term", "string"), F.lower(F.trim("term"))).alias("normalized_term"))
    images = bitmaps.where(F.col("last_updated") > since_icon).select("icon_id", F.col("width").cast("int"), F.col("height").cast("int"), chrome_ms(F.col("last_updated")).alias("last_updated_ms"), "image_data")
    favicons = pages.select("page_url", "icon_id").join(icons.select(F.col("id").alias("icon_id"), F.col("url").alias("icon_url"), F.col("icon_type").cast("int")), "icon_id").join(images, "icon_id").drop("icon_id")
    return {"downloads": downloads, "search_terms": terms, "favicons": favicons}


#: Names of an export's files and top folders; fixed values.
HISTORY_FILES = ("browserhistory.json", "history.json", "verlauf.json")
TYPED_FILES, SESSION_FILES, INDEX_FILES = ("typedurl.json", "typed url.json"), ("session.json", "sessions.json"), ("archive_browser.html", "archiv_übersicht.html")
ACTIVITY = ("my activity/chrome/myactivity", "meine aktivitäten/chrome/meine aktivitäten", "我的活动/chrome/我的活动", "我的活動/chrome/我的活動")
LOOKS_LIKE_HISTORY = ("history", "verlauf", "myactivity", "browser")
OUTSIDE_EN = (
    "access log activity", "android device configuration service", "assistant notes and lists", "blogger", "calendar", "classroom", "cloud print", "contacts", "discover", "drive", "fit", "gmail", "google account", "google business profile", "google chat",
    "google developers", "google finanzas", "google fit", "google my business", "google pay", "google photos", "google play books", "google play games services", "google play movies _ tv", "google play store", "google shopping", "google store",
    "google translator toolkit", "google workspace marketplace", "groups", "home app", "keep", "location history", "mail", "maps", "maps (your places)", "my maps", "news", "profile", "saved", "search contributions", "shopping lists", "tasks", "youtube and youtube music",
)
OUTSIDE_DE = (
    "android-gerätekonfigurationsdienst", "aufgaben", "business messages", "classroom", "discover", "drive", "gespeichert", "gmail", "google chat", "google developers", "google fit", "google finanzen", "google fotos", "google kontakte", "google news",
    "google pay", "google play filme _ serien", "google play store", "google play-spieldienste", "google shopping", "google unternehmensprofil", "google workspace marketplace", "google-hilfe-communities", "google-konto", "groups", "home app", "kalender",
    "location history (timeline)", "maps", "maps (meine orte)", "profil", "search contributions", "tasks", "youtube und youtube music", "zugriffsprotokollaktivitäten",
)


def takeout_kind(path: Column) -> Column:
    """struct(family, disposition, reason) of a file of an export, by its path: what is imported, what only is evidence, what is known and left out, what needs a look."""
    low = F.lower(F.btrim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\s+", " "), F.lit(" /")))
    name, first = F.regexp_extract(low, r"([^/]*)$", 1), F.regexp_extract(low, r"^([^/]*)", 1)
    chrome = F.array_contains(F.split(low, "/"), "chrome")
    ends = lambda kind: reduce(lambda a, b: a | b, [F.endswith(low, F.lit(f"{a}.{kind}")) for a in ACTIVITY])
    like = reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in LOOKS_LIKE_HISTORY])

    def found(family: str, disposition: str, reason: str) -> Column:
        return F.expr(f"named_struct('family', '{family}', 'disposition', '{disposition}', 'reason', '{reason}')")

    return (
        F.when(F.endswith(name, F.lit(".jsonl")), found("jsonl", "will-import", "jsonl-history-fixture"))
        .when(name.isin(*HISTORY_FILES), found("browser-json", "will-import", "chrome-history-json"))
        .when(name.isin(*TYPED_FILES), found("typed-url-json", "known-ignored", "source-evidence-only"))
        .when(name.isin(*SESSION_FILES), found("session-json", "known-ignored", "source-evidence-only"))
        .when(name.isin(*INDEX_FILES), found("takeout-index", "known-ignored", "takeout-index"))
        .when(ends("json"), found("chrome-activity", "needs-review", "chrome-my-activity-json"))
        .when(ends("html"), found("chrome-activity", "needs-review", "chrome-my-activity-html"))
        .when(chrome & like, found("chrome-supporting-file", "needs-review", "unrecognized-history-file"))
        .when(chrome, found("chrome-supporting-file", "known-ignored", "chrome-supporting-file"))
        .when(first.isin("my activity", "meine aktivitäten"), found("google-activity", "known-ignored", "activity-outside-scope"))
        .when(first.isin(*OUTSIDE_EN, *OUTSIDE_DE), found("outside-scope", "known-ignored", "outside-chrome-scope"))
        .when(like, found("unknown-history-like", "needs-review", "unrecognized-history-file"))
        .otherwise(found("outside-scope", "known-ignored", "outside-chrome-scope"))
    )


def takeout_records(texts: DataFrame) -> DataFrame:
    """texts: path, value, the whole texts of export files. One row a record (path, ordinal, value) for takeout(): JSON lines, an array, or an object that holds one.

    The texts are split where they are, by JSON functions; a file is one row, as exports write them.
    """
    text = F.trim("value")
    listed = lambda c: F.from_json(c, "array<string>")
    roots = [F.get_json_object(text, f"$['{k}']") for k in ("BrowserHistory", "Browser History")]
    kind = F.when(F.startswith(text, F.lit("[")), listed(text)).when(F.coalesce(*roots).isNotNull(), listed(F.coalesce(*roots)))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return texts.select("path", F.posexplode(F.coalesce(kind, lines)).alias("ordinal", "value"))


def native_entities(records: DataFrame, kind: str) -> DataFrame:
    """Records of typed URLs or sessions kept as they are: kind, key (of the whole record), payload, and its strings as a map."""
    return records.select(F.lit(kind).alias("kind"), F.sha2("value", 256).alias("key"), F.col("value").alias("payload"), F.from_json("value", "map<string,string>").alias("metadata"))


def inspect(tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """table, column, kind, present, filled: what a staged source has of the columns that are wanted, and how many rows fill each; one pass a table."""
    out = None
    for name, columns in wanted.items():
        df = tables.get(name)
        kinds = dict(df.dtypes) if df is not None else {}
        here = [c for c in columns if c in kinds]
        counts = df.agg(F.lit(name).alias("table"), *[F.count(c).alias(c) for c in here]) if here else None
        for c in columns:
            one = counts.select("table", F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.lit(True).alias("present"), F.col(c).alias("filled")) if c in here else None
            if one is None:
                session = next(iter(tables.values())).sparkSession
                one = session.range(1).select(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("filled"))
            out = one if out is None else out.unionByName(one)
    return out
