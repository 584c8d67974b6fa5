"""History search: filters, query grammar, keyset pages, BM25 over postings, fuzzy and regex recall."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import bounded_distance, trigrams

#: Operators of the grammar, their lists, and how many values one may have; fixed values.
OPERATORS = {"site": "site", "intitle": "title", "title": "title", "inurl": "url", "url": "url", "filetype": "filetype", "ext": "filetype", "tag": "tag", "note": "note"}
MOST_VALUES = 16
PAGE_DEFAULT, PAGE_MOST = 150, 1000
K1, B = 1.2, 0.75


@dataclass
class Query:
    """Words, quoted phrases, excluded words, and wanted and unwanted values of each operator; bounds in UTC milliseconds."""

    words: list[str] = field(default_factory=list)
    exact: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    wanted: dict[str, list[str]] = field(default_factory=dict)
    unwanted: dict[str, list[str]] = field(default_factory=dict)
    after: int | None = None
    before: int | None = None


_PART = re.compile(r'(-?)(?:([A-Za-z]+):)?(?:["“]([^"”]*)["”]|(\S+))')


def _bound(text: str, end: bool) -> int | None:
    """A date or year as milliseconds: its start, or its last millisecond."""
    for form, step in (("%Y-%m-%d", "day"), ("%Y", "year")):
        try:
            at = datetime.strptime(text, form).replace(tzinfo=UTC)
        except ValueError:
            continue
        if end:
            at = (at + timedelta(days=1) if step == "day" else at.replace(year=at.year + 1)) - timedelta(milliseconds=1)
        return round(at.timestamp() * 1000)
    return None


def parse(text: str) -> Query:
    """Read a search line: operators, quotes, a leading minus, after: and before:; the rest is words."""
    out = Query()

    def put(to: list[str], value: str) -> None:
        if value and value not in to and len(to) < MOST_VALUES:
            to.append(value)

    for minus, name, phrase, word in _PART.findall(text):
        value, key = (phrase or word).strip().lower(), name.lower()
        if key in ("after", "before") and (at := _bound(value, key == "before")) is not None:
            setattr(out, key, at)
        elif key in OPERATORS:
            put((out.unwanted if minus else out.wanted).setdefault(OPERATORS[key], []), value)
        else:
            whole = f"{name}:{value}".lower() if name else value
            put(out.without if minus else (out.exact if phrase else out.words), whole)
    return out


def condition(q: Query) -> Column:
    """A predicate over url, title, ms and, where tags or notes are asked for, tags (array) and note."""
    url, title = F.lower("url"), F.lower(F.coalesce(F.col("title"), F.lit("")))
    one = {
        "site": lambda v: F.contains(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(v)),
        "title": lambda v: F.contains(title, F.lit(v)),
        "url": lambda v: F.contains(url, F.lit(v)),
        "filetype": lambda v: url.rlike(rf"\.{re.escape(v)}(?:[?#]|$)"),
        "tag": lambda v: F.array_contains("tags", v),
        "note": lambda v: F.contains(F.lower(F.coalesce(F.col("note"), F.lit(""))), F.lit(v)),
    }
    both = lambda v: F.contains(url, F.lit(v)) | F.contains(title, F.lit(v))
    parts = [one[k](v) for k, vs in q.wanted.items() for v in vs] + [~one[k](v) for k, vs in q.unwanted.items() for v in vs]
    parts += [both(v) for v in [*q.words, *q.exact]] + [~both(v) for v in q.without]
    parts += [F.col("ms") >= q.after] if q.after is not None else []
    parts += [F.col("ms") <= q.before] if q.before is not None else []
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def page(rows: DataFrame, after: tuple[int, int] | None = None, limit: int = PAGE_DEFAULT, newest: bool = True) -> DataFrame:
    """The rows that follow (ms, visit_id) of the last page's end: a filter and a bounded top, without an offset."""
    limit = min(max(limit, 1), PAGE_MOST)
    if after is not None:
        t, i = after
        step = (F.col("ms") < t) | ((F.col("ms") == t) & (F.col("visit_id") < i)) if newest else (F.col("ms") > t) | ((F.col("ms") == t) & (F.col("visit_id") > i))
        rows = rows.where(step)
    return rows.orderBy(*[(F.desc if newest else F.asc)(c) for c in ("ms", "visit_id")]).limit(limit)


def words_of(text_col: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sizes(docs: DataFrame, text_col: str) -> tuple[int, float]:
    """Documents that have words, and their mean number of words: one pass, nothing is shuffled but one line a task."""
    found = docs.select(F.size(words_of(text_col)).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    return found.docs, found.mean or 1.0


def postings(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str] | None = None) -> DataFrame:
    """term, id, tf, size: the inverted index of a table, one row a term and document; of some terms only, if they are given.

    Rows of a document are counted where it is: documents aren't shuffled.
    """
    words = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("words")).withColumn("size", F.size("words"))
    kept = F.filter("words", lambda w: w.isin(*terms)) if terms is not None else F.col("words")
    runs = words.select("id", "size", F.array_sort(kept).alias("words")).withColumn("term", F.explode(F.array_distinct("words")))
    return runs.select("term", "id", F.size(F.filter("words", lambda w: w == F.col("term"))).cast("long").alias("tf"), "size")


def bm25(index: DataFrame, terms: list[str], docs: int, mean_size: float, limit: int) -> DataFrame:
    """The best documents for some terms: id, score. Only the terms' postings are read; df comes from them too."""
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean_size))
    scored = hits.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))  # df: a line for each term asked for
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def fuzzy(rows: DataFrame, id_col: str, text_col: str, wanted: str, limit: int) -> DataFrame:
    """Rows whose words are nearest to a misspelled one: id, word, distance; words must share a trigram with it."""
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"))).alias("word"))
    near = words.where(F.arrays_overlap(trigrams(F.col("word")), trigrams(F.lit(wanted)))).withColumn("distance", bounded_distance(F.col("word"), F.lit(wanted))).where("distance IS NOT NULL")
    best = near.groupBy("id").agg(F.min(F.struct("distance", "word")).alias("m"))
    return best.select("id", "m.word", "m.distance").orderBy("distance", "id").limit(limit)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value_at: str, values: list[str]) -> DataFrame:
    """For each row of left, the values of right's newest row of the key at or before its time.

    Both sides are merged and carried forward in one sorted pass a key: no pair is made. Right rows
    of one time: the greatest values win.
    """
    l_cols = left.columns
    l_rows = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    r_rows = right.select(F.col(key).alias("_k"), F.col(value_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_v")
    carried = l_rows.unionByName(r_rows).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
