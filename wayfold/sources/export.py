"""History exports: JSON lines, Markdown, text and HTML, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export(rows: DataFrame, path: str, kind: str) -> None:
    """rows: url, title, ms. kind: jsonl, markdown, text or html; html links only http and https."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    at = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss")
    if kind == "jsonl":
        rows.write.json(path)
        return
    if kind == "markdown":
        line = F.concat(F.lit("- "), at, F.lit(" ["), F.regexp_replace(title, r"([\[\]\\])", r"\\$1"), F.lit("]("), F.replace("url", F.lit(")"), F.lit("%29")), F.lit(")"))
    elif kind == "text":
        line = F.concat_ws("\t", at, title, "url")
    elif kind == "html":
        linked = F.concat(F.lit('<a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(title), F.lit("</a>"))
        line = F.concat(F.lit("<li>"), at, F.lit(" "), F.when(F.col("url").rlike("(?i)^https?://"), linked).otherwise(escape_html(title)), F.lit("</li>"))
    else:
        raise ValueError(f"unknown export: {kind}")
    rows.select(line.alias("value")).write.text(path)


def keep_latest(overlay: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Notes, tags or stars after changes: the newest row of a key by updated_at stays, unless it is deleted."""
    best = overlay.unionByName(changes).groupBy(*key).agg(F.max_by(F.struct(*[c for c in overlay.columns if c not in key]), "updated_at").alias("r"))
    return best.select(*key, "r.*").where(~F.coalesce(F.col("deleted"), F.lit(False)))
