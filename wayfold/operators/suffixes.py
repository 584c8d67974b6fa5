"""Registrable domains under a table of public-suffix rules: plain ones, wildcards and exceptions, private ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import urls


def parsed(rules: DataFrame) -> DataFrame:
    """rules: rule, as lists have them (``co.uk``, ``*.ck``, ``!www.ck``; comments and blank lines don't count). Returns tail, extra, exception.

    ``tail`` are the labels that are written out; a wildcard takes ``extra`` = 1 label more.
    """
    rule = F.lower(F.trim(F.regexp_extract("rule", r"^\s*(\S*)", 1)))
    rows = rules.select(rule.alias("r")).where("r <> '' AND NOT startswith(r, '//')").distinct()
    tail = F.regexp_replace("r", r"^(!|\*\.)", "")
    return rows.select(F.rtrim(tail, F.lit(".")).alias("tail"), F.startswith("r", F.lit("*.")).cast("int").alias("extra"), F.startswith("r", F.lit("!")).alias("exception")).distinct()


def with_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host", name: str = "domain") -> DataFrame:
    """hosts and their registrable domain: one label more than the longest public suffix that fits.

    An exception goes before all others, and its own labels are the domain. A host that is a public suffix itself, or that
    no rule fits, has what urls.registrable_domain says; so has one for which that has more labels. Each
    distinct host joins its tails (``a.b.c``, ``b.c``, ``c``) to the rules' labels, whatever the number of rules; null hosts stay null.
    """
    low = F.rtrim(F.lower(F.trim(F.col(host_col))), F.lit("."))
    distinct = hosts.select(low.alias("_host")).where("_host <> ''").distinct()
    labels = F.split("_host", r"\.")
    tails = distinct.select("_host", F.size(labels).alias("_n"), F.posexplode(labels).alias("_at", "_label")).select("_host", "_n", (F.col("_n") - F.col("_at")).alias("_size"), F.array_join(F.slice(labels, F.col("_at") + 1, F.col("_n")), ".").alias("tail"))
    hit = tails.join(parsed(rules), "tail")
    length = F.when(F.col("exception"), F.col("_size") - 1).otherwise(F.col("_size") + F.col("extra"))
    best = F.max(F.when(F.col("exception") | (length <= F.col("_n")), F.struct(F.col("exception").cast("int").alias("x"), length.alias("length"))))
    found = hit.groupBy("_host", "_n").agg(best.alias("b")).where("b.length < _n")
    listed = F.array_join(F.slice(labels, F.col("_n") - F.col("b.length"), F.col("b.length") + 1), ".")
    plain = urls.registrable_domain(F.col("_host"))
    more = F.size(F.split(listed, r"\.")) < F.size(F.split(plain, r"\."))
    told = found.select("_host", F.when(more, plain).otherwise(listed).alias("_listed"))
    out = hosts.select(F.struct(*hosts.columns).alias("_row"), low.alias("_host")).join(told, "_host", "left")
    domain = F.coalesce("_listed", F.when(F.col("_host") != "", plain).otherwise(F.col("_host")))
    return out.select(*[F.col("_row")[c].alias(c) for c in hosts.columns if c != name], domain.alias(name))
