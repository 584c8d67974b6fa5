"""From archive tables to visit facts: search terms, search rules, overrides and the taxonomy applied to visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import sites, taxonomy, urls
from wayfold.functions.taxonomy import Override


def classified_urls(url_rows: DataFrame, terms: DataFrame, overrides: Sequence[Override] = (), rules: Sequence[sites.SearchRule] = sites.SEARCH_RULES) -> DataFrame:
    """url_rows: profile_id, url_id, url, title. terms: profile_id, url_id, term. One row a URL with all that follows from it.

    Adds canonical, domain, category, page, interaction, source, pack, rule, query, engine, name and
    url_tier. Of several terms of a URL the least counts. What rules say depends on the URL alone,
    so it is worked out once a URL, not once a visit.
    """
    first = terms.groupBy("profile_id", "url_id").agg(F.min("term").alias("term"))
    rows, u = urls.with_parts(url_rows.join(first, ["profile_id", "url_id"], "left"), "url")
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("term", F.lit("")), F.coalesce(urls.search_query(u), F.lit("")))
    rows = rows.withColumn("ruled", sites.search_rule(u, rules)).withColumn("said", said)
    rows = rows.withColumn("s", sites.decided_search(u, F.col("term"), F.col("ruled"))).withColumn("t", taxonomy.classify(u, F.col("said"), overrides))
    engine, name = F.col("s.engine"), F.col("s.name")
    for o in reversed(overrides):
        hit = taxonomy.overridden(o, u)
        engine = F.when(hit & F.lit(o.engine is not None), F.lit(o.engine)).otherwise(engine)
        name = F.when(hit & F.lit(o.display_name is not None), F.lit(o.display_name)).otherwise(name)
    none = F.lit(None).cast("string")
    return rows.select(
        "profile_id", "url_id", "url", "title", F.coalesce(urls.normalize(u), u.url).alias("canonical"), u.domain.alias("domain"), "t.category", "t.page", "t.interaction",
        "t.source", "t.pack", "t.rule", F.col("s.query").alias("query"), engine.alias("engine"), name.alias("name"),
        taxonomy.evidence_tier(u, F.col("title"), F.col("term").isNotNull(), none, none).alias("url_tier"),
    )


def visit_facts(visits: DataFrame, known: DataFrame) -> DataFrame:
    """visits: visit_id, profile_id, url_id, ms, from_visit, referrer and more, visible ones. known: from classified_urls.

    One row a visit whose URL is known, with url (canonical), raw_url and the URL's columns; search is
    the query of a search event (a query and an engine), else null; a referrer or a visit before it
    make the evidence tier-a.
    """
    joined = visits.join(known, ["profile_id", "url_id"])
    anchored = F.col("referrer").isNotNull() | F.col("from_visit").isNotNull()
    return joined.withColumnRenamed("url", "raw_url").withColumnRenamed("canonical", "url").withColumns(
        {"search": F.when(F.col("engine").isNotNull(), F.col("query")), "tier": F.when(anchored, "tier-a").otherwise(F.col("url_tier"))}
    ).drop("url_tier")


def orphans(visits: DataFrame, url_rows: DataFrame) -> DataFrame:
    """Per profile: visits whose URL is not in the batch or the archive; they are skipped and counted."""
    return visits.join(url_rows.select("profile_id", "url_id").distinct(), ["profile_id", "url_id"], "left_anti").groupBy("profile_id").agg(F.count("*").alias("skipped"))


def derive(archive: dict[str, DataFrame], overrides: Sequence[Override] = ()) -> DataFrame:
    """Facts of an archive: its visits without those of reverted batches, and its urls and search terms."""
    seen = archive["visits"].join(archive["reverted"].select("batch_id").distinct(), "batch_id", "left_anti")
    return visit_facts(seen, classified_urls(archive["urls"], archive["search_terms"], overrides))
