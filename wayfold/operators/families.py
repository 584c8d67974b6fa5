"""Greedy families of queries without a loop: the first query of a family is one that no earlier family matches.

Two sets of terms match if the smaller lies within the larger or they share a third of the sum of their
sizes (Jaccard 1/2): with s <= t terms, if they share at least min(s, ceil((s + t) / 3)). So they share one
of their rarest terms, as many as their sizes leave free, and only those are looked up.

Sets are taken in order, a prefix at a time that doubles. Of a prefix, a set is an anchor once all earlier
ones that match it are known not to be, and none once one of them is an anchor; these rounds end when all are
settled. All later sets that match its anchors are settled with it, so that what remains gets sparse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.store import table

#: Sets of the first prefix, over all groups, and digits that a family's number has at least.
FIRST, DIGITS = 4096, 4
_ID = ["profile_id", "engine", "at"]


def _shared(s: Column, t: Column) -> Column:
    """Terms that sets of these sizes share at least if they match."""
    return F.least(s, t, F.ceil((s + t) / 3)).cast("int")


def _keys(sets: DataFrame, side: str) -> dict[str, DataFrame]:
    """Rows by which matches are found: like sizes by their rarest terms, a small set by its rarest term, a large one by all."""
    sized = sets.withColumn("s", F.size("terms"))
    own = [F.col("profile_id"), F.col("engine"), F.col("at").alias(f"{side}_at"), F.col("terms").alias(f"{side}_terms")]
    near = sized.withColumn("t", F.explode(F.sequence(F.ceil(F.col("s") / 2).cast("int"), 2 * F.col("s"))))
    near = near.withColumn("term", F.explode(F.slice("terms", F.lit(1), F.col("s") - _shared(F.col("s"), F.col("t")) + 1)))
    return {
        "near": near.select(*own, "term", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), F.col("s").alias(f"{side}_s")),
        "small": sized.select(*own, F.get("terms", F.lit(0)).alias("term"), F.col("s").alias(f"{side}_s")),
        "large": sized.select(*own, F.explode("terms").alias("term"), F.col("s").alias(f"{side}_s")),
    }


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """profile_id, engine, a_at, b_at of sets of left and later ones of right that match. terms: rarest first."""
    a, b = _keys(left, "a"), _keys(right, "b")
    by = ["profile_id", "engine", "term"]
    found = [
        a["near"].join(b["near"], [*by, "lo", "hi"]).where("a_at < b_at AND a_s + b_s = lo + hi"),
        a["small"].join(b["large"], by).where("a_at < b_at AND b_s > 2 * a_s"),
        a["large"].join(b["small"], by).where("a_at < b_at AND a_s > 2 * b_s"),
    ]
    need = _shared(F.size("a_terms"), F.size("b_terms"))
    kept = [x.where(F.size(F.array_intersect("a_terms", "b_terms")) >= need).select("profile_id", "engine", "a_at", "b_at") for x in found]
    return reduce(DataFrame.unionByName, kept).distinct()


def _settle(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors of some sets (_ID), and the anchor of each other (at, anchor)."""
    edges = table(matches(sets, sets), "family-edges")
    state = table(sets.select(*_ID, F.lit(None).cast("boolean").alias("anchor")), "family-state")
    while True:
        earlier = state.select("profile_id", "engine", F.col("at").alias("a_at"), F.col("anchor").alias("a_anchor"))
        told = edges.join(earlier, ["profile_id", "engine", "a_at"]).groupBy("profile_id", "engine", F.col("b_at").alias("at"))
        told = told.agg(F.coalesce(F.max("a_anchor"), F.lit(False)).alias("met"), F.min(F.col("a_anchor").isNotNull()).alias("known"))
        news = F.when(F.coalesce("met", F.lit(False)), False).when(F.coalesce("known", F.lit(True)), True)
        state = table(state.join(told, _ID, "left").select(*_ID, F.coalesce("anchor", news).alias("anchor")), "family-state")
        if state.where("anchor IS NULL").isEmpty():
            break
    anchors = state.where("anchor").select(*_ID)
    first = edges.join(anchors.withColumnRenamed("at", "a_at"), ["profile_id", "engine", "a_at"]).groupBy("profile_id", "engine", F.col("b_at").alias("at")).agg(F.min("a_at").alias("anchor"))
    return anchors, first.join(anchors, _ID, "left_anti")


def anchors_of(sets: DataFrame, first: int = FIRST) -> DataFrame:
    """sets: profile_id, engine, at (its place in the order), terms (distinct). Adds anchor: the place of its family's first set."""
    rarity = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    flat = sets.select(*_ID, F.explode("terms").alias("term")).join(rarity, "term")
    rest = flat.groupBy(*_ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    rest = table(rest, "family-sets")
    out, left, share = [], rest.count(), 1.0
    most = max(left, 1)
    while left:
        share = min(1.0, first / most)
        upto = rest.agg(F.percentile_approx("at", share, 10000)).first()[0] if share < 1 else None
        now = rest.where(F.col("at") <= upto) if upto is not None else rest
        anchors, members = _settle(now)
        out += [anchors.withColumn("anchor", F.col("at")), members]
        if upto is None:
            break
        later = rest.where(F.col("at") > upto)
        gone = table(matches(now.join(anchors, _ID, "left_semi"), later).groupBy("profile_id", "engine", F.col("b_at").alias("at")).agg(F.min("a_at").alias("anchor")), "family-members")
        out.append(gone)
        rest = table(later.join(gone, _ID, "left_anti"), "family-sets")
        left, first = rest.count(), first * 2
        most = max(left, 1)
    if not out:
        return rest.select(*_ID, F.col("at").alias("anchor"))
    return reduce(DataFrame.unionByName, out)


def query_families(events: DataFrame, first: int = FIRST) -> DataFrame:
    """events: of structure.search_events. profile_id, engine, visit_id, ms, raw_query, normalized_query, family_id of each search by keywords.

    A search joins the first family of its profile and engine whose first search matches its terms, in the order
    of visits, else begins one; families are numbered within a profile in that order.
    """
    asked = events.where(F.size("terms") > 0)
    sets = asked.groupBy("profile_id", "engine", "terms").agg(F.min("visit_id").alias("at"))
    placed = table(sets.join(anchors_of(sets, first), _ID), "families")
    # numbers within a profile: counted by blocks of ids first, so that no task sorts all families of one
    block = F.floor(F.col("at") / 65536).alias("block")
    begun = placed.where("at = anchor").select("profile_id", "at", block)
    from_ = begun.groupBy("profile_id", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("profile_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    from_ = from_.select("profile_id", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("profile_id", "block").orderBy("at"))
    numbered = begun.join(from_, ["profile_id", "block"]).select("profile_id", F.col("at").alias("anchor"), number.alias("number"))
    digits = F.when(F.col("number") < 10**DIGITS, F.lpad(F.col("number").cast("string"), DIGITS, "0")).otherwise(F.col("number").cast("string"))
    named = placed.join(numbered, ["profile_id", "anchor"]).select("profile_id", "engine", "terms", F.concat_ws(":", F.lit("family"), "profile_id", digits).alias("family_id"))
    return asked.join(named, ["profile_id", "engine", "terms"]).select("profile_id", "engine", "visit_id", "ms", "raw_query", "normalized_query", "family_id")


def family_rows(members: DataFrame) -> DataFrame:
    """One row a family: its first search, members, different queries, and times (the first is that of the first search)."""
    first = F.min_by(F.struct("raw_query", "ms"), "visit_id").alias("first")
    out = members.groupBy("profile_id", "engine", "family_id").agg(first, F.count("*").alias("members"), F.count_distinct("normalized_query").alias("queries"), F.max("ms").alias("last_ms"))
    return out.select("profile_id", "engine", "family_id", F.col("first.raw_query").alias("anchor_query"), "members", "queries", F.col("first.ms").alias("first_ms"), "last_ms")


def detail(members: DataFrame, trails: DataFrame) -> DataFrame:
    """Searches of a family in order: time since the one before, and the landing of the trail each began."""
    own = members.withColumn("trail_id", F.concat_ws(":", F.lit("trail"), "profile_id", F.col("visit_id").cast("string")))
    since = F.col("ms") - F.lag("ms").over(Window.partitionBy("profile_id", "family_id").orderBy("visit_id"))
    out = own.join(trails.select("trail_id", "landing_domain", "landing_url"), "trail_id", "left")
    return out.select("family_id", "visit_id", "ms", "raw_query", since.alias("since_ms"), "landing_domain", "landing_url")
