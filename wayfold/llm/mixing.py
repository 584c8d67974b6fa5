"""Mixing sources to target weights by hash thresholds (native DataFrame code only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.text import hash60, word_count
from wayfold.llm.thresholds import find_thresholds

#: Production parameters: weights by rank of the source, share of all words, most passes over a source.
WEIGHTS, SHARE, MOST, ROUNDS = (3.0, 1.0, 2.0), 1.5, 2.0, 3


def source_key(source: Column) -> Column:
    """A key that is never null, so that documents without a source form one of their own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: key, source, source_size. Adds target: ``min(most * size, level * weight)``.

    The level is what remains stable when the excess over each cap is shared out again by weight.
    One row a source goes through this window; a source is metadata, not a document.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("key", "source_size", "target")


def plan(slim: DataFrame, rounds: int = ROUNDS, **how) -> DataFrame:
    """slim: key, source, h, w (words). Per source: source_size, target, whole passes and thresholds.

    A source is taken whole ``passes`` times; the rest of its budget goes to the documents below a
    hash threshold. The words still missing then (less than one document) are a budget of their
    own for the documents that fit into it, and so on for ``rounds`` nested budgets.
    """
    sizes = slim.groupBy("key").agg(F.max("source").alias("source"), F.sum("w").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = table(
        targets(sizes, **how).withColumn("passes", passes).withColumn("left0", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix",
    )
    for k in range(rounds):
        free = slim.join(state, "key").where(~taken_below(k) & (F.col("w") <= F.col(f"left{k}"))) if k else slim
        found = find_thresholds(free.select("key", "h", "w"), state.select("key", F.col(f"left{k}").alias("need")), "key")
        found = found.select("key", F.col("thr").alias(f"thr{k}"), "taken")
        state = table(state.join(found, "key").withColumn(f"left{k + 1}", F.col(f"left{k}") - F.col("taken")).drop("taken"), "mix")
    return state


def taken_below(rounds: int) -> Column:
    """Whether one of the first rounds takes a document, from its h and w and its source's plan."""
    out = F.lit(False)
    for k in range(rounds):
        out = out | ((F.col("h") < F.col(f"thr{k}")) & ((F.col("w") <= F.col(f"left{k}")) if k else F.lit(True)))
    return out


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, rounds: int, **how) -> DataFrame:
    """row (all columns of docs), size, source_size, target, passes, taken."""
    own = [source_key(F.col(source_col)).alias("key"), hash60(F.col(id_col)).alias("h"), word_count(F.col(text_col)).alias("w")]
    slim = table(docs.select(own[0], F.col(source_col).cast("string").alias("source"), *own[1:]), "slim")
    state = plan(slim, rounds, **how)
    cols = ["source_size", "target", "passes", *[f"thr{k}" for k in range(rounds)], *[f"left{k}" for k in range(rounds)]]
    # documents in a struct of their own, so that no column of theirs can clash
    joined = docs.select(F.struct(*docs.columns).alias("row"), *own).join(state.select("key", F.struct(*cols).alias("plan")), "key")
    extra = F.lit(False)
    for k in range(rounds):
        extra = extra | ((F.col("h") < F.col(f"plan.thr{k}")) & ((F.col("w") <= F.col(f"plan.left{k}")) if k else F.lit(True)))
    # a document without words fits into every budget, also into those of a source at its cap
    passes = F.least(F.col("plan.passes") + extra.cast("int"), F.lit(math.ceil(how.get("most", MOST))))
    return joined.select("row", F.col("w").alias("size"), F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), passes.alias("passes"), (passes * F.col("w")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rounds: int = ROUNDS, **how) -> DataFrame:
    """Add size, source_size, target, passes (how often the mix takes the document) and taken (words).

    Null or empty texts have size 0; null sources form one source that sorts last; rows of one id
    share a hash and are taken together; an empty table gives no rows. Existing columns of the
    names that are added are replaced, all others are kept. Texts are never shuffled: sources' plans
    join to documents, and Spark broadcasts them while they are below its threshold.
    """
    added = ("size", "source_size", "target", "passes", "taken")
    out = _mixed(docs, id_col, text_col, source_col, rounds, **how)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words have size 0 and are taken as their source is; null sources are one source; rows of one
    id are taken alike. An empty table stays empty; columns stay as they are, whatever their names.
    """
    out = _mixed(docs, "doc_id", "text", "source", ROUNDS).where("passes > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank, 2.0::DOUBLE * source_size AS cap FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER u, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS lv
  FROM w WINDOW u AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN lv * weight <= cap THEN lv END) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
a AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS n0 FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) <= n0 AS k0 FROM a),
b1 AS (SELECT *, n0 - coalesce(sum(CASE WHEN k0 THEN size END) OVER (PARTITION BY source), 0) AS n1 FROM b),
c AS (SELECT *, NOT k0 AND size <= n1 AND sum(CASE WHEN NOT k0 AND size <= n1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= n1 AS k1 FROM b1),
c1 AS (SELECT *, n1 - coalesce(sum(CASE WHEN k1 THEN size END) OVER (PARTITION BY source), 0) AS n2 FROM c),
e AS (SELECT *, NOT k0 AND NOT k1 AND size <= n2 AND sum(CASE WHEN NOT k0 AND NOT k1 AND size <= n2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= n2 AS k2 FROM c1)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((passes + (k0 OR k1 OR k2)::INT) * size)::BIGINT AS taken FROM e
"""
