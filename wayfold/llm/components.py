"""Connected components by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.store import table


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, undirected; loops and repeats do no harm). Returns node, root.

    root is the smallest node that can be reached; nodes without edges aren't returned. Each round
    hooks every node to its smallest neighbour, follows that pointer once more, and contracts the
    edges, until none is left. Hooks are map-side combined minima, so a hub costs no more than any
    other node; what remains shrinks at least by the nodes that were hooked.
    """
    cur = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = cur.select(F.col("a").alias("node")).union(cur.select("b")).distinct()
    out = nodes.withColumn("root", F.col("node"))
    while not cur.isEmpty():
        both = cur.select(F.col("b").alias("src"), F.col("a").alias("dst"))
        hook = both.groupBy("src").agg(F.min("dst").alias("nxt"))
        again = hook.select(F.col("src").alias("nxt"), F.col("nxt").alias("far"))
        hook = table(hook.join(again, "nxt", "left").select("src", F.coalesce("far", "nxt").alias("nxt")), "hooks")
        ha, hb = (hook.select(F.col("src").alias(x), F.col("nxt").alias(f"{x}_nxt")) for x in "ab")
        moved = cur.join(ha, "a", "left").join(hb, "b", "left").select(F.coalesce("a_nxt", "a").alias("a"), F.coalesce("b_nxt", "b").alias("b"))
        cur = table(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        hr = hook.select(F.col("src").alias("root"), "nxt")
        out = table(out.join(hr, "root", "left").select("node", F.coalesce("nxt", "root").alias("root")), "roots")
    return out
