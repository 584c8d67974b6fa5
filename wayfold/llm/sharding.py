"""Shards as leaves of a k-d tree that is split at distributed weighted medians."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.text import hash60
from wayfold.llm.thresholds import find_thresholds

SHARDS = 8
#: A group of equal texts that holds more than this share of a shard's target is placed by itself;
#: there are at most SHARDS / HEAVY of them. Larger ones than a whole target are cut into such parts.
HEAVY = 0.05
#: Rows that one sort for slot numbers holds, about.
SLOT_ROWS = 20_000
#: Coordinates are 36-bit; 24 bits of a hash below them tell atoms of one coordinate apart.
COORD = 36


def atoms(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int, float]:
    """docs: id, text, src, lang. Returns slim rows (atom, id, size, crc), atoms (atom, w, coordinates), rows, target bytes.

    An atom is a group of equal texts, or a hashed part of one that alone exceeds a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(
        docs.select(
            F.md5(text).alias("group"),
            "id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.when(F.col("text").isNotNull(), F.crc32("text")).otherwise(F.crc32(F.lit(""))).alias("crc"),
            F.pmod(F.xxhash64("src"), F.lit(1 << 20)).alias("src"),
            F.pmod(F.xxhash64("lang"), F.lit(1 << 20)).alias("lang"),
        ),
        "shard-slim",
    )
    groups = slim.groupBy("group").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    total = groups.agg(F.sum("w"), F.sum("n")).first()
    target = (total[0] or 0) / shards
    big = groups.where(F.col("w") > target).select("group", F.ceil(F.col("w") / max(HEAVY * target, 1.0)).alias("parts"))
    cut = slim.join(F.broadcast(big), "group", "left")  # fewer lines than shards
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "size"), F.coalesce("parts", F.lit(1))))
    rows = table(cut.select(F.concat_ws(":", "group", part.cast("string")).alias("atom"), "id", "size", "crc", "src", "lang"), "shard-rows")
    found = rows.groupBy("atom").agg(
        F.sum("size").alias("w"), F.min("id").alias("id"), F.max("size").alias("len"), F.min("src").alias("src"), F.min("lang").alias("lang")
    )
    return rows, table(found, "shard-atoms"), total[1] or 0, target


def place_heavy(weights: list[tuple[str, int]], shards: int, target: float) -> tuple[dict[str, int], list[float]]:
    """Largest first into the emptiest shard: the shard of each, and the bytes that each shard has left."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for atom, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        used, s = heapq.heappop(heap)
        where[atom] = s
        heapq.heappush(heap, (used + w, s))
    used = dict((s, u) for u, s in heap)
    return where, [max(target - used[s], 0.0) for s in range(shards)]


def leaves(light: DataFrame, room: list[float]) -> DataFrame:
    """light: atom, w, id, len, src, lang. Adds shard: the leaf of the k-d tree; leaf s takes its share ``room[s]``.

    A node stands for a run of leaves, the larger half of which goes to the left; nodes are split until each stands
    for one leaf, which then has its target. Every level splits all nodes at once: each along the
    dimension that is widest in it as a share of its range over all atoms, at the weighted quantile
    that divides its weight like the room of the leaves on either side, found by histograms
    (nothing is sorted or collected but one line a node).
    """
    dims = ["id", "len", "src", "lang"]
    span = light.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = float((1 << COORD) - 1)
    unit = [
        F.coalesce(F.floor((F.col(d).cast("double") - float(span[f"lo_{d}"] or 0)) / max(float(span[f"hi_{d}"] or 0) - float(span[f"lo_{d}"] or 0), 1.0) * top), F.lit(0)).cast("long").alias(d)
        for d in dims
    ]
    # a node is named by its first leaf
    cur = light.select("atom", "w", *unit, F.shiftright(hash60(F.col("atom")), COORD).alias("tie"), F.lit(0).alias("node"))
    runs = {0: len(room)}
    while max(runs.values()) > 1:
        wide = F.greatest(*[F.struct((F.max(d) - F.min(d)).alias("width"), F.lit(-i).alias("order")) for i, d in enumerate(dims)])
        nodes = cur.groupBy("node").agg(F.sum("w").alias("all"), wide.getField("order").alias("dim")).collect()  # at most one line a shard
        plan = []
        for r in nodes:
            many = runs[r.node]
            left = (many + 1) // 2
            mine = room[r.node : r.node + many]
            share = 1.0 if many == 1 else sum(mine[:left]) / sum(mine) if sum(mine) > 0 else left / many
            plan.append((r.node, -r.dim, float(r["all"]) * share if many > 1 else float(1 << 62), left if many > 1 else 0))
        if not plan:
            break
        plan = cur.sparkSession.createDataFrame(plan, "node int, dim int, need double, right int")
        coord = F.element_at(F.array(*dims), F.col("dim") + 1)
        items = table(cur.join(F.broadcast(plan), "node").withColumn("h", F.shiftleft(coord, 60 - COORD) + F.col("tie")).drop("dim", "need"), "kd")
        thr = find_thresholds(items.select("node", "h", "w"), plan.select("node", "need"), "node").select("node", "thr")
        cur = items.join(F.broadcast(thr), "node").withColumn("node", (F.col("node") + F.when(F.col("h") >= F.col("thr"), F.col("right")).otherwise(0)).cast("int")).drop("h", "thr", "right")
        runs = {k: v for node, many in runs.items() for k, v in ([(node, (many + 1) // 2), (node + (many + 1) // 2, many // 2)] if many > 1 else [(node, 1)])}
    return cur.select("atom", F.col("node").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """Return id_col, size, text_crc32, shard, slot: one row per row of docs; any number of shards.

    Size is the UTF-8 bytes of the text plus 1 (null: none). Shards get nearly equal bytes, equal
    texts share a shard unless they alone exceed one, and slots run from 0 without gaps: hashed
    sub-ranges of a shard are counted first, so no task sorts a whole shard. Null ids, sources and
    languages are values of their own; rows repeated with one id get slots of their own; an empty
    table gives no rows.
    """
    columns = [F.col(c).cast("string").alias(n) if c in docs.columns else F.lit(None).cast("string").alias(n) for c, n in zip(dims, ("src", "lang"), strict=True)]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *columns)
    rows, found, count, target = atoms(slim, shards)
    heavy = [(r.atom, r.w) for r in found.where(F.col("w") > HEAVY * target).select("atom", "w").collect()]  # at most shards / HEAVY
    where, room = place_heavy(heavy, shards, target)
    light = leaves(found.where(F.col("w") <= HEAVY * target), room)
    fixed = rows.sparkSession.createDataFrame(list(where.items()), "atom string, shard int")
    placed = rows.select("atom", "id", "size", "crc").join(light.unionByName(fixed), "atom")
    parts = max(1, -(-count // (SLOT_ROWS * shards)))
    placed = table(placed.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(parts)).cast("int")), "placed")
    sizes = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("shard", "part").orderBy("id", "crc", "size")
    out = placed.join(sizes, ["shard", "part"]).withColumn("slot", F.col("before") + F.row_number().over(own) - 1)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; ids repeated by the mix get one slot each."""
    out = shard(docs).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    number = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(*k))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    # the documents in a struct of their own, so that no column of theirs can clash
    left = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("_crc")).withColumn("_n", number("_id", "_crc"))
    right = out.withColumn("_m", number("_id", "_crc"))
    on = left["_id"].eqNullSafe(right["_id"]) & (left["_crc"] == right["_crc"]) & (left["_n"] == right["_m"])
    return left.join(right, on).select("_row.*", "shard", "slot")
