"""Hash thresholds that meet a budget, found by refining histograms instead of sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.store import table

#: Keys are 60-bit; each level of a search looks at 12 more bits.
BITS, STEP = 60, 12
TOP = 1 << BITS


def find_thresholds(items: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """For each key, the largest threshold whose smaller items weigh no more than the budget.

    items: key, h (long in [0, 2**60)), w (long >= 0). budgets: key, need (double), one row a key.
    Returns key, thr (long), taken (long: weight of the items with h < thr).

    Each level sums weights by key and 4096 hash buckets (combined map-side), takes the running sum
    over at most 4096 rows a key, and goes on inside the one bucket where the budget runs out; it
    ends when such buckets hold a single hash value. No level sorts or collects items. Items of one
    hash are taken together or not at all; keys without items get the top threshold.
    """
    state = table(
        budgets.select(key, "need", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("prefix"), F.lit(TOP).cast("long").alias("thr"), F.lit(True).alias("open")),
        "thresholds",
    )
    shift = BITS
    while shift > 0:
        step = min(STEP, shift)
        shift -= step
        run = Window.partitionBy(key).orderBy("bucket")
        hist = (
            items.join(state.where("open").select(key, "need", "taken", "prefix"), key)
            .where(F.shiftright("h", shift + step) == F.col("prefix"))
            .groupBy(key, F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("w").alias("w"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("need").alias("need"), F.max("taken").alias("base"))
            .withColumn("before", F.col("base") + F.sum("w").over(run) - F.col("w"))
        )
        cut = F.when((F.col("before") <= F.col("need")) & (F.col("before") + F.col("w") > F.col("need")), F.struct("bucket", "before", "lo", "hi"))
        found = hist.groupBy(key).agg(F.max(cut).alias("cut"), (F.max("base") + F.sum("w")).alias("all"))
        inner = F.col("cut.lo") < F.col("cut.hi")
        state = table(
            state.join(found, key, "left").select(
                key,
                "need",
                F.when(~F.col("open"), F.col("taken")).otherwise(F.coalesce("cut.before", "all", "taken")).alias("taken"),
                F.coalesce("cut.bucket", "prefix").alias("prefix"),
                F.when(F.col("open") & F.col("cut").isNotNull(), F.when(inner, F.shiftleft("cut.bucket", shift)).otherwise(F.col("cut.lo"))).otherwise(F.col("thr")).alias("thr"),
                (F.col("open") & F.col("cut").isNotNull() & F.coalesce(inner, F.lit(False))).alias("open"),
            ),
            "thresholds",
        )
        if state.where("open").isEmpty():
            break
    return state.select(key, "thr", "taken")
