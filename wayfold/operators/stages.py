"""Rebuild stages that know what they were built from: nothing, the new part, or all of a profile is built again.

A stage's checkpoint has, by profile, its version and four counts of the archive. From these and the visits
that came since, every profile is put into one of three modes; one plan then builds the new table for all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import facts, structure
from wayfold.streaming import live

#: Versions of what the stages compute; a change of one has its stage built anew. Fixed values.
VERSIONS = {"visit-derive": "visit-derived-facts-v2", "daily-rollup": "daily-rollups-v2", "structural-rebuild": "structural-rebuild-v2"}
MARKS = ("visits", "max_visit_id", "max_last_ms", "terms")
NOOP, INCREMENTAL, FULL = "noop", "incremental", "fallback-full"
#: Why a profile is built anew.
FORCED, MISSING, VERSION, REGRESSED, MISMATCH = "forced", "no checkpoint", "version changed", "counts went backwards", "delta doesn't match"
CHECKPOINT = "run int, stage string, profile_id string, version string, visits long, max_visit_id long, max_last_ms long, terms long, mode string, reason string, dirty_from_ms long, dirty_date_key string, path string"


def watermarks(visits: DataFrame, urls: DataFrame, terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile_id and MARKS: visible visits, the greatest visit id, the last time of a visited URL, visible search terms; 0 without any."""
    seen = visits.groupBy("profile_id", "url_id").agg(F.count("*").alias("n"), F.max("visit_id").alias("top"))
    by_profile = seen.join(urls.select("profile_id", "url_id", "last_ms"), ["profile_id", "url_id"]).groupBy("profile_id")
    counts = by_profile.agg(F.sum("n").alias("visits"), F.max("top").alias("max_visit_id"), F.max("last_ms").alias("max_last_ms"))
    said = terms.groupBy("profile_id").agg(F.count("*").alias("terms"))
    return profiles.select("profile_id").distinct().join(counts, "profile_id", "left").join(said, "profile_id", "left").fillna(0, list(MARKS)).select("profile_id", *MARKS)


def decide(marks: DataFrame, checkpoints: DataFrame, visits: DataFrame, version: str, force: bool = False) -> DataFrame:
    """marks with mode, reason (of a full build) and last (the greatest visit id that was built before).

    checkpoints: profile_id, version and MARKS of the last run. visits: profile_id, visit_id, visible ones; those after
    ``last`` have to be as many as the counts grew by. Equal counts need nothing; a profile without visits has its rows removed.
    """
    old = checkpoints.select("profile_id", F.col("version").alias("_version"), *[F.col(m).alias(f"_{m}") for m in MARKS])
    both = marks.join(old, "profile_id", "left")
    came = visits.join(old.select("profile_id", "_max_visit_id"), "profile_id").where("visit_id > _max_visit_id").groupBy("profile_id").agg(F.count("*").alias("_came"))
    both = both.join(came, "profile_id", "left").fillna(0, ["_came"])
    back, same = F.lit(False), F.lit(True)
    for m in MARKS:
        back, same = back | (F.col(m) < F.col(f"_{m}")), same & (F.col(m) == F.col(f"_{m}"))
    reason = F.when(F.lit(force), FORCED).when(F.col("_version").isNull(), MISSING).when(F.col("_version") != version, VERSION).when(back, REGRESSED)
    grown = (F.col("_came") > 0) & (F.col("_came") == F.col("visits") - F.col("_visits"))
    reason = F.when(F.col("visits") > 0, F.coalesce(reason, F.when(~same & ~grown, MISMATCH)))
    mode = F.when(F.col("visits") == 0, NOOP).when(reason.isNotNull(), FULL).when(same, NOOP).otherwise(INCREMENTAL)
    return both.select("profile_id", *MARKS, mode.alias("mode"), reason.alias("reason"), F.coalesce("_max_visit_id", F.lit(0)).alias("last"))


def _of(rows: DataFrame, modes: DataFrame, *wanted: str) -> DataFrame:
    return rows.join(modes.where(F.col("mode").isin(*wanted)).select("profile_id"), "profile_id", "left_semi")


def _new(visits: DataFrame, modes: DataFrame) -> DataFrame:
    """Visits after a checkpoint, of profiles that grow."""
    return visits.join(modes.where(F.col("mode") == INCREMENTAL).select("profile_id", "last"), "profile_id").where("visit_id > last").drop("last")


def _kept(stored: DataFrame, modes: DataFrame) -> DataFrame:
    """Stored rows of profiles that need nothing; those without visits lose theirs."""
    return stored.join(modes.where((F.col("mode") == NOOP) & (F.col("visits") > 0)).select("profile_id"), "profile_id", "left_semi")


def derived(stored: DataFrame | None, visits: DataFrame, modes: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Visit facts: new visits are derived and added; a profile that is built anew is derived whole."""
    fresh = derive(_new(visits, modes).unionByName(_of(visits, modes, FULL)))
    return fresh if stored is None else _kept(stored, modes).unionByName(_of(stored, modes, INCREMENTAL)).unionByName(fresh.select(*stored.columns))


def daily(stored: DataFrame | None, visits: DataFrame, modes: DataFrame) -> DataFrame:
    """Domain rollups of visit facts: of a profile that grows, the days of its new visits are counted again and the others stay."""
    days = _new(visits, modes).select("profile_id", "date_key").distinct()
    again = visits.join(days, ["profile_id", "date_key"], "left_semi").unionByName(_of(visits, modes, FULL))
    fresh = facts.domain_rollup(again)
    if stored is None:
        return fresh
    stay = _of(stored, modes, INCREMENTAL).join(days, ["profile_id", "date_key"], "left_anti")
    return _kept(stored, modes).unionByName(stay).unionByName(fresh.select(*stored.columns))


def structural(stored: DataFrame | None, visits: DataFrame, modes: DataFrame) -> DataFrame:
    """Sessions of visit facts: of a profile that grows, those from the first session that a new visit touches on are built again."""
    build = lambda rows: structure.sessions(structure.sessionize(rows))
    if stored is None:
        return build(_of(visits, modes, FULL))
    changed = _new(visits, modes).select("profile_id", "ms")
    tail = live.replay(_of(stored, modes, INCREMENTAL), _of(visits, modes, INCREMENTAL), changed, build)
    return _kept(stored, modes).unionByName(tail).unionByName(build(_of(visits, modes, FULL)).select(*stored.columns))


def _checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(CHECKPOINT).parquet(f"{folder}/checkpoints")
    except AnalysisException:
        return spark.createDataFrame([], CHECKPOINT)


def load(spark: SparkSession, folder: str, stage: str) -> tuple[DataFrame | None, DataFrame]:
    """A stage's table as of its last finished run (None before the first), and the checkpoints of that run."""
    own = _checkpoints(spark, folder).where(F.col("stage") == stage)
    last = own.agg(F.max("run")).first()[0]
    if last is None:
        return None, own
    now = own.where(F.col("run") == last)
    return spark.read.parquet(now.first().path), now


def run(folder: str, stage: str, marks: DataFrame, visits: DataFrame, build: Callable[[DataFrame | None, DataFrame, DataFrame], DataFrame], version: str | None = None, force: bool = False) -> DataFrame:
    """Bring a stage's table up to the archive; returns its checkpoints: what was done for each profile, and why.

    build (derived with its function, daily or structural) makes the new table from the stored one, visits and modes. It is
    written to a folder of its own; the checkpoints come last, so a run that breaks off leaves what was there before.
    If no profile needs anything, nothing is written but the checkpoints. A stored table of another version isn't read.
    """
    spark, version = visits.sparkSession, version or VERSIONS[stage]
    stored, before = load(spark, folder, stage)
    number = (before.agg(F.max("run")).first()[0] or 0) + 1
    modes = decide(marks, before, visits.select("profile_id", "visit_id"), version, force)
    modes = spark.createDataFrame(modes.collect(), modes.schema)  # a line a profile
    idle = stored is not None and modes.where((F.col("mode") != NOOP) | ((F.col("visits") == 0) & (F.col("last") > 0))).isEmpty()
    path = before.first().path if idle else f"{folder}/{stage}/run-{number:06d}-{uuid.uuid4().hex}"
    if not idle:
        usable = stored if stored is not None and not before.where(F.col("version") == version).isEmpty() else None
        build(usable, visits, modes).write.parquet(path)
    dirty = _new(visits, modes).groupBy("profile_id").agg(F.min("ms").alias("dirty_from_ms"), F.min(facts.day(F.col("ms"))).alias("dirty_date_key"))
    done = modes.join(dirty, "profile_id", "left").select(F.lit(number).alias("run"), F.lit(stage).alias("stage"), "profile_id", F.lit(version).alias("version"), *MARKS, "mode", "reason", "dirty_from_ms", "dirty_date_key", F.lit(path).alias("path"))
    spark.createDataFrame(done.collect(), CHECKPOINT).coalesce(1).write.mode("append").parquet(f"{folder}/checkpoints")
    return load(spark, folder, stage)[1]
