"""Stage control: each mode, each reason for a full build, and tables equal to full runs."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import facts, stages, structure

DAY = 86_400_000
FACTS = "visit_id long, profile_id string, url_id long, ms long, from_visit long, search string, engine string, domain string, url string, category string"


def visits(spark, n=120, seed=1):
    r, rows, t = random.Random(seed), [], {"a": 0, "b": 0, "c": 0}
    for i in range(1, n):
        p = r.choice("abc")
        t[p] += r.choice([1, 10, 40, 600]) * 60_000
        d = r.randrange(4)
        rows.append((i, p, d, 1_700_000_000_000 + t[p], i - 1 if r.random() < 0.5 else None, "q" if r.random() < 0.2 else None, "g", f"d{d}", f"u{d}", r.choice(["docs", "news"])))
    return facts.with_new_domains(spark.createDataFrame(rows, FACTS)).cache()


def marks(spark, v, urls=None, terms=3):
    urls = urls if urls is not None else v.groupBy("profile_id", "url_id").agg(F.max("ms").alias("last_ms"))
    said = spark.createDataFrame([(p, i) for p in "abc" for i in range(terms)], "profile_id string, i long")
    return stages.watermarks(v, urls, said, spark.createDataFrame([(p,) for p in "abc"], "profile_id string"))


def modes(done):
    return {r.profile_id: (r.mode, r.reason) for r in done.collect()}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


BUILDS = {"daily-rollup": (stages.daily, facts.domain_rollup), "structural-rebuild": (stages.structural, lambda v: structure.sessions(structure.sessionize(v)))}


@pytest.mark.parametrize("stage", list(BUILDS))
def test_modes_and_tables(spark, tmp_path, stage):
    build, full = BUILDS[stage]
    folder, v = str(tmp_path), visits(spark)
    first = v.where("visit_id <= 60")
    assert modes(stages.run(folder, stage, marks(spark, first), first, build)) == dict.fromkeys("abc", (stages.FULL, stages.MISSING))
    # two profiles grow, one stays
    second = v.where("visit_id <= 60 OR profile_id <> 'c'")
    done = stages.run(folder, stage, marks(spark, second), second, build)
    assert modes(done) == {"a": (stages.INCREMENTAL, None), "b": (stages.INCREMENTAL, None), "c": (stages.NOOP, None)}
    want = second.where("visit_id > 60").groupBy("profile_id").agg(F.min("ms").alias("ms"))
    assert {r.profile_id: r.dirty_from_ms for r in done.where("dirty_from_ms IS NOT NULL").collect()} == {r.profile_id: r.ms for r in want.collect()}
    table, _ = stages.load(spark, folder, stage)
    assert rows(table) == rows(full(second))
    # nothing new: the table stays where it is
    again = stages.run(folder, stage, marks(spark, second), second, build)
    assert modes(again) == dict.fromkeys("abc", (stages.NOOP, None)) and again.first().path == done.first().path
    # visits of one profile go: counts fall, and only it is built anew
    third = second.where("NOT (profile_id = 'b' AND visit_id % 7 = 0)")
    assert modes(stages.run(folder, stage, marks(spark, third), third, build)) == {"a": (stages.NOOP, None), "b": (stages.FULL, stages.REGRESSED), "c": (stages.NOOP, None)}
    assert rows(stages.load(spark, folder, stage)[0]) == rows(full(third))
    # a profile without visits loses its rows, once
    fourth = third.where("profile_id <> 'a'")
    assert modes(stages.run(folder, stage, marks(spark, fourth), fourth, build))["a"] == (stages.NOOP, None)
    table, kept = stages.load(spark, folder, stage)
    assert rows(table) == rows(full(fourth)) and table.where("profile_id = 'a'").count() == 0
    assert stages.run(folder, stage, marks(spark, fourth), fourth, build).first().path == kept.first().path


def test_reasons_for_a_full_build(spark, tmp_path):
    folder, v, stage = str(tmp_path), visits(spark), "daily-rollup"
    v = v.where("profile_id = 'a'")
    urls = v.groupBy("profile_id", "url_id").agg(F.max("ms").alias("last_ms"))
    first = v.where("visit_id <= 60")
    run = lambda rows, **how: modes(stages.run(folder, stage, how.pop("marks", marks(spark, rows)), rows, stages.daily, **how))["a"]
    assert run(first) == (stages.FULL, stages.MISSING)
    assert run(first, force=True) == (stages.FULL, stages.FORCED)
    assert run(first, version="v9") == (stages.FULL, stages.VERSION)
    assert run(first, version="v9", marks=marks(spark, first, terms=2)) == (stages.FULL, stages.REGRESSED)
    assert run(first, version="v9", marks=marks(spark, first, terms=5)) == (stages.FULL, stages.MISMATCH)  # more terms without a visit
    late = first.where("visit_id <> 60 AND visit_id % 5 > 0").unionByName(v.where("visit_id > 60"))  # old visits went while more came
    assert late.count() > first.count() and run(late, version="v9", marks=marks(spark, late, urls, terms=5)) == (stages.FULL, stages.MISMATCH)
    assert rows(stages.load(spark, folder, stage)[0]) == rows(facts.domain_rollup(late))


def test_facts_are_derived_for_new_visits_only(spark, tmp_path):
    v, asked = visits(spark).select("visit_id", "profile_id", "url_id", "ms", "domain"), []

    def derive(some):
        asked.append(sorted(r.visit_id for r in some.collect()))
        return some.withColumn("fact", F.col("visit_id") * 2)

    build = lambda stored, rows, how: stages.derived(stored, rows, how, derive)
    first = v.where("visit_id <= 60")
    stages.run(str(tmp_path), "visit-derive", marks(spark, first), first, build)
    stages.run(str(tmp_path), "visit-derive", marks(spark, v), v, build)
    assert asked == [list(range(1, 61)), list(range(61, 120))]
    assert rows(stages.load(spark, str(tmp_path), "visit-derive")[0]) == rows(v.withColumn("fact", F.col("visit_id") * 2))


def test_a_run_that_breaks_off_leaves_the_last_table(spark, tmp_path):
    v = visits(spark).where("visit_id <= 50")
    stages.run(str(tmp_path), "daily-rollup", marks(spark, v), v, stages.daily)

    def broken(stored, rows, how):
        raise RuntimeError

    more = visits(spark)
    with pytest.raises(RuntimeError):
        stages.run(str(tmp_path), "daily-rollup", marks(spark, more), more, broken)
    assert rows(stages.load(spark, str(tmp_path), "daily-rollup")[0]) == rows(facts.domain_rollup(v))
