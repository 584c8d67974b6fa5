"""Sessions and trails that close by event-time timers, and their repair by replay."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import facts, structure
from wayfold.streaming import live

MIN = 60_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "visit_id long, ms long, profile_id string, domain string, url string, search string, engine string, from_visit long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def visits(n, seed):
    r, rows, t = random.Random(seed), [], {"a": 1_700_000_000_000, "b": 1_700_000_000_000}
    for i in range(n):
        p = r.choice("ab")
        t[p] += r.choice([0, MIN, 5 * MIN, 15 * MIN, 15 * MIN + 1, 30 * MIN, 30 * MIN + 1, 90 * MIN])
        rows.append((i, t[p], p, f"d{r.randrange(4)}", f"u{r.randrange(9)}", r.choice(["tea", "apple"]) if r.random() < 0.25 else None, "x", None))
    return rows


def run(spark, path, batches, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{path}/in").withColumn("ts", F.timestamp_millis("ms"))
    q = live.stream_events(stream, late="40 minutes").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name), q.lastProgress


def batch(spark, rows):
    df = structure.sessionize(facts.with_new_domains(spark.createDataFrame(rows, SCHEMA)))
    return df, structure.trail_members(df)


def test_timers_close_sessions_and_empty_the_state(rocks, tmp_path):
    spark, rows = rocks, visits(150, 3)
    rows.sort(key=lambda r: r[1])
    r = random.Random(1)
    shuffled = [x for i in range(0, len(rows), 4) for x in r.sample(rows[i : i + 4], len(rows[i : i + 4]))]  # out of order, but never by more than the watermark allows
    held, parts, top = [], [], 0
    for k in range(0, len(shuffled), 50):
        parts.append(shuffled[k : k + 50])
    end = [(9999, rows[-1][1] + 10**8, "z", "d", "u", None, "x", None)]
    got, progress = run(spark, tmp_path, [*parts, end], "closing")
    seen = got.where("kind = 'visit' AND profile_id <> 'z'").collect()
    late = {x.visit_id for x in got.where("kind = 'late'").collect()}
    assert len(seen) + len(late) == 150 and not {x.visit_id for x in seen} & late
    in_time = [x for x in rows if x[0] not in late]
    df, members = batch(spark, in_time)
    assert {x.visit_id: x.session_id for x in seen} == {x.visit_id: x.session_id for x in df.collect()}
    assert {x.visit_id: (x.trail_id, x.ordinal) for x in seen if x.trail_id} == {x.visit_id: (x.trail_id, x.ordinal) for x in members.collect()}
    closed = {x.session_id: (x.first_ms, x.last_ms, x.visits, x.searches) for x in got.where("kind = 'session'").collect()}
    assert closed == {x.session_id: (x.first_ms, x.last_ms, x.visits, x.searches) for x in structure.sessions(df).collect()}
    held = [s for s in progress["stateOperators"]]
    assert held and sum(s["numRowsTotal"] for s in held) <= 4  # what is left is the visit that ended the stream


def test_late_visits_are_told_and_replayed(rocks, tmp_path):
    spark, rows = rocks, sorted(visits(120, 5), key=lambda r: r[1])
    late = [x for x in rows[:40] if x[0] % 5 == 0]
    kept = [x for x in rows if x not in late]
    end = [(9999, rows[-1][1] + 10**8, "z", "d", "u", None, "x", None)]
    got, _ = run(spark, tmp_path, [kept[:60], kept[60:], late, end], "repair")
    got.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    told = got.where("kind = 'late'").select("profile_id", "ms", "visit_id")
    assert {x.visit_id for x in told.collect()} == {x[0] for x in late}
    build = lambda v: structure.sessions(structure.sessionize(facts.with_new_domains(v))).select("profile_id", "session_id", "first_ms", "last_ms", "visits", "searches")
    streamed = got.where("kind = 'session' AND profile_id <> 'z'").select("profile_id", "session_id", "first_ms", "last_ms", "visits", "searches")
    every = spark.createDataFrame(rows, SCHEMA)
    full = lambda x: sorted(map(tuple, x.collect()))
    assert full(live.replay(streamed, every, told, build)) == full(build(every))
