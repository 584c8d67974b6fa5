"""Families, sources, habits, digests and evidence against loops and literal values."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql.functions import lit

from wayfold.operators import facts, families, ingest, structure

DAY = 86_400_000


def asked(n, seed, words, profiles=("p",), engines=("g",)):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice([1, 1, 2, 2, 3, 3, 4, 5, 7, 12])
        terms = sorted({("topic" if r.random() < 0.3 else f"w{int(words * r.random() ** 2)}") for _ in range(k)})
        rows.append((r.choice(profiles), r.choice(engines), i * 3 % 100_003, i * 1000, " ".join(terms), " ".join(terms), terms if r.random() > 0.03 else []))
    return rows


def loop(rows):
    anchors, out, number = {}, {}, {}
    for p, e, visit, _, _, _, terms in sorted(rows, key=lambda x: x[2]):
        if not terms:
            continue
        t = frozenset(terms)
        own = anchors.setdefault((p, e), [])
        hit = next((f for a, f in own if t <= a or a <= t or 2 * len(a & t) >= len(a | t)), None)
        if hit is None:
            number[p] = number.get(p, 0) + 1
            hit = f"family:{p}:{number[p]:04d}"
            own.append((t, hit))
        out[p, visit] = hit
    return out


EVENTS = "profile_id string, engine string, visit_id long, ms long, raw_query string, normalized_query string, terms array<string>"


@pytest.mark.parametrize(("n", "words", "first"), [(400, 12, 16), (400, 60, 1000), (500, 25, 7)])
def test_families_equal_a_loop(spark, n, words, first):
    rows = asked(n, n + words, words, ("p", "q"), ("g", "b"))
    got = families.query_families(spark.createDataFrame(rows, EVENTS), first=first)
    assert {(r.profile_id, r.visit_id): r.family_id for r in got.collect()} == loop(rows)


def test_families_of_one_profile_with_ten_thousand_searches(spark):
    rows = asked(10_000, 5, 900)
    got = families.query_families(spark.createDataFrame(rows, EVENTS))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    want = loop(rows)
    assert {(r.profile_id, r.visit_id): r.family_id for r in got.collect()} == want and len(set(want.values())) > 500


def test_families_without_searches(spark):
    assert families.query_families(spark.createDataFrame([], EVENTS)).count() == 0
    assert families.query_families(spark.createDataFrame([("p", "g", 1, 1, "the", "the", [])], EVENTS)).count() == 0


def test_family_rows_and_reopened(spark):
    rows = [("p", "g", 1, 50, "Red Apple", "red apple", ["apple", "red"]), ("p", "g", 2, 90, "red  apple", "red apple", ["apple", "red"]), ("p", "g", 4, 70, "apple", "apple", ["apple"]), ("p", "g", 5, 10, "pear", "pear", ["pear"])]
    fam = families.family_rows(families.query_families(spark.createDataFrame(rows, EVENTS)))
    got = sorted(map(tuple, fam.collect()))
    assert got == [("p", "g", "family:p:0001", "Red Apple", 3, 2, 50, 90), ("p", "g", "family:p:0002", "pear", 1, 1, 10, 10)]
    refinds = spark.createDataFrame([("p", "u1", 3, 1, 9), ("p", "u2", 1, 1, 9)], "profile_id string, url string, days long, first_ms long, last_ms long")
    titles = spark.createDataFrame([("p", "u1", None), ("p", "u2", "T")], "profile_id string, url string, title string")
    again = sorted(map(tuple, structure.reopened(fam, refinds, titles).collect()))
    assert again == [
        ("reopened:p:family:p:0001", "p", "query_family", "family:p:0001", "Red Apple", 3, 2, 50, 90),
        ("reopened:p:u1", "p", "reference_page", "u1", "u1", 3, 3, 1, 9),
    ]


def test_every_trail_that_landed_counts_for_its_source(spark):
    trails = spark.createDataFrame([("p", "t1", "a.org", 2, 5), ("p", "t2", "a.org", 1, 9), ("p", "t3", None, 0, 1)], "profile_id string, trail_id string, landing_domain string, first_ms long, last_ms long")
    refinds = spark.createDataFrame([("p", "a.org"), ("p", "b.org"), ("p", "b.org")], "profile_id string, domain string")
    got = {r.domain: (r.landings, r.trails, r.refs, r.first_ms, r.last_ms, r.score, r.role) for r in structure.source_effectiveness(trails, refinds).collect()}
    assert got == {"a.org": (2, 2, 1, 1, 9, 6.5, "landing"), "b.org": (0, 0, 2, 0, 0, 3.0, "reference")}


def test_hub_pages_count_searches_and_keep_to_the_range(spark):
    rows = [("u1", "a", "t1", 10, "A"), ("u1", "a", "t2", 11, "B"), ("u2", "b", "t1", 12, None), ("u3", "c", "t9", 99, None)]
    df = spark.createDataFrame(rows, "url string, domain string, trail_id string, ms long, title string")
    assert [tuple(r) for r in structure.hub_pages(df, 10, 99).collect()] == [("u1", "a", "B", 2), ("u2", "b", None, 1)]


@pytest.mark.parametrize(("gaps", "kind"), [([7] * 4, "weekly_habit"), ([1] * 15, "daily_habit"), ([12, 11, 13, 12], "periodic_reference"), ([7] * 3, None), ([3] * 4, None), ([3] * 8, None)])
def test_habits_need_days_a_span_and_a_rhythm(spark, gaps, kind):
    days = [datetime(2024, 1, 1)]
    for g in gaps:
        days.append(days[-1] + timedelta(days=g))
    ms = [int((d - datetime(1970, 1, 1)).total_seconds() * 1000) for d in days]
    df = spark.createDataFrame([("p", "d", m) for m in ms], "profile_id string, domain string, ms long")
    mean = sum(gaps) * DAY // len(gaps)
    for now, late in ((ms[-1] + 2 * mean, False), (ms[-1] + 2 * mean + 1, True)):
        got = structure.habits(df, now).collect()
        assert [(r.kind, r.days, r.interrupted) for r in got] == ([(kind, len(days), late)] if kind else [])


def test_digest_counts_deep_dives_where_they_begin(spark):
    summary = spark.createDataFrame([("2024-01-01", 5, 1, 2), ("2024-01-02", 7, 2, 0), ("2024-01-03", 100, 9, 9)], "date_key string, visits long, searches long, new_domains long")
    day = lambda k: 1704067200000 + (k - 1) * DAY
    sessions = spark.createDataFrame([(day(2), True), (day(2) - 1, True), (day(2) + 5, False), (day(1) - 1, True)], "first_ms long, deep_dive boolean")
    refinds = spark.createDataFrame([(day(1), day(2)), (day(3), day(3)), (day(1), day(2) - 1)], "first_ms long, last_ms long")
    got = {r.kpi: (r.now, r.before, r.change, r.direction) for r in structure.digest(summary, sessions, refinds, ("2024-01-02", "2024-01-02"), ("2024-01-01", "2024-01-01")).collect()}
    assert got == {"total_visits": (7, 5, 2, "up"), "total_searches": (2, 1, 1, "up"), "new_domains": (0, 2, -2, "down"), "deep_read_pages": (1, 1, 0, "flat"), "refind_pages": (1, 2, -1, "down")}


def test_observed_interactions(spark):
    e = [("p", "1", "engagement.total_view_time_ms", 5, None, 1), ("p", "1", "engagement.visit_duration_ms", None, 7.5, 2), ("p", "1", "engagement.load_successful", 0, None, 3), ("p", "1", "engagement.what", 9, None, 4), ("p", "2", "engagement.what", 1, None, 5), ("p", "4", "engagement.scrolling_distance_px", 3, 9.0, 6)]
    c = [("p", "1", "context.load_successful", "true", 1), ("p", "3", "context.load_successful", "true", 2), ("p", "3", "context.page_end_reason", '"say \\"x\\""', 3), ("p", "4", "context.page_end_reason", "null", 4), ("p", "5", "context.load_successful", "broken", 5)]
    got = ingest.observed_interactions(spark.createDataFrame(e, "profile_id string, source_id string, metric_key string, value_int long, value_real double, arrival long"), spark.createDataFrame(c, "profile_id string, source_id string, context_key string, value_json string, arrival long"))
    assert sorted(map(tuple, got.collect())) == [
        ("p", "1", 8, None, None, None, None, False, None), ("p", "3", None, None, None, None, None, True, 'say "x"'), ("p", "4", None, None, 3, None, None, None, None),
    ]


def test_a_session_without_pauses_is_sorted_by_hours(spark):
    """Members of trails and flows of one session of ten hours equal those counted in order; no window or depth takes a whole session."""
    rnd, ms, rows = random.Random(5), 0, []
    for i in range(400):
        ms += rnd.choice((0, 20_000, 60_000, 60_000, 200_000, 950_000))
        rows.append((i, "p", ms, rnd.choice("abc") + ".com", "q" if rnd.random() < 0.12 else None, i - 1 if i % 3 else None))
    visits = spark.createDataFrame(rows, "visit_id long, profile_id string, ms long, domain string, search string, from_visit long").withColumn("session_id", lit("s")).withColumn("is_new_domain", lit(0))
    want, trail, at, last = {}, None, 0, None
    for i, _, t, _, q, _ in rows:
        if q is not None:
            trail, at = i, 0
        elif last is not None and t - last > structure.TRAIL_GAP_MS:
            trail = None
        if trail is not None:
            want[i] = (f"trail:p:{trail}", at)
            at += 1
        last = t
    members = structure.trail_members(visits)
    assert {r.visit_id: (r.trail_id, r.ordinal) for r in members.collect()} == want
    ends = [r for i, r in enumerate(rows) if i == len(rows) - 1 or rows[i + 1][3] != r[3]]
    for steps in (2, 4):
        flows = {}
        for i in range(len(ends) - steps + 1):
            key = " → ".join(r[3] for r in ends[i : i + steps])
            n, seen = flows.get(key, (0, 0))
            flows[key] = n + 1, max(seen, ends[i + steps - 1][2])
        assert {r.pattern: (r.occurrences, r.last_ms) for r in structure.path_flows(visits, steps).collect()} == flows
    assert structure.sessions(visits).first().depth == sum(r[5] is not None for r in rows)
    for df in (members, structure.path_flows(visits, 3), structure.sessions(visits)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        wide = [x for x in plan.splitlines() if "Window [" in x and "visit_id" in x and "slot_" not in x]
        assert not wide


def test_compare_sets_send_and_expand_nothing_large(spark):
    cols = "profile_id string, trail_id string, page string, ordinal int, ms long, url string, domain string, raw_url string, visit_id long"
    row = lambda t, i, p, d: ("a", t, "repo", i, i * 1000, f"https://{d}/{p}", d, f"https://{d}/{p}", i)
    rows = [row("t1", i, p, "x.org") for i, p in enumerate(["a/1", "b/1", "a/1"])] + [row("t2", i, "a/1", d) for i, d in enumerate(["x.org", "y.org", "x.org", "y.org"])] + [row("t3", i, p, "x.org") for i, p in enumerate(["a/1", "a/2", "a/1"])] + [row("t4", 0, "a/1", "x.org")]
    sets = structure.compare_sets(spark.createDataFrame(rows, cols))
    got = {r.trail_id: (r.pages, r.domains, r.alternations, r.siblings) for r in sets.collect()}
    assert got == {"t1": (2, 1, 2, 2), "t2": (2, 2, 3, 0)}
    expanded = [x for x in _plan(sets).split("\n") if "Expand" in x]
    assert expanded and not any("prefix" in x or "turned" in x for x in expanded), expanded  # distinct counts are made of kept sets


def test_refinds_never_send_members(spark):
    cols = "visit_id long, profile_id string, url string, domain string, ms long, from_visit long, search string"
    visits = spark.createDataFrame([(1, "a", "u", "d", 0, None, None), (2, "a", "u", "d", 90_000_000, 1, None)], cols)
    found = structure.refind_pages(visits, spark.createDataFrame([(2, "t")], "visit_id long, trail_id string"))
    assert [(r.days, r.trails, r.visits) for r in found.collect()] == [(2, 1, 2)]
    assert "ResolvedHint (strategy=merge)" in found._jdf.queryExecution().analyzed().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("gap", [0, 1, 7, 1000])
def test_sessions_by_stretches_equal_a_loop(spark, gap):
    r = random.Random(gap)
    rows = sorted({(r.choice("pq"), r.choice([-9, 0, 4]) * 10**4 + r.randrange(0, 40 * (gap + 1), r.choice([1, gap or 1])), i) for i in range(300)})
    want, last, begun = {}, {}, {}
    for p, ms, i in rows:
        if p not in last or ms - last[p] > gap:
            begun[p] = i
        last[p], want[i] = ms, f"session:{p}:{begun[p]}"
    df = spark.createDataFrame(rows, "profile_id string, ms long, visit_id long")
    spans = structure.session_spans(df, gap)
    assert {x.visit_id: x.session_id for x in structure.in_sessions(df, spans, gap).collect()} == want
    assert "SortAggregate" not in spans._jdf.queryExecution().executedPlan().toString()


def test_first_visits_to_domains_are_found_by_hash(spark):
    big = 2**62
    rows = [("p", "a", 5, 9), ("p", "a", 5, -big), ("p", "a", 6, -big - 1), ("p", "b", -7, 3), ("p", "b", -7, 2), ("q", "a", 1, big), (None, None, 3, 1), (None, None, 4, 0)]
    got = facts.with_new_domains(spark.createDataFrame(rows, "profile_id string, domain string, ms long, visit_id long"))
    assert sorted((r.ms, r.visit_id) for r in got.collect() if r.is_new_domain) == [(-7, 2), (1, big), (3, 1), (5, -big)]
    assert got.count() == 8 and "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
