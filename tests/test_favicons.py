"""Icons as of a time against a loop over all icons."""

import itertools
import random

import pytest

from wayfold.operators import favicons


def plain(lookup, icons):
    _, profile, url, ms = lookup
    host = url.split("/")[2]
    for tier, (same_profile, of_page) in enumerate(((True, True), (False, True), (True, False), (False, False))):
        fit = [i for i in icons if i[7] is not None and (ms <= 0 or i[4] <= ms) and ((i[1] == profile) == same_profile) and (i[2] == url if of_page else i[3] == host and i[2] != url)]
        if fit:
            return tier, max(fit, key=lambda i: (i[4], i[5], i[6], i[0]))[7]
    return None, None


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_icons_equal_a_loop_over_all(spark, parts):
    r = random.Random(int(parts))
    page = lambda: f"https://{r.choice(['hot.org', 'hot.org', 'hot.org', 'b.org', 'c.org'])}/{r.randrange(6)}"
    icons = []
    for i in range(500):
        p = page()
        icons.append((f"{i:05d}", r.choice("xyz"), p, p.split("/")[2], r.randrange(400), r.choice([16, 32]), r.choice([16, 32]), f"blob{i}" if r.random() > 0.1 else None))
    lookups = [(i, r.choice("xyzw"), page() if r.random() > 0.05 else "https://none.org/", r.choice([0, -5, *[r.randrange(420) for _ in range(8)]])) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        had = spark.createDataFrame(icons, "id string, profile_id string, page_url string, page_host string, last_updated_ms long, width int, height int, blob string")
        want = spark.createDataFrame(lookups, "id long, profile_id string, url string, ms long")
        got = {x.lookup: (x.tier, x.blob) for x in favicons.favicons_of(want, had).collect()}
        assert favicons.favicons_of(want, had.limit(0)).where("blob IS NULL").count() == 300 and favicons.favicons_of(want.limit(0), had).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {x[0]: plain(x, icons) for x in lookups}


def test_six_icons_are_enough():
    r, longest = random.Random(3), 0
    for _ in range(3000):
        icons = [(str(i), r.choice("pqrs"), r.choice("uvwx")) for i in range(r.randint(0, 14))]
        for tier in range(4):
            kept = favicons.needed(icons, tier)
            longest = max(longest, len(kept))
            for p, u in itertools.product("pqrst", "uvwxy"):
                first = lambda some: next((i for i in some if not favicons.blocked(i, tier, p, u)), None)
                assert first(kept) == first(icons)
    assert longest <= 6


def test_ranges_inside_a_series_start_with_what_was_before():
    a, b = ("1", "p", "u"), ("2", "q", "u")
    got = favicons.carried([(2, "1u", True, [b]), (0, "1u", False, [a]), (1, "1u", True, []), (3, "1v", False, [])])
    assert got == {0: (None, []), 1: ("1u", [a]), 2: ("1u", [a]), 3: ("1u", [b, a])}
