import random

import numpy as np

from wayfold.llm import contamination as c


def semi_global(passage, region):
    """Least edits between the passage and any part of the region."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(passage, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def least_edits(windows, text):
    """semi_global() of many windows and one text, a row of the full table at a time."""
    out, t = [], np.frombuffer(text, np.uint8)
    steps = np.arange(len(t) + 1)
    for size in {len(w) for w in windows}:
        same = [w for w in windows if len(w) == size]
        rows = np.array([list(w) for w in same], np.uint8)
        cost = np.zeros((len(same), len(t) + 1), np.int32)
        for i in range(size):
            new = np.minimum(cost + 1, 10**6)
            new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + (rows[:, i : i + 1] != t))
            cost = np.minimum.accumulate(new - steps, axis=1) + steps
        out += list(zip(same, cost.min(axis=1), strict=True))
    found = dict(out)
    return [found[w] for w in windows]


def test_many_rows_at_a_time_equal_the_full_table():
    rng = random.Random(4)
    for _ in range(30):
        windows = list({"".join(rng.choice("ab") for _ in range(rng.choice([3, 5]))).encode() for _ in range(6)})
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))).encode()
        assert least_edits(windows, text) == [semi_global(w, text) for w in windows]


def test_alignment_equals_the_full_table():
    rng = random.Random(1)
    for width in (70, 53):
        pairs = [("".join(rng.choice("ab") for _ in range(n)).encode(), "".join(rng.choice("abc") for _ in range(40)).encode()) for n in [*range(1, 13)] * 20]
        passages, regions = np.zeros((len(pairs), 12), np.uint8), np.zeros((len(pairs), 12 + width), np.uint8)
        for i, (p, r) in enumerate(pairs):
            passages[i, : len(p)], regions[i, 12:52] = list(p), list(r)
        best, ends = c.banded(passages, np.array([len(p) for p, _ in pairs]), regions)
        for (p, r), b, e in zip(pairs, best, ends, strict=True):
            assert b == semi_global(p, r) and b == semi_global(p, (bytes(12) + r + bytes(99))[:e])


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, text(30))]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 200))
        if i % 4 == 0:
            raw = list(items[i % 12][1])
            for _ in range(rng.choice([0, 1, len(raw) // 40, len(raw) // 4])):
                raw[rng.randrange(len(raw))] = rng.choice("xyz")
            body = f"{body}. {rng.choice([str.upper, str])(''.join(raw))}\n{text(20)}"
        docs.append((i, body))
    return docs + [(200, None), (201, ""), (None, items[0][1]), (7, items[1][1]), (202, (text(20) + " ") * 2000 + items[2][1])], items


def test_matches_equal_brute_force(spark):
    docs, items = corpus()
    norm = lambda t: " ".join("".join(x if x.isalnum() else " " for x in (t or "").lower()).split())
    want = set()
    for item, t in items:
        raw = norm(t).encode()
        windows = [raw[at : at + width] for width, step in c.WINDOWS for at in c.starts(len(raw), width, step)] if len(raw) >= c.SHORTEST else []
        for d, body in docs:
            text = norm(body).encode()
            if any(w in text for w in windows) or (len(text) < 20000 and any(e <= int(len(w) * c.RATE) for w, e in zip(windows, least_edits(windows, text), strict=True))):
                want.add((d, item))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS id", "3 AS item")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' AS doc_id")
    got = c.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 12
    assert c.contaminated(df.limit(0), bench).count() == 0 and c.contaminated(df, bench.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs[:60], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, c.contaminated(df, bench).collect()), key=str)
    monkeypatch.setattr(c, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, c.contaminated(df, bench).collect()), key=str) == whole


def test_every_short_quote_is_found(spark):
    """Parts of items of the shortest length, at any position, verbatim and edited, against full tables of the parts alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(45))) for i in range(6)]
    docs, want = [], set()
    for n in range(300):
        i = n % 6
        raw = items[i][1]
        at = rng.randrange(len(raw) - 60)
        quote = raw[at : at + 50]
        if n % 3 == 1:
            for _ in range(4):
                k = rng.randrange(50)
                quote = quote[:k] + rng.choice("xyz") + quote[k + 1 :]
        if n % 3 == 2:  # one changed word between two halves
            quote = raw[at : at + 52] + " qqqq" + raw[at + 57 : at + 60]
        fill = lambda: "".join(rng.choice("bcfgjkmpqvwxyz") for _ in range(80))
        text = fill() + quote + fill()
        assert semi_global(raw[at : at + 50], text) <= 4
        docs.append((n, text))
        want.add((n, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in c.contaminated(df, bench).collect()} == want


def test_many_short_rows_and_items_take_bounded_memory():
    import tracemalloc

    rng = random.Random(12)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = c.Items([(i, text(40)) for i in range(5000)])
    docs = [text(14) for _ in range(100_000 // 5)] + [text(5) + " " + bytes(items.data[:150]).decode() for _ in range(5)]
    raw = [d.encode() for d in docs]
    off = np.cumsum([0, *map(len, raw)])
    tracemalloc.start()
    found = [f for _, f in items.regions(np.frombuffer(b"".join(raw), np.uint8), off)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r for f in found for r in f[:, 0]} >= set(range(len(docs) - 5, len(docs)))
    assert peak < 300 << 20


def test_stage_drops_contaminated_rows_of_null_id(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(None, items[0][1]), (1, "clean words"), (2, items[1][1]), (3, None)], "doc_id long, text string").selectExpr("*", "1 AS found_id", "'x' AS _id")
    assert sorted(r.doc_id for r in c.stage(spark, df, str(tmp_path)).collect()) == [1, 3]
