import random
import re

from pyspark.sql import functions as F

from wayfold.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, k):
    text = list(text)
    for _ in range(k):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcé")
        elif kind == 1 and len(text) > 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcé"))
    return "".join(text)


def test_banded_bits_equal_the_full_table(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 30)))
        b = edited(rng, a, rng.randrange(0, 5))
        a, b = sorted((a, b), key=len, reverse=True)
        if b and len(a) - len(b) <= 3:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        got = df.select("a", "b", lines.within(F.col("a"), F.col("b"), k).alias("ok")).collect()
        for r in got:
            if len(r.a) - len(r.b) <= k:
                assert r.ok == (distance(r.a, r.b) <= k), (r, k, distance(r.a, r.b))


def brute(rows, edits, shortest=lines.SHORTEST):
    first, count, n = {}, {}, {}
    for doc, text in sorted((r for r in rows), key=lambda r: r[0]):
        n.setdefault(doc, 0)
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\f")
            if line:
                n[doc] += 1
                first.setdefault(line, (doc, i))
    own = list(first.items())
    gone, links = set(), {}
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                gone.add(max(x, y))
                for z in (x[0], y[0]):
                    links[z] = links.get(z, 0) + 1
    kept = {}
    for place in first.values():
        if place not in gone:
            kept.setdefault(place[0], []).append(place[1])
    return {d: (n[d], sorted(kept.get(d, [])), links.get(d, 0)) for d in n}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 19, 20, 21, 33, 60, 120]))) for _ in range(25)]
    rows = []
    for d in range(60):
        text = "\n".join(edited(rng, x, rng.randrange(0, 4)) if rng.random() < 0.7 and x else x for x in rng.choices(base, k=rng.randrange(0, 6)))
        rows.append((d, text))
    rows += [(100, None), (101, ""), (102, "\n \n\t"), (103, rows[3][1]), (104, "x" * 5000 + "\n" + "x" * 5001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS line", "2 AS id")
    got = {r.doc_id: (r.n_lines, r.kept_lines, r.n_links) for r in lines.dedup_lines(df).collect()}
    assert got == brute(rows, lines.EDITS)


def test_short_lines_and_common_segments_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = [(d, "\n".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(3))) for d in range(25)]
    # most lines share all but a few characters, so that their keys are cut again and again
    rows += [(100 + d, edited(rng, f"the same notice at the foot of every page, number {rng.randrange(10**5)} of this site", rng.randrange(0, 2))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = df.selectExpr("explode(split(text, '\n')) AS line").distinct().selectExpr("monotonically_increasing_id() AS id", "line").collect()
    own = spark.createDataFrame(first, "id long, line string")
    want = {tuple(sorted((x.id, y.id))) for x in first for y in first if x.id < y.id and distance(x.line, y.line) <= 2}
    for hot in (3, 1000):
        got = lines.line_links(own, 2, shortest=0, hot=hot).collect()
        assert len(got) == len(want) and {tuple(sorted((r.a, r.b))) for r in got} == want, hot
    got = {r.doc_id: (r.n_lines, r.kept_lines, r.n_links) for r in lines.dedup_lines(df, shortest=0).collect()}
    assert got == brute(rows, lines.EDITS, 0)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a line of twenty-odd letters"), (None, "b line of twenty-odd letters"), (1, "a line of twenty-odd letters")], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_kept) for r in lines.dedup_lines(df).collect()} == {None: (2, 1), 1: (1, 0)}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_letters_see_all_characters_and_flip_two_bits_at_most(spark):
    rng = random.Random(5)
    texts = ["дождь идёт над городом", "Zug 17 fährt, 18 nicht", "雨が降る日", "a𝄞b", ""] + ["".join(rng.choice("abzAZ09 .жé雨𝄞") for _ in range(30)) for _ in range(200)]
    rows = [(t, edited(rng, t, 1) if t else "x") for t in texts]
    flips = F.bit_count(lines.letters(F.col("a")).bitwiseXOR(lines.letters(F.col("b"))))
    assert max(r.flips for r in spark.createDataFrame(rows, "a string, b string").select(flips.alias("flips")).collect()) <= 2
    # lines of other scripts are told apart too
    apart = spark.createDataFrame([("дождь идёт над городом", "снег лежит под мостами"), ("n", "."), ("雨", "日")], "a string, b string")
    assert all(r.flips > 0 for r in apart.select(flips.alias("flips")).collect())


def test_keys_of_many_places_are_compiled(spark, capsys):
    texts = spark.range(3).select("id", F.lit("a line of some length").alias("line"), F.lit(21).alias("len"), F.lit(0).cast("long").alias("seed"), F.lit(None).cast("int").alias("only"))
    lines._keys(texts, lines.probe_places(2), 2).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000, sizes  # the JVM leaves longer methods interpreted
