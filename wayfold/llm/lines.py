"""Near-duplicate lines by segment-partition edit join (native DataFrame code only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bitmap
from wayfold.llm.store import table

#: Lines within so many edits are one line; shorter lines than SHORTEST code points only match exactly.
EDITS, SHORTEST = 2, 20
#: Lines that a key may have before its lines are cut again, and how often that is done.
HOT, DEPTH = 512, 4


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n (from 0), line: all lines of all documents, trimmed of blanks; null texts have none."""
    split = F.posexplode(F.split(F.col(text_col), "\n"))
    return docs.select(F.col(id_col).cast("long").alias("doc"), split.alias("n", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\f")))


def signature(line: Column) -> Column:
    """64 parities of words by hash: an edit takes away or adds three words at most, so it flips three bits at most."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(bit(w)))


def letters(line: Column) -> Column:
    """64 parities of characters by code point: an edit takes away and adds one character at most, so it flips two bits at most.

    A shift by n is one by n mod 64; lower-case letters are moved aside, so that they share no bit with digits or marks.
    """
    place = lambda c: c.bitwiseXOR(F.shiftright(c.bitwiseAND(F.lit(64)), 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(F.ascii(c)))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def _place(less: str, i: str, move: str, k: int) -> tuple[str, str, str]:
    """Expressions of the shorter line's length, and of the start and size of a substring."""
    n = f"(len - {less})"
    return n, f"int({n} DIV {k} * {i} + greatest(0, {i} - {k} + {n} % {k}) + 1 + {move})", f"int({n} DIV {k} + int({i} - {k} + {n} % {k} >= 0))"


def own_places(edits: int) -> list[tuple[int, int, int]]:
    """The own segments of a line."""
    return [(0, i, 0) for i in range(edits + 1)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """The substrings that may equal a segment of a line shorter by up to ``edits``.

    A segment's start may have moved by fewer places than there are segments before it, and by
    fewer than there are behind it once the difference in length is taken off.
    """
    places = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            places += [(less, i, move) for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return places


def let(value: Column, body) -> Column:
    """body of a value that is computed once: what a lambda function of higher-order functions refers to from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with alike, by binary search of equal parts."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    shorter = F.least(F.char_length(a), F.char_length(b))

    def longer(n: Column, step: Column) -> Column:
        fits = (n + step <= shorter) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
        return F.when(fits, n + step).otherwise(n)

    return F.aggregate(F.filter(steps, lambda x: x <= shorter), F.lit(0), longer)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings, b not the longer, are within ``edits`` edits.

    What both begin and end with alike is left out first; it changes no distance.
    """
    head = let(common_prefix(a, b), lambda p: F.struct(F.substring(a, p + 1, F.char_length(a)).alias("a"), F.substring(b, p + 1, F.char_length(b)).alias("b")))
    tail = lambda s: let(common_prefix(F.reverse(s.a), F.reverse(s.b)), lambda p: F.struct(F.substring(s.a, F.lit(1), F.char_length(s.a) - p).alias("a"), F.substring(s.b, F.lit(1), F.char_length(s.b) - p).alias("b")))
    chars = lambda s: F.struct(F.split(s.a, "").alias("x"), F.split(s.b, "").alias("y"), F.char_length(s.a).alias("m"), F.char_length(s.b).alias("n"))
    return let(let(let(head, tail), chars), lambda s: F.when(s.n == 0, s.m <= edits).otherwise(_banded(s.x, s.y, s.m, s.n, edits)))


def _banded(x: Column, y: Column, m: Column, n: Column, edits: int) -> Column:
    """Whether the characters x (m of them) and y (n, not more, at least one) are within the edits.

    Bit-parallel over the band of ``2 * edits + 1`` diagonals: bit k of a word stands for row
    ``j - edits + k`` of column j. The score follows the lowest diagonal of the band down to the
    last row of x, and then that row to the end of y.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (2 * edits)
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(long(sum(1 << k for k in range(edits, width))).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("score"))

    def step(s: Column, j: Column) -> Column:
        c = F.get(y, j - 1)
        eq = long(0)
        for k in range(width):
            row = j - edits + k  # from 1
            eq = eq.bitwiseOR(F.when((row >= 1) & (row <= m) & (F.get(x, row - 1) == c), long(1 << k)).otherwise(long(0)))

        def words(e: Column) -> Column:
            d = (e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(e).bitwiseOR(s["vn"]).bitwiseAND(long(mask))
            return F.struct(d.alias("d"), s["vn"].bitwiseOR(long(mask).bitwiseXOR(d.bitwiseOR(s["vp"]))).alias("hp"), d.bitwiseAND(s["vp"]).alias("hn"), F.shiftright(d, 1).alias("down"))

        def move(t: Column) -> Column:
            # the bit of row m, once the band's lowest row would lie below it
            bit = F.call_function("shiftleft", long(1), (m - j + edits).cast("int"))
            score = s["score"] + F.when(j + edits <= m, (t["d"].bitwiseAND(long(top)) == 0).cast("int")).otherwise((t["hp"].bitwiseAND(bit) != 0).cast("int") - (t["hn"].bitwiseAND(bit) != 0).cast("int"))
            return F.struct(t["hn"].bitwiseOR(long(mask).bitwiseXOR(t["down"].bitwiseOR(t["hp"]))).bitwiseAND(long(mask)).alias("vp"), t["down"].bitwiseAND(t["hp"]).alias("vn"), score.alias("score"))

        return let(let(eq, words), move)

    return F.aggregate(F.sequence(F.lit(1), n), start, step)["score"] <= edits


def _keys(texts: DataFrame, places: list[tuple[int, int, int]], edits: int, *columns: str) -> DataFrame:
    """One row a key of each line: id, columns, key, less, own, at, size, left (characters beside the segment in the shorter line).

    Of each place (less, i, move), the key is that of the substring that lies ``move`` places after segment i of a line
    ``less`` shorter would, with that length and i; there is none where the line has no such substring or where only isn't
    null and less isn't that. A line of n characters has ``edits + 1`` segments, the last ones longer by the remainder.
    Places are rows, not one expression each: a method of all of them is too long to be compiled.
    """
    kept = list(dict.fromkeys(("id", "len", "line", "seed", "only", *columns)))
    listed = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(move).alias("move")) for less, i, move in places])
    rows = texts.select(*kept, F.explode(listed).alias("p")).select(*kept, "p.less", "p.i", "p.move")
    n, at, size = _place("less", "i", "move", edits + 1)
    rows = rows.withColumn("at", F.expr(at)).withColumn("size", F.expr(size)).where(f"{n} >= 1 AND at >= 1 AND at + size - 1 <= len AND coalesce(only = less, true)")
    key = F.expr(f"xxhash64(seed, {n}, i, substring(line, at, size))").alias("key")
    return rows.select("id", *columns, key, "less", F.expr("less = 0 AND move = 0").alias("own"), "at", "size", F.expr(f"{n} - size").alias("left"))


def _first_keys(texts: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Probe rows (key, id, less) and index rows (key, id, left) of all lines, without those that have no partner.

    Own keys are counted, and a bitmap of bounded size says which keys any line has and which
    several have; a probe for which it tells nothing goes, and so does an index row for which a
    second one tells no remaining probe. What they let through in vain is left to the joins.
    """
    own = _keys(texts, own_places(edits), edits).select("key", "id", F.when(F.col("size") > 0, F.col("left")).alias("left"))
    counted = own.groupBy(F.col("key").alias("h")).agg(F.count("*").alias("c"))
    some = bitmap.bitmap(counted, {"_any": F.lit(True), "_more": F.col("c") > 1})
    probes = bitmap.probed(_keys(texts, probe_places(edits), edits).select("key", "id", "less", "own"), F.col("key"), some)
    alike = bitmap.known(F.when(F.col("own"), F.col("_more")).otherwise(F.col("_any")), F.col("key"))
    probes = table(probes.where(alike).select("key", "id", "less"), "line-probes")
    asked = bitmap.bitmap(probes.select(F.col("key").alias("h")), {"_asked": F.lit(True)})
    index = bitmap.probed(own, F.col("key"), asked).where(bitmap.known(F.col("_asked"), F.col("key")))
    index = table(index.select("key", "id", "left"), "line-index")
    # what the bitmaps let through in vain goes here, before its lines are looked at
    return table(probes.join(index.select("key").distinct(), "key", "left_semi"), "line-probes"), index


def _rests(texts: DataFrame, places: list[tuple[int, int, int]], edits: int, hot: DataFrame, only: bool) -> DataFrame:
    """Lines that have a hot key, once for each such key: without the substring, as lines of the next level."""
    rest = F.expr("concat(substring(line, 1, at - 1), substring(line, at + size))")
    found = _keys(texts, places, edits, "line", "seed", "only").join(hot, "key", "left_semi")
    return table(found.select("id", F.col("key").alias("seed"), F.when(F.lit(only), F.col("less")).alias("only"), rest.alias("line")).withColumn("len", F.char_length("line")), "line-rests")


def line_links(distinct: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """distinct: id (long), line. Returns a, b: ids of lines within the edits, and both lines.

    A line of n code points is cut into ``edits + 1`` segments; of any line within the edits, some
    segment is a substring of the other near its own place, and what is left of both beside it is
    within the edits too. So keys of segments meet keys of the substrings that may equal them,
    pairs whose parities of letters or words differ too much are left out in the join, and the rest is verified.

    A key that more than ``hot`` lines have isn't joined: what is left of its lines is cut into
    segments again, whose keys include the first one, and so on for ``depth`` levels. Keys that are
    hot even then, of lines that agree in four fifths of their text, are joined as they are.
    """
    texts = distinct.select("id", "line", F.char_length("line").alias("len"), F.lit(0).cast("long").alias("seed"), F.lit(None).cast("int").alias("only")).where(F.col("len") >= shortest)
    probes, index = _first_keys(texts, edits)
    # parities only of lines that have a key in common with another one
    h = F.xxhash64("id")
    met = bitmap.bitmap(probes.select(h.alias("h")).union(index.select(h)), {"_met": F.lit(True)})
    texts = bitmap.probed(texts, h, met).where(bitmap.known(F.col("_met"), h)).drop("_met")
    sigs = F.struct(letters(F.col("line")).alias("letters"), signature(F.col("line")).alias("words"))
    texts = own_texts = probe_texts = table(texts.withColumn("sig", sigs), "line-texts")
    differ = lambda n: F.bit_count(F.col(f"sig_a.{n}").bitwiseXOR(F.col(f"sig_b.{n}")))
    near = (differ("letters") <= 2 * edits) & (differ("words") <= 3 * edits)
    pairs = []
    for level in range(depth + 1):
        deeper = (F.col("c") > hot) & (F.col("left") > edits) & (level < depth)
        common = table(index.groupBy("key").agg(F.count("*").alias("c"), F.first("left").alias("left")).where(deeper).select("key"), "line-hot")
        more = not common.isEmpty()
        rare = (lambda rows: rows.join(common, "key", "left_anti")) if more else (lambda rows: rows)  # noqa: B023
        a = rare(probes).join(texts.select("id", "sig"), "id").select("key", F.col("id").alias("a"), "less", F.col("sig").alias("sig_a"))
        b = rare(index).join(texts.select("id", "sig"), "id").select("key", F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        pairs.append(table(a.join(b, "key").where(near & ((F.col("less") > 0) | (F.col("a") > F.col("b")))).select("a", "b").distinct(), "line-pairs"))
        if not more:
            break
        own_texts = _rests(own_texts, own_places(edits), edits, common, False)
        probe_texts = _rests(probe_texts, probe_places(edits), edits, common, True)
        index = table(_keys(own_texts, own_places(edits), edits).select("key", "id", F.when(F.col("size") > 0, F.col("left")).alias("left")), "line-index")
        probes = table(_keys(probe_texts, probe_places(edits), edits).select("key", "id", "less"), "line-probes")
    both = reduce(DataFrame.unionByName, pairs)
    both = both.distinct() if len(pairs) > 1 else both
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = both.join(side("a"), "a").join(side("b"), "b")
    longer, other = (F.expr(f"CASE WHEN char_length(line_a) >= char_length(line_b) THEN {x} ELSE {y} END") for x, y in (("line_a", "line_b"), ("line_b", "line_a")))
    return both.where(within(longer, other, edits)).select("a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """Return id_col, n_lines, n_kept, n_links, kept_lines: one row per id.

    A line goes if the same line, or another one within the edits, occurred first, at a smaller
    (id, line number); blank lines neither count nor go. Lines under ``shortest`` code points only
    match exactly, as two edits make most short lines alike; 0 compares all. kept_lines are the
    numbers of the lines that stay, from 0, blank ones left out; n_links counts, over the distinct
    lines that first occurred in the document, the other distinct lines within the edits.

    Null and empty texts have no lines; lines of rows that share an id are counted together; rows
    of a null id share one row, which counts lines but lists none (kept_lines is null), as nothing
    bounds it; an empty table gives no rows.
    """
    none = F.lit(-(1 << 63))
    # (id, line number) as one number, so that the least one is found by hash and not by sort
    place = (F.coalesce("doc", none).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("n").cast("decimal(10,0)")).cast("decimal(38,0)")
    found = lines(docs, id_col, text_col).where("line <> ''").groupBy("line").agg(F.min(place).alias("place"))
    distinct = table(found.select(F.monotonically_increasing_id().alias("id"), "line", "place"), "lines")  # ids hold as they are written once
    links = table(line_links(distinct.select("id", "line"), edits, shortest), "line-links")
    first = distinct.select("id", F.struct("place", F.xxhash64("line").alias("h")).alias("at"))
    ends = links.join(first.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(first.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
    ends = ends.select(F.explode(F.array(*[F.struct(F.col(x).alias("id"), (F.col(f"at_{x}") > F.col(f"at_{y}")).alias("later")) for x, y in ("ab", "ba")])).alias("e")).select("e.*")
    linked = ends.groupBy("id").agg(F.max("later").alias("gone"), F.count("*").alias("links"))
    stays = ~F.coalesce("gone", F.lit(False))
    doc = F.floor(F.col("place") / F.lit(1 << 31).cast("decimal(10,0)")).cast("long")
    number = (F.col("place") - F.floor(F.col("place") / F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")).cast("int")
    firsts = distinct.select("id", doc.alias("doc"), number.alias("n")).join(linked, "id", "left")
    kept = firsts.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.when(stays & (F.col("doc") > none), F.col("n")))).alias("kept_lines"), F.sum(stays.cast("long")).alias("n_kept"), F.sum("links").alias("n_links")
    )
    key = F.col(id_col).cast("long")
    total = docs.groupBy(F.coalesce(key, none).alias("doc"), key.alias(id_col)).agg(F.sum(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\r\f\n][^\n]*"))).alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    listed = F.when(F.col(id_col).isNotNull(), F.coalesce("kept_lines", F.array().cast("array<int>")))
    return total.join(kept, "doc", "left").select(id_col, zero("n_lines"), zero("n_kept"), zero("n_links"), listed.alias("kept_lines"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
