"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.components import components
from wayfold.llm.store import table
from wayfold.llm.tokens import mix64, shingle_sets

#: Production parameters. REGISTERS = BANDS * ROWS; a pair at similarity 0.75 shares no band with
#: probability (1 - 0.75**ROWS)**BANDS = 5e-6 at most.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.75, 32, 4
REGISTERS = BANDS * ROWS
#: Registers hold floor((OFFSET - ln x) / ln BASE), truncated to 0..255, of the minimum x of exponential variates.
BASE, OFFSET = 1.1, 2.0
#: Pairs whose likeliest similarity is this far (4.7 standard errors) below the limit aren't verified.
MARGIN = 0.18
#: Members of a bucket that one task compares, about.
BLOCK = 1024
#: Words (of 63 bits) of the bitmap that keeps texts from being moved in vain.
FILTER_WORDS = 1 << 18

_SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _XOR = _SEEDS[:REGISTERS] | np.uint64(1), _SEEDS[REGISTERS:]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes; sketches merge by the greater of each register."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None]
        np.minimum(low, ((part ^ _XOR) * _MUL).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor((OFFSET - np.log(np.maximum(x, 1e-300))) / np.log(BASE)), 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from its register values and its number. regs: one row a sketch."""
    words = np.ascontiguousarray(regs).view("<u4").astype(np.uint64)
    return mix64(words * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _log_likelihood(grid, plus, minus, equal, na, nb) -> np.ndarray:
    """Of similarities ``grid`` (pairs x values), from the numbers of registers that are greater, less and equal."""
    u = (na / (na + nb))[:, None]
    grid = np.minimum(grid, np.minimum(u / (1 - u), (1 - u) / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return plus[:, None] * log(more) + minus[:, None] * log(less) + equal[:, None] * log(1 - more - less)


def likeliest(plus: np.ndarray, minus: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sketch pairs, of known set sizes, on a grid of 0.01."""
    return _log_likelihood(np.arange(101)[None] / 100, plus, minus, equal, na, nb).argmax(axis=1) / 100


def likely(least: float, plus: np.ndarray, minus: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the likeliest similarity is ``least`` or more: the likelihood has one peak, so two values tell."""
    score = _log_likelihood(np.array([[least - 0.01, least]]), plus, minus, equal, na, nb)
    return score[:, 1] >= score[:, 0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fp, regs = [], [], []
        for s in shingle_sets(batch.column(1), SHINGLE):
            n.append(len(s))
            fp.append((np.add.reduce(mix64(s)), np.bitwise_xor.reduce(mix64(s + np.uint64(7)))) if len(s) else (0, 0))
            regs.append(registers(s))
        if not n:
            continue
        regs = np.stack(regs)
        fp = np.array(fp, np.uint64).view(np.int64).reshape(-1, 2)
        keys = band_keys(regs).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(REGISTERS), len(n), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), raw, bands], ["id", "n", "f0", "f1", "regs", "bands"])


def _likely(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
        yield batch.select(["a", "b"]).filter(pa.array(likely(similarity - MARGIN, (a > b).sum(1), (a < b).sum(1), (a == b).sum(1), na, nb)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), SHINGLE))
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "s"])


def _links_of_block(rows: pa.Table, similarity: float) -> pa.Table:
    """Links that join different components within one block, or between two blocks of one bucket.

    A pair is looked at in the first band that it shares. Of the pairs that sizes and registers
    leave, intersections are counted on the full sets, one member against all at a time.
    """
    ids, root, n, home = (rows.column(c).to_numpy() for c in ("id", "root", "n", "block"))
    band, lo, hi = (rows.column(c)[0].as_py() for c in ("band", "lo", "hi"))
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    words = np.ascontiguousarray(regs).view("<u4")
    sets = rows.column("s").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    cut = sets.offsets.to_numpy()
    cut = cut - cut[0]
    seen, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    group = {r: r for r in root}

    def find(r):
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    out, mark = [], np.zeros(len(seen) + 1, np.int32)
    left, right = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
    for i in left:
        j = right[right > i] if lo == hi else right
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]))]
        j = j[(words[j] == words[i]).argmax(1) == band]
        if not len(j):
            continue
        equal, more = (regs[j] == regs[i]).sum(1), (regs[j] < regs[i]).sum(1)
        j = j[likely(similarity - MARGIN, more, REGISTERS - more - equal, equal, np.full(len(j), n[i], float), n[j].astype(float))]
        mark[flat[cut[i] : cut[i + 1]]] = 1
        for k in j:
            if find(root[i]) != find(root[k]):
                shared = int(mark[flat[cut[k] : cut[k + 1]]].sum())
                if 100 * shared >= round(100 * similarity) * (n[i] + n[k] - shared):
                    group[find(root[i])] = find(root[k])
                    out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
        mark[flat[cut[i] : cut[i + 1]]] = 0
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, s: the full shingle sets of some documents (ids: id), written out.

    Texts are moved to meet the ids only if a bitmap of the ids' hashes, of FILTER_WORDS lines at
    most however many ids there are, doesn't already leave them out.
    """
    ids = table(ids.distinct(), "ids")
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_WORDS * 63))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 63).cast("int"))
    bitmap = ids.select(F.floor(h / 63).alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    some = docs.withColumn("_word", F.floor(h / 63)).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(*docs.columns)
    return table(some.join(ids, "id", "left_semi").mapInArrow(_sets, "id long, s array<long>"), "sets")


def cross_links(members: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components from the buckets whose members, beside their
    smallest one, aren't in one component yet.

    Such a bucket is dealt out in hashed blocks of about BLOCK members, each pair of blocks to a
    task of its own, with the members' registers and full sets: only links leave it, no pairs.
    """
    own = members.where("id <> rep").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    rest = table(own.select("key", "band", "id", "root").join(mixed.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key"), "rest")
    sets = reps.select("id", "n", "regs").join(shingle_table(docs, rest.select("id")).dropDuplicates(["id"]), "id")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rest.select("key", "band", "id", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return dealt.join(sets, "id").groupBy("key", "lo", "hi").applyInArrow(lambda t: _links_of_block(t, similarity), "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    Sizes and the joint likelihood of the registers drop most others first; only documents of
    pairs that remain have their sets built, and only sets of such pairs are moved.
    """
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    left = table(sized.mapInArrow(lambda it: _likely(it, similarity), "a long, b long"), "likely")
    sets = shingle_table(docs, left.select(F.col("a").alias("id")).union(left.select("b")))
    sa, sb = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = left.join(sa, "a").join(sb, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return both.where(100 * F.col("shared") >= round(100 * similarity) * union).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Return id_col, n_shingles, component_id, kept: one row per row of docs.

    Documents of one shingle set form a class that its smallest id stands for. Classes that share a
    band meet in a bucket. There, each member is verified with the smallest one; members that are
    in different components after that are compared by their registers, block by block, and likely
    pairs that are in different components still are verified. So no pair of a bucket is dropped,
    and a group of copies, which the first pass joins, never has all its pairs made. Shingles are
    64-bit hashes, and a set is known by its size and 128 bits of its shingles.

    Null and empty texts and texts of white space have n_shingles 0 and stand alone. Rows of one id
    count as one document of several texts. A row with a null id stands alone, with null
    component_id and kept true. Other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk = table(slim.mapInArrow(_sketch, "id long, n long, f0 long, f1 long, regs binary, bands array<long>"), "sketch")
    full = sk.where("n > 0 AND id IS NOT NULL")
    classes = table(full.groupBy("f0", "f1", "n").agg(F.min("id").alias("rep")), "classes")
    reps = table(full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "regs", "bands"), "reps")
    hits = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = hits.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    members = table(hits.join(buckets, "key").select("key", "band", "id", "rep"), "members")

    stars = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    edges = table(verified(stars, reps, slim, similarity), "links")
    roots = components(edges)
    more = table(cross_links(members, roots, reps, slim, similarity), "links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    out = sk.select("id", "n", "f0", "f1").join(classes, ["f0", "f1", "n"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), root).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    Null ids stay, and so does every row of a kept id; null and empty texts have no group and stay. An empty table
    stays empty; columns stay as they are, whatever their names; texts are taken whole, however long.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_kept"))
    return rows.join(kept, "_kept", "left_semi").select("_row").unionByName(rows.where("_kept IS NULL").select("_row")).select("_row.*")
