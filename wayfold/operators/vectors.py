"""Vector search: binary and int8 planes, two-stage top-k, rank fusion, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least size of the first stage's pool, and its multiple of k.
POOL, POOL_FACTOR = 2000, 8
RRF_K = 60
STAR_BOOST, STAR_MOST = 0.15, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def binarize(v: Column) -> Column:
    """Sign bits (1 for x >= 0), 32 to a word, as longs."""
    def word(w: Column) -> Column:
        part = F.slice(v, w * 32 + 1, F.lit(32))
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x >= 0).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantize(v: Column) -> Column:
    """struct(scale, codes): scale = max|x| / 127, codes rounded half away from zero; a zero vector has scale 0."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    codes = F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.least(F.greatest(F.round(x.cast("double") / scale), F.lit(-127)), F.lit(127))).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def two_stage_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", pool: int = POOL) -> DataFrame:
    """The k nearest by int8 dot product among the pool nearest by sign bits: id, score. Ties by id.

    Both stages are bounded tops, which each task takes before anything is moved.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    pool = max(pool, POOL_FACTOR * k)
    first = vectors.select(F.col(id_col), F.col(vec_col), hamming(binarize(F.col(vec_col)), binarize(asked)).alias("bits")).orderBy("bits", id_col).limit(pool)
    q = quantize(F.col(vec_col))
    scored = first.withColumn("q", q).select(F.col(id_col), (dot(F.col("q.codes"), asked) * F.col("q.scale")).alias("score"))
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), id_col).limit(k)


def fuse(lists: list[tuple[DataFrame, float]], key: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 0): the best rank of a key in each list counts."""
    parts = None
    for i, (ranked, weight) in enumerate(lists):
        one = ranked.groupBy(key).agg(F.min("rank").alias("rank")).select(key, (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"), F.lit(i).alias("list"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def starred_boost(scored: DataFrame, starred: DataFrame, key: str, boost: float = STAR_BOOST) -> DataFrame:
    """Scores as a share of the best, and the boost on top for starred keys."""
    top = scored.agg(F.max("score").alias("top"))
    stars = starred.select(key).distinct().withColumn("star", F.lit(True))
    out = scored.crossJoin(F.broadcast(top)).join(stars, key, "left")  # top: one line
    plus = F.when(F.col("star"), min(boost, STAR_MOST)).otherwise(0.0)
    return out.withColumn("score", F.round(F.when(F.col("top") == 0, 0.0).otherwise(F.col("score") / F.col("top")) + plus, 6)).drop("top", "star")


def working_set(pages: DataFrame, limit: int) -> DataFrame:
    """pages: url, starred, recent, annotated, visits. The best by 100 for a star, 10 if recent, 25 for a note, 5 ln(1 + visits)."""
    score = 100 * F.col("starred").cast("int") + 10 * F.col("recent").cast("int") + 25 * F.col("annotated").cast("int") + 5 * F.log1p("visits")
    return pages.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "url").limit(limit)


def latest(vectors: DataFrame, key: str, seq: str) -> DataFrame:
    """Last writer wins."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return vectors.withColumn("_r", r).where("_r = 1").drop("_r")


def index_candidates(pages: DataFrame, stored: DataFrame, after_visit: int) -> DataFrame:
    """pages: url, hash, seen (last visit). Those seen after the watermark, and those whose stored hash is another one or missing."""
    known = stored.select("url", F.col("hash").alias("stored_hash"))
    joined = pages.join(known, "url", "left")
    return joined.where((F.col("seen") > after_visit) | ~F.col("hash").eqNullSafe(F.col("stored_hash"))).drop("stored_hash")


def with_facets(candidates: DataFrame, profile: str | None = None, domain: str | None = None, starred: DataFrame | None = None) -> DataFrame:
    """Candidates that pass the facets before any top is taken, so that a narrow facet still fills its page."""
    out = candidates if profile is None else candidates.where(F.col("profile_id") == profile)
    out = out if domain is None else out.where(F.col("domain") == domain)
    return out if starred is None else out.join(starred.select("url").distinct(), "url", "left_semi")


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c.cast("double") * q["scale"])


def static_embedding(ids: Column, table: dict[int, list[float]]) -> Column:
    """The mean of the tokens' vectors, of unit length; unknown tokens don't count, without any the vector is zero."""
    size = len(next(iter(table.values())))
    rows = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
    found = F.filter(F.transform(ids, lambda i: F.try_element_at(rows, i)), lambda v: v.isNotNull())
    zero = F.array(*[F.lit(0.0)] * size)
    total = F.aggregate(found, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, zero).otherwise(F.transform(total, lambda x: x / norm))


def search_pages(fused: DataFrame | None, pages: DataFrame, mode: str, limit: int, offset: int = 0) -> DataFrame:
    """pages: key, visited_at. Pages of a search by mode: ``relevance`` (fused: key, score; ties by the older visit), ``newest`` or ``oldest``; without a query (fused is None) the newest."""
    if fused is None or mode in ("newest", "oldest"):
        rows = pages if fused is None else pages.join(fused, "key")
        order = [F.asc("visited_at") if mode == "oldest" else F.desc("visited_at"), "key"]
    else:
        rows, order = fused.join(pages, "key"), [F.desc("score"), "visited_at", "key"]
    return rows.orderBy(*order).offset(offset).limit(limit)
