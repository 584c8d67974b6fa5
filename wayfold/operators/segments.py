"""The lexical index as segments: a base and what changed since, read as one, merged from time to time.

A segment is a folder of tables: documents (in folders by a hash of their id), postings and grams (sorted),
counts of grams, and the ids it touched. Rows of a segment are superseded by any later segment that
touches their document. The table ``manifest`` has one row a finished segment, written last, so a segment that
broke off is written again and never read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wayfold.operators import lexical

#: Folders of a segment's documents, and segments after which they are merged.
BUCKETS, MOST = 16, 8
#: Columns of a segment's tables (they may be empty).
TABLES = {
    "documents": "doc_id string, profile_id string, url_id long, url string, title string, search_terms string, notes string, tags string, enrichment string, "
    "normalized_url string, normalized_title string, normalized_terms string, compact string, cjk string, size int, windows int, bucket int",
    "postings": "token string, doc_id string, weight double, size int",
    "grams": "gram string, doc_id string, place int, windows int",
    "counts": "gram string, n long",
    "touched": "doc_id string",
}
_MANIFEST = "generation int, base boolean, batch long, n long, size long, windows long"


def _bucket(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> list:
    """Finished segments from the last base on: a base replaces all that were before it."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect()  # a line a segment
    except AnalysisException:
        return []
    rows = sorted(rows, key=lambda r: r.generation)
    base = max((r.generation for r in rows if r.base), default=0)
    return [r for r in rows if r.generation >= base]


def _folder(folder: str, generation: int) -> str:
    return f"{folder}/g{generation:06d}"


def _finish(spark: SparkSession, folder: str, generation: int, base: bool, batch: int | None, totals: tuple[int, int, int]) -> None:
    spark.createDataFrame([(generation, base, batch, *totals)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _table(spark: SparkSession, folder: str, generation: int, kind: str) -> DataFrame:
    return spark.read.schema(TABLES[kind]).parquet(f"{_folder(folder, generation)}/{kind}")


def _write(index: lexical.Index, path: str) -> None:
    index.docs.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/documents")
    index.postings.sort("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.grams.sort("gram", "doc_id", "place").write.mode("overwrite").parquet(f"{path}/grams")
    lexical.gram_counts(index.docs.sparkSession.read.schema(TABLES["grams"]).parquet(f"{path}/grams")).sort("gram").write.mode("overwrite").parquet(f"{path}/counts")


def create(docs: DataFrame, folder: str, batch: int | None = None) -> None:
    """The first segment, of documents of lexical.documents."""
    spark = docs.sparkSession
    _write(lexical.Index(docs, lexical.index(docs), lexical.gram_index(docs), None, 0, 0, 0), _folder(folder, 1))
    _finish(spark, folder, 1, True, batch, lexical.totals(_table(spark, folder, 1, "documents")))


def read(spark: SparkSession, folder: str) -> lexical.Index:
    """The index as of the last finished segment. Only rows whose document no later segment touched count.

    Touched ids are those since the last merge; they join to what a search has read of a segment.
    """
    known = _manifest(spark, folder)
    if not known:
        raise ValueError(f"no index in {folder}")
    later = [r.generation for r in known if not r.base]
    last = None
    if later:
        touched = reduce(DataFrame.unionByName, [_table(spark, folder, g, "touched").withColumn("last", F.lit(g)) for g in later])
        last = touched.groupBy("doc_id").agg(F.max("last").alias("last"))

    def every(kind: str) -> DataFrame:
        out = None
        for r in known:
            rows = _table(spark, folder, r.generation, kind)
            if last is not None and r.generation < later[-1] and kind != "counts":
                rows = rows.join(last.where(F.col("last") > r.generation), "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    end = known[-1]
    return lexical.Index(every("documents"), every("postings"), every("grams"), every("counts"), end.n, end.size, end.windows)


def refresh(folder: str, touched: DataFrame, docs: DataFrame, batch: int | None = None) -> bool:
    """A new segment: documents whose ids are in ``touched`` (doc_id) are replaced by ``docs``, or go if they aren't there.

    docs has to hold touched documents only. Of what is stored, only the folders of touched
    documents are read, to take their tokens from the totals. A batch number that is known does nothing.
    """
    spark = docs.sparkSession
    known = _manifest(spark, folder)
    if batch is not None and any(r.batch == batch for r in known):
        return False
    generation = known[-1].generation + 1
    path = _folder(folder, generation)
    touched.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/touched")
    ids = _table(spark, folder, generation, "touched")
    buckets = [r[0] for r in ids.select(_bucket()).distinct().collect()]  # a number a folder
    old = read(spark, folder).docs.where(F.col("bucket").isin(buckets)).join(ids, "doc_id", "left_semi")
    gone = lexical.totals(old)
    _write(lexical.Index(docs, lexical.index(docs), lexical.gram_index(docs), None, 0, 0, 0), path)
    came = lexical.totals(_table(spark, folder, generation, "documents"))
    end = known[-1]
    _finish(spark, folder, generation, False, batch, tuple(a - b + c for a, b, c in zip((end.n, end.size, end.windows), gone, came, strict=True)))
    return True


def merge(spark: SparkSession, folder: str, batch: int | None = None) -> None:
    """All that counts of all segments as a new base; nothing is analysed again, and what was before is no longer read."""
    known = _manifest(spark, folder)
    index = read(spark, folder)
    generation = known[-1].generation + 1
    _write(lexical.Index(index.docs.drop("bucket"), index.postings, index.grams, None, 0, 0, 0), _folder(folder, generation))
    _finish(spark, folder, generation, True, batch if batch is not None else known[-1].batch, (index.n, index.size, index.windows))


def sink(folder: str, build: Callable[[DataFrame], DataFrame], most: int = MOST) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of changes (profile_id, url_id): build makes the documents of some of them as they are now.

    Each micro-batch is one segment, once however often it is tried; after ``most`` segments they are merged.
    """

    def apply(batch: DataFrame, number: int) -> None:
        keys = batch.select("profile_id", "url_id").distinct()
        touched = keys.select(F.concat_ws(":", "profile_id", F.col("url_id").cast("string")).alias("doc_id"))
        if refresh(folder, touched, build(keys), number) and sum(not r.base for r in _manifest(batch.sparkSession, folder)) >= most:
            merge(batch.sparkSession, folder, number)

    return apply
