"""Exact duplicates by content sort: range partitions of normalised texts, neighbours compared in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import table
from wayfold.llm.text import ascii_lower

#: Characters of the text that splitters hold; a splitter is of bounded size however long the texts are.
PREFIX = 24


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, text) -> (id, sha256 of the run of equal texts), holding one text between batches."""
    last, digest = None, ""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0), batch.column(1)
        same = [texts[0].as_py() == last, *pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()]
        out = []
        for i, equal in enumerate(same):
            if not equal:
                digest = hashlib.sha256(texts[i].as_py().encode()).hexdigest()
            out.append(digest)
        last = texts[len(texts) - 1].as_py()
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["id", "text_sha256"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Return id_col, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` says
    whether the smallest or the largest id of equal texts stays.

    Rows are range-partitioned by sampled splitters over the start of the normalised text, a hash
    and the id, so that copies of one text spread over as many partitions as they need and no
    splitter holds a whole text. External sorting places equal texts adjacent; neighbours are
    compared in full, and each run of equals is named by the digest of its text, which also joins
    the parts of a run that crosses partitions. Only ids and digests are grouped after that.

    Null ids never stay before others; where all ids of a text are null, keep_id is null and all
    its rows are kept. Rows repeated with one id are kept or dropped together. Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"),
        ascii_lower(text).alias("text"),
        ascii_lower(F.substring(text, 1, PREFIX)).alias("start"),
        F.xxhash64(F.lower(text)).alias("hash"),
    )
    parts = keyed.repartitionByRange("start", "hash", "id").sortWithinPartitions("start", "hash", "text", "id")
    runs = table(parts.select("id", "text").mapInArrow(_runs, "id long, text_sha256 string"), "runs")
    best = F.max("id") if keep == "largest" else F.min("id")
    groups = runs.groupBy("text_sha256").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    out = runs.join(groups, "text_sha256")
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents; the largest doc_id stays."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, keep_id IS NULL OR coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM g
"""
