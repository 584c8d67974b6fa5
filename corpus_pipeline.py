"""The corpus pipeline: stages that each work on all documents their predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import contamination, mixing, near, sharding, toxicity
from wayfold.llm.store import table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", near.stage),
    ("benchmark_decontamination", contamination.stage),
    ("source_mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Sketches, a trained model and banded alignment can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
