"""All queries of the library by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import browse, corpus, details, history


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return history.QUERIES | corpus.QUERIES | browse.QUERIES | details.QUERIES


def oracle_sql() -> dict[str, str]:
    return history.SQL | corpus.SQL | browse.SQL | details.SQL
