"""Queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.chat import OP7_SQL, op7_chat
from wayfold.llm.contamination import op8_contamination
from wayfold.llm.disclosure import OP11_SQL, op11_disclosure
from wayfold.llm.divergence import OP12_SQL, op12_divergence
from wayfold.llm.exact import OP9_SQL, op9_exact
from wayfold.llm.html import op10_html
from wayfold.llm.lines import op3_lines
from wayfold.llm.mixing import OP2_SQL, op2_mixing
from wayfold.llm.near import op4_near
from wayfold.llm.runs import op13_runs
from wayfold.llm.sharding import op6_sharding
from wayfold.llm.toxicity import op5_toxicity
from wayfold.llm.urls import OP1_SQL, op1_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_urls, op2_mixing, op3_lines, op4_near, op5_toxicity, op6_sharding, op7_chat, op8_contamination, op9_exact, op10_html, op11_disclosure, op12_divergence, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_urls": OP1_SQL, "op2_mixing": OP2_SQL, "op7_chat": OP7_SQL, "op9_exact": OP9_SQL, "op11_disclosure": OP11_SQL, "op12_divergence": OP12_SQL}
