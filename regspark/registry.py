"""Names of all queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import chunk_queries, file_queries, graph_queries, qa_queries, question_queries, search_queries, text_queries

_AREAS = (search_queries, chunk_queries, graph_queries, text_queries, qa_queries, question_queries, file_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for area in _AREAS for k, f in area.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for area in _AREAS for k, s in area.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["vector_topk_filtered"](spark, sf_dir)
