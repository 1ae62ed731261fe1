"""All queries over the grid operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlens.plans import apply_queries, check_queries, eval_queries, read_queries, stream_queries, survey_queries

_PARTS = (read_queries, survey_queries, apply_queries, check_queries, eval_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row roles of the order grid: the scan that everything else builds on."""
    return queries()["row_roles"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, data folder)."""
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
