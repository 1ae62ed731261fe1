"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, tuple[Run, str | None]], Callable]:
    """A table of queries and a decorator that adds to it; two queries of one name are an error."""
    found: dict[str, tuple[Run, str | None]] = {}

    def query(sql: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            if run.__name__ in found:
                raise ValueError(f"two queries named {run.__name__}")
            found[run.__name__] = (run, sql)
            return run

        return add

    return found, query
