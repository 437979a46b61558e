"""The queries of the library by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a query under its function's name."""

    def add(run: Run) -> Run:
        RUNS[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add
