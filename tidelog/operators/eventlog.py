"""Filters, pages, counts and edits of an append-only message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import STATUSES


def matching(log: DataFrame, log_type: str | None = None, checked: bool = False, **wanted: str | None) -> DataFrame:
    """Rows that equal all wanted values; empty and absent ones don't count. ``checked`` allows known statuses only."""
    if checked and wanted.get("status") and wanted["status"] not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    if log_type:
        wanted = {"logType": log_type, **wanted}
    for name, value in wanted.items():
        if value not in (None, ""):
            log = log.filter(F.col(name) == value)
    return log


def page_of(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """One page of rows in an order, from page 1; pages under 1 are the first, sizes under 1 are 10.

    A top-k of page * size rows: deep pages of large tables are for :func:`after_key`.
    """
    size = size if size > 0 else 10
    return rows.orderBy(*order).offset(max(0, page - 1) * size).limit(size)


def after_key(rows: DataFrame, key: str, cursor: object | None, size: int) -> DataFrame:
    """The next rows by a key after a cursor; each page costs the same, as the filter reaches the scan."""
    if cursor is not None:
        rows = rows.filter(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """One row (total, pages) of a table for pages of a size."""
    size = size if size > 0 else 10
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an order without ties."""
    columns = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in columns))


def newest(log: DataFrame, keys: list[str], order: str, most: int | Column) -> DataFrame:
    """The newest ``most`` rows of each key, as a stream of bounded length keeps them."""
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("rn") <= most).drop("rn")


def acknowledged(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key once its status is final or is missing."""
    return latest(log, keys, order).filter(F.col("status").isin("success", "failed") | F.col("status").isNull())


def without_success(log: DataFrame, keys: list[str]) -> DataFrame:
    """Failed rows of keys that never had a success: those may be tried again."""
    done = log.filter("status = 'success'").select(*keys).distinct()
    return log.filter("status = 'failed'").join(done, keys, "left_anti")


def for_retry(log: DataFrame, now: Column) -> DataFrame:
    """Failed rows as they are sent again: no run times, no retries, added now."""
    return log.filter("status = 'failed'").drop("beginTime", "endTime", "runTime").withColumn("retry", F.lit(0)).withColumn("addTime", now)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in the place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def partial_update(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the non-empty values of changes in some columns, by key; other columns stay."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    picked = {c: F.when(F.col(f"new_{c}") != "", F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    return old.join(new, key, "left").select(*(picked.get(c, F.col(c)).alias(c) for c in old.columns))
