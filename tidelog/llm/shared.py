"""Folders and tables that the driver and all executors can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
FALLBACK_FOLDER = "file:///tmp/checkpoints/tidelog"


def _store(spark: SparkSession, path: str):
    """The path as Hadoop has it, and the store that holds it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``, in the cluster's default store where it names none; or the fallback."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        return FALLBACK_FOLDER
    path, store = _store(spark, named)
    uri = store.makeQualified(path).toString().rstrip("/")
    return "file:///" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    path, store = _store(spark, folder)
    store.delete(path, True)


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder.

    This cuts the lineage: lost executors cost a reread of files, and what is not deterministic is fixed once.
    """
    return Scratch(spark, label).written(df, "table")


class Scratch:
    """Tables of one operator's run in one shared folder, removed when nothing that is still to come reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.names = spark, new_folder(spark, label), []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df from a Parquet table; see :func:`written`."""
        path = f"{self.folder}/{len(self.names)}-{name}"
        self.names.append(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Removes all tables so far but those of these names."""
        for k, name in enumerate(self.names):
            if name not in names:
                removed(self.spark, f"{self.folder}/{k}-{name}")

    def close(self) -> None:
        removed(self.spark, self.folder)


def releasing(rows: Iterator) -> Iterator:
    """Rows of a task; at its end the worker gives back what Arrow holds of the task's batches, as workers live on."""
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
