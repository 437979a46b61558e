"""Append-only logs as Parquet folders that are partitioned by queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
FALLBACK_FOLDER = "file:///tmp/checkpoints/tidelog"


def store_of(spark: SparkSession, path: str):
    """The path as Hadoop has it, and the store that holds it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: that in ``spark.checkpoint.dir``, in the default store where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        return FALLBACK_FOLDER
    path, store = store_of(spark, named)
    return store.makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def append(rows: DataFrame, label: str, partitions: list[str] | None = None, path: str | None = None) -> str:
    """Appends rows to a log and returns its path; a queue's rows come from as many files as tasks had them."""
    path = path or new_folder(rows.sparkSession, label)
    rows.write.mode("append").partitionBy(*(["channel", "topic"] if partitions is None else partitions)).parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
