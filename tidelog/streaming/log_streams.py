"""Message logs as streams: consuming, moving, admission with state, delayed release, depth by time window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidelog.sources.log_store import new_folder, store_of

_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: How often the progress of a running stream is read.
PROGRESS_SECONDS = 2
#: Groups of keys that are decided together. A group's rows of a batch, and what is held of its keys, are in memory at once.
GROUPS = 4096


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """New event files of a folder as a stream; a batch is bounded by its number of files.

    The table is one file ``events.parquet`` of the folder, several ``events*.parquet``, or a folder of part files of
    that name.
    """
    path, store = store_of(spark, f"{folder}/events.parquet")
    if store.exists(path) and store.getFileStatus(path).isDirectory():
        return spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/events.parquet")
    return spark.readStream.schema(_EVENT).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table, and reads that; restarts go on from the checkpoint.

    Rows behind a watermark, which Spark leaves out, are an error here: results would hang on how files were dealt to
    batches.
    """
    spark = stream.sparkSession
    path = new_folder(spark, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    late, ended = {}, False
    while not ended:  # Spark keeps the progress of a query's last batches only
        ended = query.awaitTermination(PROGRESS_SECONDS)
        for p in query.recentProgress:
            late[p["batchId"]] = max(late.get(p["batchId"], 0), sum(own["numRowsDroppedByWatermark"] for own in p["stateOperators"]))
    if any(late.values()):
        raise ValueError(f"{sum(late.values())} rows came out of order, behind the watermark; give a batch more files or more time")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def move_log(stream: DataFrame, label: str = "moved-log") -> DataFrame:
    """Moves a log into a history table, each batch into a folder of its number.

    A batch that runs again after a failure overwrites its own folder, so the history has each row once.
    """
    spark = stream.sparkSession
    path = new_folder(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)


def admitted(stream: DataFrame, key: Column, ttl_us: int, late: str = "1 day") -> DataFrame:
    """(key, us, seq, decision) of a stream with us and seq: accepted unless the key was accepted within the time before.

    State is two numbers a key: the time until which it is held and that of its last row. Keys are dealt by their hash to
    GROUPS groups, which go to Python with their rows and state at once, as a call a key would cost more than its rows.
    A batch's rows are decided in time order. A key is forgotten once the watermark, ``late`` behind the latest row, has
    passed the time until which it is held, with its group or when its group next gets rows: a row that is still to come
    would be accepted either way. A time of 0 never ends, and its keys stay.

    Batches must come in the time order of a key's rows, as a log is written: a batch with a row before one that is
    already decided stops the stream, as its decisions would hang on how files were dealt to batches. Rows more than
    ``late`` behind are left out by Spark and counted; see :func:`run_to_end`.
    """

    def decide(own: tuple[int], parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {name: (until, last) for name, until, last in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["us", "seq"])
        decisions = []
        for name, us in zip(rows["key"].tolist(), rows["us"].tolist(), strict=True):
            until, last = held.get(name, (None, None))
            if last is not None and us < last:
                raise ValueError(f"rows of key {name} came out of order; give a batch more files")
            if until is None or us >= until:
                until = us + ttl_us if ttl_us > 0 else 2**63 - 1
                decisions.append("accepted")
            else:
                decisions.append("rejected")
            held[name] = until, int(us)
        # Rows of the next batch are not behind the watermark of this one.
        passed = state.getCurrentWatermarkMs() if ttl_us > 0 else 0
        held = {name: x for name, x in held.items() if x[0] // 1000 + 1 > passed}
        if held:
            state.update(tuple(map(list, zip(*((name, *x) for name, x in held.items()), strict=True))))
            if ttl_us > 0:
                state.setTimeoutTimestamp(max(until for until, _ in held.values()) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": rows["key"], "us": rows["us"], "seq": rows["seq"], "decision": decisions})

    keyed = stream.select(key.cast("string").alias("key"), "us", "seq", F.timestamp_micros("us").alias("at")).withWatermark("at", late)
    grouped = keyed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).groupBy("group")
    held = "keys array<string>, untils array<long>, lasts array<long>"
    return grouped.applyInPandasWithState(decide, "key string, us long, seq long, decision string", held, "append", GroupStateTimeout.EventTimeTimeout)


def release_due(stream: DataFrame, now_us: int, label: str = "delayed") -> tuple[DataFrame, DataFrame]:
    """(released, waiting) of a stream with due_us: what is due by now is released, the rest waits.

    Each batch writes its own rows once, into a folder of its number, so that it can run again. What waits is a table
    like any other: a later run with a later now filters it, and takes new rows from its own stream.
    """
    spark = stream.sparkSession
    path = new_folder(spark, label)
    due = F.col("due_us") <= now_us

    def release(batch: DataFrame, number: int) -> None:
        # A missing due_us is never due and waits.
        batch.withColumn("_due", F.coalesce(due, F.lit(False))).write.mode("overwrite").partitionBy("_due").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(release).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch bigint, _due boolean").parquet(f"{path}/rows")
    return rows.filter("_due").select(stream.columns), rows.filter("not _due").select(stream.columns)


def depth_windows(stream: DataFrame, every: str, late: str) -> DataFrame:
    """(bucket_s, total, pending) of each time window of a stream with ts and status, once it can't change any more."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"))
    counted = windows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "published").alias("pending"))
    return counted.select(F.unix_seconds("w.start").alias("bucket_s"), "total", "pending")
