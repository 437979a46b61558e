"""Queries that run a stream over the event files and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators.delivery import MICROS
from tidelog.plans.log_queries import NOW_MS, _chain_sql
from tidelog.plans.registry import query
from tidelog.sources.log_store import append
from tidelog.sources.views import MSG_SQL, messages_of
from tidelog.streaming import log_streams

_MOVED = ["seq", "id", "channel", "topic", "status", "payload"]


def _stream(spark, sf_dir):
    return messages_of(log_streams.event_stream(spark, sf_dir))


@query(f"with {MSG_SQL} select seq, id, channel, topic from msg where moodType = 'normal'")
def stream_consume(spark, sf_dir):
    return log_streams.run_to_end(_stream(spark, sf_dir).filter("moodType = 'normal'").select("seq", "id", "channel", "topic"), "consumed")


@query(f"with {MSG_SQL} select {', '.join(_MOVED)} from msg")
def log_migrate(spark, sf_dir):
    return log_streams.move_log(_stream(spark, sf_dir).select(*_MOVED))


@query(f"with {MSG_SQL} select seq, logType from msg")
def log_append(spark, sf_dir):
    """Appends the stream's batches to a log that is partitioned by kind, and reads what it holds."""
    rows = log_streams.move_log(_stream(spark, sf_dir).select("seq", "logType"), "log-append")
    path = append(rows, "log-append", ["logType"])
    return spark.read.parquet(path).select("seq", "logType")


@query(_chain_sql("orderKey", 6 * 3600 * MICROS, "accepted", "rejected"))
def stream_lock(spark, sf_dir):
    return log_streams.run_to_end(log_streams.admitted(_stream(spark, sf_dir), F.col("orderKey"), 6 * 3600 * MICROS), "locks")


@query(_chain_sql("channel || ':' || topic || ':' || orderKey", 21600 * MICROS, "published", "duplicate"))
def stream_dedup(spark, sf_dir):
    decided = log_streams.admitted(_stream(spark, sf_dir), F.concat_ws(":", "channel", "topic", "orderKey"), 21600 * MICROS)
    return log_streams.run_to_end(decided.withColumn("decision", F.when(F.col("decision") == "accepted", "published").otherwise("duplicate")), "dedup")


@query(f"with {MSG_SQL} select seq, us + priority * 1000000 as due_us from msg where moodType = 'delay' and us + priority * 1000000 <= {NOW_MS} * 1000")
def stream_delay(spark, sf_dir):
    delayed = _stream(spark, sf_dir).filter("moodType = 'delay'").select("seq", (F.col("us") + F.col("priority") * MICROS).alias("due_us"))
    return log_streams.release_due(delayed, NOW_MS * 1000)[0]


@query(
    f"""with {MSG_SQL}, s as (select us // 3600000000 * 3600 bucket_s, count(*) total, count(*) filter (status = 'published') pending from msg group by 1)
    select * from s where (bucket_s + 3600) * 1000000 <= (select max(us) from msg) - 600000000"""
)
def stream_depth(spark, sf_dir):
    timed = _stream(spark, sf_dir).select(F.timestamp_micros("us").alias("ts"), "status")
    return log_streams.run_to_end(log_streams.depth_windows(timed, "1 hour", "10 minutes"), "depth")
