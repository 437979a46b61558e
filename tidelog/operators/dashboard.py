"""Operational figures: queue depth, retention, trailing ranges, rates, liveness of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import DEPTH_KEPT_SECONDS, DEPTH_PAGE_ROWS

MICROS = 1_000_000


def depth_samples(log: DataFrame, every_s: int) -> DataFrame:
    """(bucket_s, total, pending, ready) of each time bucket: messages, those not done, and the rest, never under 0."""
    bucket = F.floor(F.col("us") / (every_s * MICROS)).cast("long") * every_s
    sampled = log.groupBy(bucket.alias("bucket_s")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "published").alias("pending"))
    return sampled.withColumn("ready", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("pending")))


def since_last(samples: DataFrame, seconds: int, strict: bool = False) -> DataFrame:
    """Samples of the last so many seconds before the newest one, which is one number and goes to all tasks."""
    newest = samples.agg(F.max("bucket_s").alias("newest_s"))
    edge = F.col("newest_s") - seconds
    kept = F.col("bucket_s") > edge if strict else F.col("bucket_s") >= edge
    return samples.crossJoin(F.broadcast(newest)).filter(kept).drop("newest_s")


def retained(samples: DataFrame, seconds: int = DEPTH_KEPT_SECONDS) -> DataFrame:
    return since_last(samples, seconds, strict=True)


def numbered_pages(samples: DataFrame, rows: int = DEPTH_PAGE_ROWS) -> DataFrame:
    """Samples with their page, by time. Samples are a few a minute, and so is what the one ordered task reads."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("bucket_s"))
    return samples.withColumn("page", F.floor((place - 1) / rows).cast("long"))


def queue_depth(log: DataFrame) -> DataFrame:
    """(channel, topic, total, pending, ready) of each queue."""
    depth = log.groupBy("channel", "topic").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "published").alias("pending"))
    return depth.withColumn("ready", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("pending")))


def queues_by_channel(log: DataFrame, size: Column | None = None) -> DataFrame:
    """(channel, queues): the queues of each channel as sorted structs; their number is that of topics and moods."""
    queues = log.groupBy("channel", "topic", "moodType").agg(F.count(F.lit(1)).alias("size"))
    return queues.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("topic", "moodType", "size"))).alias("queues"))


def live_hosts(beats: DataFrame, now_s: int) -> DataFrame:
    """The last heartbeat of each host that has not expired by now."""
    columns = [c for c in beats.columns if c != "hostName"]
    last = beats.groupBy("hostName").agg(F.max_by(F.struct(*columns), F.col("seq")).alias("last"))
    return last.select("hostName", *(F.col(f"last.{c}").alias(c) for c in columns)).filter(F.col("expired_s") >= now_s)
