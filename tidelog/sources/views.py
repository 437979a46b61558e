"""Message-log views over the star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_of(events: DataFrame) -> DataFrame:
    """Events as rows of a message log: one row an event, times in UTC."""
    when = F.col("ts").cast("timestamp")
    kind = F.pmod("event_id", F.lit(4))
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("ch"), F.pmod("user_id", F.lit(5)).cast("string")).alias("channel"),
        F.col("user_id").cast("string").alias("orderKey"),
        F.when(kind == 0, "normal").when(kind == 1, "delay").when(kind == 2, "sequential").otherwise("sequential_by_lock").alias("moodType"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "signup"), "success").otherwise("published").alias("status"),
        F.when((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(10)) == 0), "dlq").otherwise("logic").alias("logType"),
        F.get_json_object("props", "$.k").cast("int").alias("priority"),
        F.col("value").alias("runTime"),
        F.col("props").alias("payload"),
        F.date_format(when, TIME_FORMAT).alias("addTime"),
        F.unix_micros(when).alias("us"),
        F.concat(F.lit("host"), F.pmod("user_id", F.lit(8)).cast("string")).alias("hostName"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "events"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as branches of workflows: six a workflow, compensation and action in turn."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 6").alias("gid"),
        F.pmod("event_id", F.lit(6)).cast("int").alias("idx"),
        F.lpad(F.expr("cast((event_id % 6) div 2 + 1 as string)"), 2, "0").alias("branch_id"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "compensate").otherwise("action").alias("op"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("view", "click"), "prepared").otherwise("succeed").alias("status"),
    )


MSG_SQL = """msg as (
  select cast(event_id as varchar) id, event_id seq, event_type topic, 'ch' || cast(user_id % 5 as varchar) channel, cast(user_id as varchar) orderKey,
         case event_id % 4 when 0 then 'normal' when 1 then 'delay' when 2 then 'sequential' else 'sequential_by_lock' end moodType,
         case when event_type = 'error' then 'failed' when event_type in ('purchase', 'signup') then 'success' else 'published' end status,
         case when event_type = 'error' and event_id % 10 = 0 then 'dlq' else 'logic' end logType,
         cast(props->>'$.k' as int) priority, value runTime, props payload, strftime(ts, '%Y-%m-%d %H:%M:%S') addTime, epoch_us(ts) us,
         'host' || cast(user_id % 8 as varchar) hostName
  from events)"""
BRANCH_SQL = """branch as (
  select event_id // 6 gid, cast(event_id % 6 as int) idx, lpad(cast((event_id % 6) // 2 + 1 as varchar), 2, '0') branch_id,
         case when event_id % 2 = 0 then 'compensate' else 'action' end op,
         case when event_type = 'error' then 'failed' when event_type in ('view', 'click') then 'prepared' else 'succeed' end status
  from events)"""
