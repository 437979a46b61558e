"""Columns and types of the tables that the library reads and writes.

Durations are whole nanoseconds. Tables of logs are append-only: a message has one row for each status it came to.
"""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def _schema(fields: str) -> T.StructType:
    """A struct of ``name kind`` pairs; unlike DDL text it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in fields.split(","))])


MESSAGE = _schema(
    "id string, topic string, channel string, orderKey string, lockOrderKeyTTL bigint, maxLen bigint, retry int, priority double, "
    "payload string, addTime string, executeTime timestamp, moodType string, timeToRun bigint, timeToRunLimit array<bigint>"
)
EVENT_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *MESSAGE.fields,
        *_schema("status string, logType string, level string, info string, hostName string, beginTime string, endTime string, runTime double").fields,
    ]
)
WORKFLOW_RECORD = _schema(
    "Channel string, Topic string, Gid string, TaskId string, BranchId string, Option string, Status string, Statement string, "
    "Error string, Skipper boolean, CreatedAt timestamp, UpdatedAt timestamp"
)
TRANS_GLOBAL = _schema("gid string, transType string, status string, createTime timestamp, updateTime timestamp, finishTime timestamp, rollbackTime timestamp, reason string")
TRANS_BRANCH = _schema("gid string, idx int, url string, task_id string, branch_id string, op string, status string, error string, createTime timestamp, finishTime timestamp")
DEPTH_SAMPLE = _schema("ts timestamp, total bigint, pending bigint, ready bigint")
POD = _schema("hostName string, cpuCount int, cpuPercent string, memoryCount bigint, memoryTotal string, memoryUsed string, memoryPercent string, expiredTime bigint")

# Moods of queues, message states, kinds of logs, states of transactions.
MOODS = ("normal", "delay", "sequential", "sequential_by_lock")
STATUSES = ("published", "success", "failed")
LOG_TYPES = ("logic", "dlq")
TRANS_STATUSES = ("prepared", "succeed", "failed", "aborting")

# Defaults and limits of queues.
DEFAULT_CHANNEL = "default-channel"
DEFAULT_TOPIC = "default-topic"
DEFAULT_STREAM_LENGTH = 2000
REQUEUE_STREAM_LENGTH = 200_000
LOG_STREAM_LENGTH = 20_000
MOST_PRIORITY = 999.0
STATUS_SECONDS = 6 * 3600
DEAD_LETTER_IDLE_SECONDS = 60
DEPTH_KEPT_SECONDS = 48 * 3600
POD_SECONDS = 50
DRAIN_ROWS = 100
DETAIL_ROWS = 50
DEPTH_PAGE_ROWS = 1000
