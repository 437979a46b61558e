"""Queue decisions as functions of a message history: admission, delays, locks, dead letters, retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import DEAD_LETTER_IDLE_SECONDS, DRAIN_ROWS, MOST_PRIORITY

MICROS = 1_000_000
_CHAIN = "us long, seq long"


def clamped_priority(priority: Column) -> Column:
    """Priorities from 1000 on are 999; there is no lower bound."""
    return F.when(priority >= MOST_PRIORITY + 1, MOST_PRIORITY).otherwise(priority)


def delay_score(us: Column, priority: Column) -> Column:
    """Milliseconds and thousandths for the priority, as one whole number: ms * 1000 + priority."""
    return F.floor(us / 1000).cast("long") * 1000 + priority.cast("long")


def due(scored: DataFrame, now_ms: int) -> DataFrame:
    """Messages whose score is at most a millisecond after now."""
    return scored.filter((F.col("score") >= 0) & (F.col("score") <= (now_ms + 1) * 1000))


def drain(scored: DataFrame, now_ms: int, rows: int = DRAIN_ROWS) -> DataFrame:
    """The batch that is released: highest scores of the due ones first, ties newest first."""
    return due(scored, now_ms).orderBy(F.desc("score"), F.desc("seq")).limit(rows)


def drain_intended(scored: DataFrame, now_ms: int, rows: int = DRAIN_ROWS) -> DataFrame:
    """The batch as it is documented: earlier times first, then higher priorities, ties oldest first."""
    return due(scored, now_ms).orderBy(F.floor(F.col("score") / 1000), F.desc(F.col("score") % 1000), "seq").limit(rows)


def _chain(rows: Iterator[pd.DataFrame], ttl_us: int) -> Iterator[pd.DataFrame]:
    """Decides rows in order, those of one key after another; state is one number."""
    key, until = None, None
    for part in rows:
        decisions = []
        for *own, us, unlock in zip(part["absent"], part["key"], part["us"], part["unlock"], strict=True):
            if own != key:
                key, until = own, None
            if unlock:
                until = None
                decisions.append("unlocked")
            elif until is None or us >= until:
                until = us + ttl_us if ttl_us > 0 else 2**63 - 1
                decisions.append("accepted")
            else:
                decisions.append("rejected")
        yield part[["key", "us", "seq"]].assign(key=part["key"].mask(part["absent"]), decision=decisions)


def greedy_admission(events: DataFrame, key: Column, ttl_us: int, unlock: Column | None = None) -> DataFrame:
    """(key, us, seq, decision): a row is accepted when its key has no accepted row within the time before it.

    Acceptance hangs on earlier acceptance, so it is no window function. Rows are dealt by key and sorted inside their
    partition; the decision is a scan with one number of state, so a hot key needs time but no memory. A time of 0
    never ends. Rows of ``unlock`` end the lock and are no messages. Null keys are one key of their own, apart from empty ones.
    """
    rows = events.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), key.isNull().alias("absent"), "us", "seq", (F.lit(False) if unlock is None else F.coalesce(unlock, F.lit(False))).alias("unlock"))
    ordered = rows.repartition("key", "absent").sortWithinPartitions("absent", "key", "us", "seq")
    return ordered.mapInPandas(lambda parts: _chain(parts, ttl_us), f"key string, {_CHAIN}, decision string")


def classify_pending(pending: DataFrame, idle: str = "idle_s", limit: int = DEAD_LETTER_IDLE_SECONDS) -> DataFrame:
    """Adds what becomes of each pending entry: requeue, dlq, or ack_only where it hasn't been idle for long enough."""
    action = F.when((F.col(idle) > limit) & (F.col("status") == "published"), "requeue").when(F.col(idle) > limit, "dlq").otherwise("ack_only")
    return pending.withColumn("action", action)


def backoff_bounds(attempt: Column, least_ms: int, most_ms: int) -> tuple[Column, Column]:
    """The range [low, high) in ms in which the random wait after an attempt lies, never under the least."""
    half = F.floor(F.least(F.lit(float(most_ms)), least_ms * F.pow(F.lit(2.0), attempt)) / 2).cast("long")
    return F.greatest(half, F.lit(least_ms)).cast("long"), F.greatest(half * 2, F.lit(least_ms)).cast("long")


def retry_plan(messages: DataFrame, retry: Column, least_ms: int = 500, most_ms: int = 1000) -> DataFrame:
    """One row per attempt 0..retry of each message, with the bounds of the wait after it; none after the last."""
    planned = messages.withColumn("last", retry.cast("int")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.greatest("last", F.lit(0)))))
    low, high = backoff_bounds(F.col("attempt"), least_ms, most_ms)
    waits = F.col("attempt") < F.col("last")
    return planned.withColumn("wait_low_ms", F.when(waits, low)).withColumn("wait_high_ms", F.when(waits, high)).drop("last")


def limit_alerts(runs: DataFrame, limits: Column, run_time: str = "runTime") -> DataFrame:
    """One row for each limit that a run passed: position and limit in seconds."""
    return runs.select("*", F.posexplode(limits).alias("position", "limit_s")).filter(F.col(run_time) >= F.col("limit_s"))


def worker_outcomes(messages: DataFrame, handle, fields: str) -> DataFrame:
    """Runs a handler over message batches: handle(DataFrame of pandas) returns the rows with their outcome columns."""
    return messages.mapInPandas(lambda parts: (handle(part) for part in parts), fields)
