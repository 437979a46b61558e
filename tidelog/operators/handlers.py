"""Message handlers as columns: errors of handling and of cancelling, tries that stop, workflows with compensation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import delivery

NO_HANDLE, NO_CANCEL, NO_ID, LOCKED = "handle is nil", "cancel is nil", "id is required", "Locking"


@dataclass(frozen=True)
class Handle:
    """Columns over a message that give the text of an error, or null; an absent one is an error of its own where it is used.

    ``cancels`` says whether there is a cancel step at all; a handler without one is not cancelled.
    """

    handle: Column | None = None
    cancel: Column | None = None
    cancels: bool = True

    def errors(self) -> tuple[Column, Column]:
        failed = F.lit(NO_HANDLE) if self.handle is None else self.handle
        cancelled = F.lit(None).cast("string") if not self.cancels else F.lit(NO_CANCEL) if self.cancel is None else self.cancel
        return failed, F.when(failed.isNotNull(), cancelled)


def handled(messages: DataFrame, handler: Handle) -> DataFrame:
    """Adds error (what handling and then cancelling gave, a line each; null without any), status and retry (always 0)."""
    failed, cancelled = handler.errors()
    lines = F.array_compact(F.array(failed, cancelled))
    joined = F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
    return messages.withColumn("error", joined).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed")).withColumn("retry", F.lit(0))


def retry_outcome(attempts: DataFrame, keys: list[str], retry: Column, ignored: Column) -> DataFrame:
    """(keys, tried, error) of attempts(keys, attempt, error): the attempt at which trying stops, and its error.

    Trying stops at the first attempt without an error, with an error that is ignored, or when all of ``retry`` are
    used up; at least one attempt is made.
    """
    last = F.greatest(retry.cast("int"), F.lit(0))
    stops = F.col("error").isNull() | ignored | (F.col("attempt") >= last)
    return attempts.filter(stops).groupBy(*keys).agg(F.min(F.struct("attempt", "error")).alias("end")).select(*keys, F.col("end.attempt").alias("tried"), F.col("end.error").alias("error"))


def published_in_order(messages: DataFrame, key: Column, ttl_us: int, refusal: str) -> DataFrame:
    """Rows of messages(us, seq, ...) with error: null where the message is appended to its stream, else why it isn't.

    A message without an id is refused before anything else. Of the others, one is appended unless its key was taken
    within the time before it (:func:`tidelog.operators.delivery.greedy_admission`). seq tells rows apart.
    """
    with_id = messages.filter("id is not null and id <> ''")
    decided = delivery.greedy_admission(with_id, key, ttl_us).select("seq", F.when(F.col("decision") == "rejected", refusal).alias("error"))
    without = messages.filter("id is null or id = ''").withColumn("error", F.lit(NO_ID))
    return with_id.join(decided, "seq").select(*messages.columns, "error").unionByName(without)


def run_tasks(tasks: DataFrame, key: str = "gid", place: str = "position") -> DataFrame:
    """tasks(gid, position, execute_error, rollback_error) with outcome: executed, failed, skipped, rolled_back or rollback_failed.

    The tasks of a workflow run by position. The first that fails ends the run: later ones are skipped, earlier ones are
    rolled back.
    """
    first = tasks.groupBy(key).agg(F.min(F.when(F.col("execute_error").isNotNull(), F.col(place))).alias("broken"))
    undone = F.when(F.col("rollback_error").isNull(), "rolled_back").otherwise("rollback_failed")
    at = F.col(place)
    outcome = F.when(F.col("broken").isNull(), "executed").when(at == F.col("broken"), "failed").when(at > F.col("broken"), "skipped").otherwise(undone)
    return tasks.join(first, key).withColumn("outcome", outcome).drop("broken")
