"""Operators on small fixtures: what their queries don't show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tidelog.operators import handlers
from tidelog.operators.delivery import greedy_admission
from tidelog.streaming import log_streams


def test_null_and_empty_keys_are_apart(spark):
    rows = spark.createDataFrame([(None, 1, 1), ("", 2, 2), ("", 3, 3), (None, 4, 4), ("a", 5, 5)], "k string, us long, seq long")
    found = greedy_admission(rows, F.col("k"), 100).collect()
    assert sorted((r["seq"], r["key"], r["decision"]) for r in found) == [(1, None, "accepted"), (2, "", "accepted"), (3, "", "rejected"), (4, None, "rejected"), (5, "a", "accepted")]


def test_handlers_without_steps(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "seq long, e string")
    errors = lambda h: [r["error"] for r in handlers.handled(rows, h).orderBy("seq").collect()]
    assert errors(handlers.Handle(F.col("e"), cancels=False)) == ["x", None]
    assert errors(handlers.Handle(F.col("e"))) == ["x\ncancel is nil", None]
    assert errors(handlers.Handle()) == ["handle is nil\ncancel is nil"] * 2


def test_one_try_is_made_without_retries(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, None), (2, 0, "gone"), (2, 1, None), (3, 0, "x"), (3, 1, "x")], "id long, attempt int, error string")
    found = handlers.retry_outcome(rows, ["id"], F.when(F.col("id") == 1, -1).otherwise(1), F.col("error") == "gone")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "x"), (2, 0, "gone"), (3, 1, "x")]


def _events(spark, n):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")
    )


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    _events(spark, 60).repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    rows = log_streams.run_to_end(log_streams.event_stream(spark, str(tmp_path), 2).select("event_id"), "folder")
    assert sorted(r[0] for r in rows.collect()) == list(range(60))


@pytest.mark.parametrize("ordered", [True, False])
def test_admission_over_batches_keeps_to_time_order(spark, tmp_path, ordered):
    import os

    for k in range(70):
        _events(spark, 70).filter(F.col("event_id") == k).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    os.makedirs(f"{tmp_path}/log")
    for k in range(70):
        at = k if ordered else 69 - k
        part = next(x for x in os.listdir(f"{tmp_path}/{at}") if x.startswith("part-"))
        os.rename(f"{tmp_path}/{at}/{part}", f"{tmp_path}/log/events{k:03d}.parquet")
        os.utime(f"{tmp_path}/log/events{k:03d}.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    stream = log_streams.event_stream(spark, f"{tmp_path}/log", 35).select(F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"))
    hour = 3_600_000_000
    if ordered:
        found = log_streams.run_to_end(log_streams.admitted(stream, F.col("user_id"), 10 * hour), "ordered")
        assert sorted(r["seq"] for r in found.filter("decision = 'accepted'").collect()) == [k for k in range(70) if k // 5 % 2 == 0]
    else:
        with pytest.raises(Exception, match="out of order"):
            log_streams.run_to_end(log_streams.admitted(stream, F.col("user_id"), 10 * hour), "unordered").count()


def _dealt(spark, tmp_path, name, hours):
    """A folder of one event file for each (event_id, hour), in this order of arrival."""
    import os

    os.makedirs(f"{tmp_path}/{name}")
    for k, hour in enumerate(hours):
        _events(spark, 300).filter(F.col("event_id") == hour).coalesce(1).write.parquet(f"{tmp_path}/parts-{name}-{k}")
        part = next(x for x in os.listdir(f"{tmp_path}/parts-{name}-{k}") if x.startswith("part-"))
        os.rename(f"{tmp_path}/parts-{name}-{k}/{part}", f"{tmp_path}/{name}/events{k:03d}.parquet")
        os.utime(f"{tmp_path}/{name}/events{k:03d}.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    timed = log_streams.event_stream(spark, f"{tmp_path}/{name}", 1)
    return timed.select(F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"))


def test_admission_forgets_keys_and_decides_the_same(spark, tmp_path):
    hour = 3_600_000_000
    hours = [0, 5, 11, 13, 50, 51, 105, 155, 160, 164, 170, 299]
    stream = _dealt(spark, tmp_path, "gone", hours)
    query = log_streams.admitted(stream, F.col("user_id"), 10 * hour).writeStream.format("memory").queryName("gone").trigger(availableNow=True).start()
    query.awaitTermination()
    until, expected = {}, {}
    for at in hours:
        expected[at] = "accepted" if at >= until.get(at % 5, -1) else "rejected"
        if expected[at] == "accepted":
            until[at % 5] = at + 10
    assert {r["seq"]: r["decision"] for r in spark.table("gone").collect()} == expected
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_admission_decides_keys_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_streams, "GROUPS", 3, raising=False)
    hour = 3_600_000_000
    stream = _dealt(spark, tmp_path, "grouped", [0, 24, 48])
    # Each row stands for a row of each of 40 keys, and of a missing one; times differ by key.
    spread = stream.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("us", F.col("us") + F.col("k") * hour)
    named = F.when(F.col("k") < 40, F.concat(F.lit("k"), F.col("k")))
    found = log_streams.admitted(spread.select("us", F.col("seq"), "k"), named, 30 * hour, "3 days")
    query = found.writeStream.format("memory").queryName("grouped").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {(k, seq): "rejected" if seq == 24 else "accepted" for k in [*(f"k{k}" for k in range(40)), None] for seq in (0, 24, 48)}
    assert {(r["key"], r["seq"]): r["decision"] for r in spark.table("grouped").collect()} == expected
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    stream = _dealt(spark, tmp_path, "late", [100, 101, 1])
    with pytest.raises(ValueError, match="out of order"):
        log_streams.run_to_end(log_streams.admitted(stream, F.col("user_id"), 10), "late")


def test_delayed_rows_are_released_or_wait(spark, tmp_path):
    stream = _dealt(spark, tmp_path, "due", [4, 9, 2, 7])
    due = F.when(F.col("seq") != 9, F.col("seq")).alias("due_us")
    released, waiting = log_streams.release_due(stream.select("seq", due), 4)
    assert sorted(r["seq"] for r in released.collect()) == [2, 4]
    assert sorted(r["seq"] for r in waiting.collect()) == [7, 9]
