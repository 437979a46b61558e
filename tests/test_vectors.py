"""Inputs and results that were worked out by hand from the documented rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tidelog.functions import keys, text
from tidelog.operators import admin, delivery, eventlog, workflow

S = 1_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def branch_rows(spark, *statuses):
    rows = [("g", k, "compensate" if k % 2 == 0 else "action", s) for k, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "gid string, idx int, op string, status string")


@pytest.mark.parametrize(("statuses", "actions"), [("pppp", [1]), ("pspp", [3]), ("psps", []), ("pspf", [])])
def test_next_action(spark, statuses, actions):
    names = {"p": "prepared", "s": "succeed", "f": "failed"}
    found = workflow.next_actions(branch_rows(spark, *(names[s] for s in statuses)))
    assert sorted(r["idx"] for r in found.collect()) == actions


def test_next_compensation(spark):
    found = workflow.next_compensations(branch_rows(spark, "prepared", "succeed", "prepared", "aborting"))
    assert [r["idx"] for r in found.collect()] == [2]


def scored(spark, rows):
    messages = spark.createDataFrame(rows, "seq long, us long, priority double")
    return messages.select("seq", delivery.delay_score(F.col("us"), delivery.clamped_priority(F.col("priority"))).alias("score"))


def test_delay_batch(spark):
    now = 1_734_399_237_000
    rows = [(k, (now + (10_000 if k == 3 else 0)) * 1000, 10.0 if k == 3 else 8.0 if k == 4 else 0.0) for k in range(10)]
    assert delivery.drain(scored(spark, rows), now).first()["seq"] == 4
    assert delivery.drain(scored(spark, rows), now).count() == 9
    later = now + 10_000
    assert delivery.drain(scored(spark, rows), later).first()["seq"] == 3
    assert delivery.drain_intended(scored(spark, rows), later).first()["seq"] == 4


def test_priority_and_score(spark):
    clamped = [one(spark, delivery.clamped_priority(F.lit(p))) for p in (999.5, 1000.0, 5000.0, -3.0)]
    assert clamped == [999.5, 999.0, 999.0, -3.0]
    assert one(spark, delivery.delay_score(F.lit(1_734_399_237_000_000), F.lit(999.0))) == 1_734_399_237_000_999


def decisions(spark, times, ttl_s, unlocks=()):
    rows = [("k", t * S, n, n in unlocks) for n, t in enumerate(times)]
    events = spark.createDataFrame(rows, "key string, us long, seq long, free boolean")
    return [r["decision"] for r in delivery.greedy_admission(events, F.col("key"), ttl_s * S, F.col("free")).orderBy("us", "seq").collect()]


def test_admission(spark):
    assert decisions(spark, [0, 3, 11], 10) == ["accepted", "rejected", "accepted"]
    assert decisions(spark, [0, 1000], 0) == ["accepted", "rejected"]
    assert decisions(spark, [0, 1000, 1001], 0, {1}) == ["accepted", "unlocked", "accepted"]
    assert decisions(spark, [0, 3600, 25200], 21600) == ["accepted", "rejected", "accepted"]


def test_backoff(spark):
    attempts = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    low, high = delivery.backoff_bounds(F.col("n"), 500, 1000)
    assert [tuple(r) for r in attempts.select(low, high).collect()] == [(500, 500), (500, 1000), (500, 1000)]
    low, high = delivery.backoff_bounds(F.lit(1), 100, 2000)
    assert tuple(spark.range(1).select(low, high).first()) == (100, 200)


def test_pages(spark):
    rows = spark.range(25)
    assert tuple(eventlog.page_count(rows, 10).first()) == (25, 3)
    for page, first in ((0, 0), (1, 0), (2, 10), (3, 20)):
        assert eventlog.page_of(rows, page, 10, F.asc("id")).first()["id"] == first
    assert eventlog.page_of(rows, 1, 0, F.asc("id")).count() == 10


def test_dead_letters(spark):
    rows = spark.createDataFrame([(61, None), (61, "published"), (10, "published")], "idle_s int, status string")
    assert [r["action"] for r in delivery.classify_pending(rows).collect()] == ["dlq", "requeue", "ack_only"]


def test_keys(spark):
    key = keys.stream_key(F.lit("p"), F.lit("normal"), F.lit("ch"), F.lit("tp"))
    assert one(spark, key) == "p:{ch:tp}:normal_stream:stream"
    assert [one(spark, c) for c in keys.raw_channel_topic(key)] == ["{ch", "tp}"]
    assert [one(spark, c) for c in keys.channel_topic(key)] == ["ch", "tp"]
    assert one(spark, keys.stream_key(F.lit("p"), F.lit("delay"), F.lit(""), F.lit(None))) == "p:{default-channel:default-topic}:delay_stream:stream"
    assert [one(spark, c) for c in keys.channel_topic(F.lit("a:b"))] == [None, None]


def test_info(spark):
    assert one(spark, text.info_map(F.lit("# Memory\nused_memory:10\na:b:c\nno colon\na:d"))) == {"used_memory": "10", "a": "d"}
    assert one(spark, text.info_map(F.lit(""))) == {}
    line = "Value at:0x7f refcount:1 encoding:stream serializedlength:12 lru:7878503 lru_seconds_idle:3"
    found = one(spark, text.object_map(F.lit(line)))
    assert (found["refcount"], found["encoding"], found["serializedlength"], found["lru_seconds_idle"]) == ("1", "stream", "12", "3")


def test_text(spark):
    assert one(spark, text.masked(F.lit("abcdefghijkl"))) == "abc****ijkl"
    assert [one(spark, text.duration_seconds(F.lit(t))) for t in ("10s", "5m", "2h", "")] == [10, 300, 7200, 10]
    assert one(spark, text.byte_text(F.lit(1536))) == "1.50 KB"
    assert one(spark, text.relative_time(F.lit(3700), F.lit("day"))) == "1 hours ago"
    assert [one(spark, admin.version_of(F.lit(n))) for n in ("20260108005_x.up.json", "abc_x")] == [20260108005, 0]


def test_hash_bucket(spark):
    def fnv(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    for word in ("", "a", "foobar", "été", "x" * 50):
        assert one(spark, text.fnv1a_bucket(F.lit(word), 1009)) == fnv(word.encode()) % 1009


def test_guards(spark):
    log = spark.createDataFrame([("logic", "failed")], "logType string, status string")
    with pytest.raises(ValueError):
        eventlog.matching(log, "logic", checked=True, status="lost")
    assert eventlog.matching(log, "logic", checked=True, status="").count() == 1


def test_alerts_without_topics(spark):
    rules = spark.createDataFrame([(1, ["dlq"], "c", [], ["mail"]), (2, ["system"], "", [], ["chat", "mail"])], "rule int, when array<string>, channel string, topics array<string>, then array<string>")
    log = spark.createDataFrame([(1, "c", "t")], "seq int, channel string, topic string")
    assert [r["rule"] for r in admin.matched_rules(log, rules, "dlq").collect()] == [1]
    assert sorted(r["target"] for r in admin.dispatched(admin.matched_rules(log, rules, "system")).collect()) == ["chat", "mail"]


def test_partial_update_keeps_unchanged(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    new = spark.createDataFrame([(1, "", "z")], "id int, x string, y string")
    assert sorted(tuple(r) for r in eventlog.partial_update(old, new, "id", ["x", "y"]).collect()) == [(1, "a", "z"), (2, "c", "d")]


def test_byte_format_keeps_sizes_of_a_terabyte_and_more(spark, tmp_path):
    from tidelog import plans

    ids = {3: "891.00 Bytes", 10**5: "922.01 GB", 10**6: "90.04 TB", 10**8: "879.30 PB", 10**9: "85.87 EB", 10**12: "81.89 YB"}
    rows = spark.createDataFrame([(i, 1, "view", 1.0, '{"k": 99}') for i in ids], "event_id bigint, user_id bigint, event_type string, value double, props string")
    rows.withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).write.parquet(str(tmp_path / "events.parquet"))
    assert {r["seq"]: r["size"] for r in plans.queries()["byte_format"](spark, str(tmp_path)).collect()} == ids
