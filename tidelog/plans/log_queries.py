"""Queries on message logs and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import delivery, eventlog
from tidelog.plans.registry import query
from tidelog.schema import DETAIL_ROWS
from tidelog.sources.views import MSG_SQL, messages

COLUMNS = "id, seq, topic, channel, orderKey, moodType, status, logType, priority, runTime, payload, addTime, us, hostName"
#: 2024-01-15 00:00:00 UTC in milliseconds: the fixed "now" of queries that need one.
NOW_MS = 1_705_276_800_000
_SCORE_SQL = "(us // 1000) * 1000 + priority"
_DELAYED_SQL = f"{MSG_SQL}, scored as (select seq, id, topic, {_SCORE_SQL} score from msg where moodType = 'delay')"


def _delayed(spark, sf_dir):
    scored = messages(spark, sf_dir).filter("moodType = 'delay'")
    return scored.select("seq", "id", "topic", delivery.delay_score(F.col("us"), F.col("priority")).alias("score"))


@query(f"with {MSG_SQL} select {COLUMNS} from msg where logType = 'logic' and status = 'failed' and topic = 'error'")
def event_log_filter(spark, sf_dir):
    return eventlog.matching(messages(spark, sf_dir), "logic", checked=True, status="failed", topic="error", id="")


@query(f"with {MSG_SQL} select {COLUMNS} from msg where logType = 'logic' and status = 'failed' order by seq desc limit 10 offset 10")
def event_log_page(spark, sf_dir):
    return eventlog.page_of(eventlog.matching(messages(spark, sf_dir), "logic", checked=True, status="failed"), 2, 10, F.desc("seq"))


@query("select * from (values ('failed', true), ('published', true), ('success', true), ('lost', false), ('', true)) x(status, allowed)")
def event_log_status_guard(spark, sf_dir):
    """One row a status: whether the checked filter allows it."""
    log, rows = messages(spark, sf_dir), []
    for status in ("failed", "published", "success", "lost", ""):
        try:
            eventlog.matching(log, "logic", checked=True, status=status)
            rows.append((status, True))
        except ValueError:
            rows.append((status, False))
    return spark.createDataFrame(rows, "status string, allowed boolean")


@query(f"with {MSG_SQL} select {COLUMNS} from msg where seq = 42")
def event_log_detail(spark, sf_dir):
    return messages(spark, sf_dir).filter("seq = 42").limit(1)


@query(f"with {MSG_SQL} select count(*) total, cast(ceil(count(*) / 10.0) as bigint) pages from msg where logType = 'logic'")
def page_count(spark, sf_dir):
    return eventlog.page_count(eventlog.matching(messages(spark, sf_dir), "logic"), 10)


@query(f"with {MSG_SQL} select status, count(*) n from msg where logType = 'logic' group by status")
def status_count(spark, sf_dir):
    return eventlog.matching(messages(spark, sf_dir), "logic").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {MSG_SQL} select {COLUMNS} from msg where logType = 'dlq' order by seq desc limit 10")
def dlq_list(spark, sf_dir):
    return eventlog.page_of(eventlog.matching(messages(spark, sf_dir), "dlq"), 1, 10, F.desc("seq"))


@query(f"with {MSG_SQL} select {COLUMNS} from msg where logType = 'logic' and status = 'failed'")
def retry_eligible(spark, sf_dir):
    return eventlog.matching(messages(spark, sf_dir), "logic").filter("status = 'failed'")


@query(f"with {MSG_SQL} select {COLUMNS} from msg where hostName = 'host3' order by seq desc limit 10")
def logs_by_host(spark, sf_dir):
    return messages(spark, sf_dir).filter("hostName = 'host3'").orderBy(F.desc("seq")).limit(10)


@query(
    f"""with {MSG_SQL} select id, coalesce(nullif(case when seq % 3 = 0 then '' else channel end, ''), 'default-channel') channel,
    coalesce(nullif(case when seq % 5 = 0 then '' else topic end, ''), 'default-topic') topic, payload, least(priority * 20.0, 999.0) priority,
    case when seq % 7 = 0 then 2000 else seq % 7 * 100 end max_len from msg where seq % 11 <> 0"""
)
def message_normalize(spark, sf_dir):
    """Commands with gaps as messages: defaults filled in, priorities clamped, empty payloads refused."""
    seq = F.col("seq")
    commands = messages(spark, sf_dir).select(
        "id",
        F.when(seq % 3 == 0, "").otherwise(F.col("channel")).alias("channel"),
        F.when(seq % 5 == 0, "").otherwise(F.col("topic")).alias("topic"),
        F.when(seq % 11 == 0, "").otherwise(F.col("payload")).alias("payload"),
        (F.col("priority") * 20.0).alias("priority"),
        F.when(seq % 7 != 0, seq % 7 * 100).alias("max_len"),
    )
    return normalized(commands)


def normalized(commands):
    """Commands as messages; see :func:`message_normalize`."""
    from tidelog.functions.keys import _or
    from tidelog.schema import DEFAULT_CHANNEL, DEFAULT_STREAM_LENGTH, DEFAULT_TOPIC

    return commands.filter(F.coalesce("payload", F.lit("")) != "").select(
        "id",
        _or(F.col("channel"), DEFAULT_CHANNEL).alias("channel"),
        _or(F.col("topic"), DEFAULT_TOPIC).alias("topic"),
        "payload",
        delivery.clamped_priority(F.col("priority")).alias("priority"),
        F.coalesce("max_len", F.lit(DEFAULT_STREAM_LENGTH).cast("long")).alias("max_len"),
    )


@query(f"with {MSG_SQL} select case when seq % 4 = 0 then 'made' else id end id, payload from msg where seq % 11 <> 0")
def validate_payload(spark, sf_dir):
    """Ids filled in where they are missing (with a marker here: random ones can't be compared), empty payloads refused."""
    seq = F.col("seq")
    rows = messages(spark, sf_dir).select(F.when(seq % 4 != 0, F.col("id")).alias("id"), F.when(seq % 11 != 0, F.col("payload")).otherwise("").alias("payload"))
    return rows.filter("payload <> ''").withColumn("id", F.coalesce("id", F.lit("made")))


@query(f"with {MSG_SQL} select moodType || '_stream' stream, channel, topic, count(*) n from msg group by all")
def route_by_mood(spark, sf_dir):
    return messages(spark, sf_dir).groupBy(F.concat("moodType", F.lit("_stream")).alias("stream"), "channel", "topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {MSG_SQL} select seq, id, channel, topic, payload from msg where moodType = 'normal'")
def publish_normal(spark, sf_dir):
    """Appends messages to a log that is partitioned by queue, and reads it again."""
    from tidelog.sources.log_store import append, read

    path = append(messages(spark, sf_dir).filter("moodType = 'normal'").select("seq", "id", "channel", "topic", "payload"), "publish")
    return read(spark, path).select("seq", "id", "channel", "topic", "payload")


@query(f"with {_DELAYED_SQL} select seq, id, topic, score from scored")
def publish_delay(spark, sf_dir):
    from tidelog.sources.log_store import append, read

    return read(spark, append(_delayed(spark, sf_dir), "publish-delay", ["topic"])).select("seq", "id", "topic", "score")


@query(f"with {MSG_SQL} select seq, channel, topic from (select *, row_number() over (partition by channel, topic order by seq desc) rn from msg) where rn <= 5")
def stream_trim(spark, sf_dir):
    return eventlog.newest(messages(spark, sf_dir).select("seq", "channel", "topic"), ["channel", "topic"], "seq", 5)


@query(f"with {MSG_SQL} select seq, id, payload from msg where channel = 'ch1' and topic = 'click' order by seq limit {DETAIL_ROWS}")
def queue_detail(spark, sf_dir):
    queue = messages(spark, sf_dir).filter("channel = 'ch1' and topic = 'click'")
    return queue.orderBy("seq").limit(DETAIL_ROWS).select("seq", "id", "payload")


@query(f"with {MSG_SQL} select seq, id, payload from msg where channel = 'ch1' and topic = 'click' order by seq desc limit {DETAIL_ROWS}")
def stream_reverse(spark, sf_dir):
    queue = messages(spark, sf_dir).filter("channel = 'ch1' and topic = 'click'")
    return queue.orderBy(F.desc("seq")).limit(DETAIL_ROWS).select("seq", "id", "payload")


@query(f"with {MSG_SQL} select {COLUMNS} from msg where id <> '42'")
def delete_by_id(spark, sf_dir):
    return messages(spark, sf_dir).filter("id <> '42'")


@query(f"with {MSG_SQL} select seq, case when seq = 42 then 'edited' else payload end payload from msg")
def edit_payload(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", F.when(F.col("seq") == 42, "edited").otherwise(F.col("payload")).alias("payload"))


@query(f"with {MSG_SQL} select seq, id, topic, 0 retry, '2024-02-01 00:00:00' addTime from msg where status = 'failed'")
def retry_reset_fields(spark, sf_dir):
    return eventlog.for_retry(messages(spark, sf_dir), F.lit("2024-02-01 00:00:00")).select("seq", "id", "topic", "retry", "addTime")


@query(f"with {MSG_SQL} select channel, topic, seq, status, addTime from (select *, row_number() over (partition by channel, topic order by seq desc) rn from msg) where rn = 1")
def latest_status(spark, sf_dir):
    return eventlog.latest(messages(spark, sf_dir).select("channel", "topic", "seq", "status", "addTime"), ["channel", "topic"], "seq")


@query(
    f"""with {MSG_SQL} select orderKey, seq, status from (select *, row_number() over (partition by orderKey order by seq desc) rn from msg)
    where rn = 1 and (status in ('success', 'failed') or status is null)"""
)
def ack_status(spark, sf_dir):
    return eventlog.acknowledged(messages(spark, sf_dir).select("orderKey", "seq", "status"), ["orderKey"], "seq")


@query(f"with {MSG_SQL} select seq, seq // 3 as task, topic from msg m where status = 'failed' and not exists (select 1 from msg s where s.status = 'success' and s.seq // 3 = m.seq // 3)")
def retry_check_anti(spark, sf_dir):
    """Failed rows of tasks that never succeeded; a task is three rows in a row."""
    rows = messages(spark, sf_dir).select("seq", F.expr("seq div 3").alias("task"), "topic", "status")
    return eventlog.without_success(rows, ["task"]).select("seq", "task", "topic")


@query(f"with {MSG_SQL} select channel, topic, orderKey, count(*) - 1 as score from msg group by all having count(*) > 1")
def duplicate_score(spark, sf_dir):
    keys = ["channel", "topic", "orderKey"]
    return messages(spark, sf_dir).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("score")).filter("score > 0")


@query(f"with {_DELAYED_SQL} select seq, id, topic, score from scored")
def delay_score(spark, sf_dir):
    return _delayed(spark, sf_dir)


@query(f"with {_DELAYED_SQL} select seq, id, topic, score from scored where score between 0 and {(NOW_MS + 1) * 1000} order by score desc, seq desc limit 100")
def delay_drain(spark, sf_dir):
    return delivery.drain(_delayed(spark, sf_dir), NOW_MS)


@query(f"with {_DELAYED_SQL} select seq, id, topic, score from scored where score between 0 and {(NOW_MS + 1) * 1000} order by score // 1000, score % 1000 desc, seq limit 100")
def delay_intended(spark, sf_dir):
    return delivery.drain_intended(_delayed(spark, sf_dir), NOW_MS)


@query(
    f"""with {_DELAYED_SQL} select seq, id, topic, score from scored where seq not in
    (select seq from scored where score between 0 and {(NOW_MS + 1) * 1000} order by score desc, seq desc limit 100)"""
)
def delay_remaining(spark, sf_dir):
    delayed = _delayed(spark, sf_dir)
    return delayed.join(delivery.drain(delayed, NOW_MS).select("seq"), "seq", "left_anti").select("seq", "id", "topic", "score")


@query(f"with {MSG_SQL} select seq, case when seq % 9 = 0 then 'malformed' else 'ok' end as state from msg where moodType = 'delay'")
def delay_malformed(spark, sf_dir):
    """Members of the delay set that are no JSON are told apart; they leave the set like the others."""
    member = F.when(F.col("seq") % 9 == 0, "{not json").otherwise(F.col("payload"))
    rows = messages(spark, sf_dir).filter("moodType = 'delay'").select("seq", F.from_json(member, "k int", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return rows.select("seq", F.when(F.col("m.k").isNull(), "malformed").otherwise("ok").alias("state"))


_LOCK_HOURS = 6


def _chain_sql(key: str, ttl_us: int, accepted: str, rejected: str, source: str = "msg") -> str:
    return f"""with recursive {MSG_SQL},
    o as (select {key} k, us, seq, row_number() over (partition by {key} order by us, seq) rn from {source}),
    r as (select k, us, seq, rn, us + {ttl_us} til, '{accepted}' decision from o where rn = 1
          union all
          select o.k, o.us, o.seq, o.rn, case when o.us >= r.til then o.us + {ttl_us} else r.til end, case when o.us >= r.til then '{accepted}' else '{rejected}' end
          from r join o on o.k = r.k and o.rn = r.rn + 1)
    select k as key, us, seq, decision from r"""


@query(_chain_sql("orderKey", _LOCK_HOURS * 3600 * delivery.MICROS, "accepted", "rejected"))
def lock_admission(spark, sf_dir):
    return delivery.greedy_admission(messages(spark, sf_dir), F.col("orderKey"), _LOCK_HOURS * 3600 * delivery.MICROS)


@query(_chain_sql("channel || ':' || topic || ':' || orderKey", 21600 * delivery.MICROS, "published", "duplicate"))
def seq_dedup(spark, sf_dir):
    """An id is published once within six hours of its last acceptance; duplicates don't make the time longer."""
    key = F.concat_ws(":", "channel", "topic", "orderKey")
    decided = delivery.greedy_admission(messages(spark, sf_dir), key, 21600 * delivery.MICROS)
    return decided.withColumn("decision", F.when(F.col("decision") == "accepted", "published").otherwise("duplicate"))


@query(
    f"""with {MSG_SQL}, g as (select orderKey k, us, seq, status, sum(case when status = 'failed' then 1 else 0 end) over (partition by orderKey order by us, seq) part from msg),
    f as (select *, row_number() over (partition by k, part order by us, seq) rn, count(*) filter (status = 'failed') over (partition by k, part) unlocks from g)
    select k as key, us, seq, case when status = 'failed' then 'unlocked' when rn = 1 + unlocks then 'accepted' else 'rejected' end decision from f"""
)
def lock_force_unlock(spark, sf_dir):
    """Locks that never end by themselves; failed messages stand for forced unlocks."""
    return delivery.greedy_admission(messages(spark, sf_dir), F.col("orderKey"), 0, F.col("status") == "failed")


@query(f"with {MSG_SQL} select seq, 'q:{{' || channel || ':' || topic || '}}:lock:' || orderKey as lock_key from msg where moodType = 'sequential_by_lock' and channel = 'ch2' and topic = 'view'")
def lock_view(spark, sf_dir):
    """Locks of one queue, by their path channel:topic."""
    from tidelog.functions.keys import lock_key

    channel, topic = "ch2:view".split(":")
    rows = messages(spark, sf_dir).filter((F.col("moodType") == "sequential_by_lock") & (F.col("channel") == channel) & (F.col("topic") == topic))
    return rows.select("seq", lock_key(F.lit("q"), F.col("channel"), F.col("topic"), F.col("orderKey")).alias("lock_key"))


_PENDING_SQL = f"with {MSG_SQL}, pending as (select seq, channel, topic, status, ({NOW_MS} * 1000 - us) / 1000000.0 idle_s from msg where us <= {NOW_MS} * 1000)"


def _pending(spark, sf_dir):
    rows = messages(spark, sf_dir).filter(F.col("us") <= NOW_MS * 1000)
    return rows.select("seq", "channel", "topic", "status", ((F.lit(NOW_MS * 1000) - F.col("us")) / 1e6).alias("idle_s"))


@query(
    f"{_PENDING_SQL} select seq, channel, topic, status, case when idle_s > 864000 and status = 'published' then 'requeue' when idle_s > 864000 then 'dlq' else 'ack_only' end as action from pending"
)
def dlq_classify(spark, sf_dir):
    return delivery.classify_pending(_pending(spark, sf_dir), limit=864_000).drop("idle_s")


@query(f"{_PENDING_SQL} select channel, topic, min(seq) as seq from pending where idle_s > 60 and seq in (select seq from msg where seq % 500 >= 3) group by channel, topic")
def dlq_candidates(spark, sf_dir):
    """The oldest pending entry of each queue that has been idle for long enough and is still in the stream; some were trimmed."""
    stream = messages(spark, sf_dir).filter("seq % 500 >= 3").select("seq")
    return _pending(spark, sf_dir).filter("idle_s > 60").join(stream, "seq", "left_semi").groupBy("channel", "topic").agg(F.min("seq").alias("seq"))


@query(f"with {MSG_SQL} select seq, moodType, case moodType when 'normal' then 'append' when 'delay' then 'schedule' when 'sequential' then 'none' else 'append_with_lock' end as action from msg where logType = 'dlq'")
def dlq_retry_plan(spark, sf_dir):
    mood = F.col("moodType")
    action = F.when(mood == "normal", "append").when(mood == "delay", "schedule").when(mood == "sequential", "none").otherwise("append_with_lock")
    return messages(spark, sf_dir).filter("logType = 'dlq'").select("seq", "moodType", action.alias("action"))


@query(
    f"""with {MSG_SQL}, p as (select seq, seq % 4 last, unnest(range(0, cast(seq % 4 as bigint) + 1)) attempt from msg where status = 'failed')
    select seq, cast(attempt as int) attempt, case when attempt < last then greatest(cast(floor(least(1000.0, 500 * pow(2, attempt)) / 2) as bigint), 500) end wait_low_ms,
    case when attempt < last then greatest(cast(floor(least(1000.0, 500 * pow(2, attempt)) / 2) as bigint) * 2, 500) end wait_high_ms from p"""
)
def retry_plan(spark, sf_dir):
    failed = messages(spark, sf_dir).filter("status = 'failed'").select("seq")
    return delivery.retry_plan(failed, F.col("seq") % 4)


_BOUNDS_SQL = "greatest(cast(floor(least({most}, {least} * pow(2, attempt)) / 2) as bigint){times}, {least})"


@query(
    f"""with {MSG_SQL}, a as (select distinct priority % 8 attempt from msg)
    select cast(attempt as int) attempt, {_BOUNDS_SQL.format(least=500, most="1000.0", times="")} low_ms, {_BOUNDS_SQL.format(least=500, most="1000.0", times=" * 2")} high_ms,
    {_BOUNDS_SQL.format(least=100, most="2000.0", times="")} saga_low_ms, {_BOUNDS_SQL.format(least=100, most="2000.0", times=" * 2")} saga_high_ms from a"""
)
def backoff_bounds(spark, sf_dir):
    attempts = messages(spark, sf_dir).select((F.col("priority") % 8).alias("attempt")).distinct()
    low, high = delivery.backoff_bounds(F.col("attempt"), 500, 1000)
    saga_low, saga_high = delivery.backoff_bounds(F.col("attempt"), 100, 2000)
    return attempts.select("attempt", low.alias("low_ms"), high.alias("high_ms"), saga_low.alias("saga_low_ms"), saga_high.alias("saga_high_ms"))


@query(f"with {MSG_SQL} select seq, cast(p - 1 as int) as position, [10, 50, 100][p] limit_s from msg, (values (1), (2), (3)) x(p) where runTime >= [10, 50, 100][p]")
def limit_alerts(spark, sf_dir):
    limits = F.array(F.lit(10), F.lit(50), F.lit(100))
    return delivery.limit_alerts(messages(spark, sf_dir).select("seq", "runTime"), limits).select("seq", "position", "limit_s")


@query(f"with {MSG_SQL} select seq, runTime > 60 as timed_out from msg")
def timeouts(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", (F.col("runTime") > 60).alias("timed_out"))


@query(f"with {MSG_SQL} select seq, cast(priority * 1500 as bigint) / 1e6 as run_s from msg")
def run_time(spark, sf_dir):
    """Seconds between the begin and the end of a run."""
    rows = messages(spark, sf_dir).select("seq", F.timestamp_micros("us").alias("begin"), F.timestamp_micros(F.col("us") + F.col("priority") * 1500).alias("end"))
    return rows.select("seq", ((F.unix_micros("end") - F.unix_micros("begin")) / 1e6).alias("run_s"))


@query(f"with {MSG_SQL} select seq, status, case when status = 'failed' then 'error' else 'info' end as level, hostName from msg")
def worker_outcome(spark, sf_dir):
    """A handler over message batches that fails for topic error."""

    def handle(part):
        failed = part["topic"] == "error"
        status = part["topic"].map({"error": "failed", "purchase": "success", "signup": "success"}).fillna("published")
        return part.assign(status=status, level=failed.map({True: "error", False: "info"}))[["seq", "status", "level", "hostName"]]

    return delivery.worker_outcomes(messages(spark, sf_dir).select("seq", "topic", "hostName"), handle, "seq long, status string, level string, hostName string")


@query(f"with {MSG_SQL} select orderKey as key, status, topic from (select *, row_number() over (partition by orderKey order by seq desc) rn from msg) where rn = 1")
def hash_read(spark, sf_dir):
    """A key's hash as a map of its fields, each with the value that was set last."""
    last = eventlog.latest(messages(spark, sf_dir).select("orderKey", "seq", "status", "topic"), ["orderKey"], "seq")
    fields = last.select(F.col("orderKey").alias("key"), F.create_map(F.lit("status"), "status", F.lit("topic"), "topic").alias("fields"))
    return fields.select("key", F.element_at("fields", "status").alias("status"), F.element_at("fields", "topic").alias("topic"))


@query(f"with {MSG_SQL} select seq, payload from msg where contains(payload, '42') order by seq limit 1")
def log_substring_find(spark, sf_dir):
    return messages(spark, sf_dir).filter(F.contains("payload", F.lit("42"))).orderBy("seq").limit(1).select("seq", "payload")


@query(f"with {MSG_SQL} select seq, payload from msg where seq > 100 order by seq limit 10")
def logs_cursor_page(spark, sf_dir):
    return eventlog.after_key(messages(spark, sf_dir).select("seq", "payload"), "seq", 100, 10)
