"""Queries on queue state, dashboards and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import dashboard, workflow
from tidelog.plans.registry import query
from tidelog.sources.views import BRANCH_SQL, MSG_SQL, branches, messages, table

HOUR = 3600
_SAMPLE_SQL = f"""{MSG_SQL}, sample as (select us // 3600000000 * 3600 bucket_s, count(*) total, count(*) filter (status = 'published') pending,
  greatest(0, count(*) - count(*) filter (status = 'published')) ready from msg group by 1)"""


def _samples(spark, sf_dir):
    return dashboard.depth_samples(messages(spark, sf_dir), HOUR)


@query(f"with {_SAMPLE_SQL} select * from sample")
def depth_sample(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(f"with {_SAMPLE_SQL} select * from sample where bucket_s > (select max(bucket_s) from sample) - 172800")
def depth_retention(spark, sf_dir):
    return dashboard.retained(_samples(spark, sf_dir))


@query(f"with {_SAMPLE_SQL} select * from sample where bucket_s >= (select max(bucket_s) from sample) - 18000")
def depth_trailing(spark, sf_dir):
    from tidelog.functions.text import duration_seconds

    seconds = spark.range(1).select(duration_seconds(F.lit("5h"))).first()[0]
    return dashboard.since_last(_samples(spark, sf_dir), seconds)


@query(f"with {_SAMPLE_SQL} select *, (row_number() over (order by bucket_s) - 1) // 100 as page from sample")
def depth_pages(spark, sf_dir):
    return dashboard.numbered_pages(_samples(spark, sf_dir), 100)


@query(f"with {_SAMPLE_SQL} select bucket_s, total, pending, ready from sample where bucket_s between 1704153600 and 1705276800 order by bucket_s, total limit 20 offset 10")
def depth_range_page(spark, sf_dir):
    ranged = _samples(spark, sf_dir).filter("bucket_s between 1704153600 and 1705276800")
    return ranged.orderBy("bucket_s", "total").offset(10).limit(20)


@query(f"with {_SAMPLE_SQL} select count(*) n from sample where bucket_s between 1704153600 and 1705276800")
def zcount_range(spark, sf_dir):
    return _samples(spark, sf_dir).filter("bucket_s between 1704153600 and 1705276800").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SAMPLE_SQL} select count(*) n from sample")
def zcard(spark, sf_dir):
    return _samples(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SAMPLE_SQL} select bucket_s, total // 10 as total_rate, pending // 10 as pending_rate from sample")
def message_rate(spark, sf_dir):
    return _samples(spark, sf_dir).select("bucket_s", F.expr("total div 10").alias("total_rate"), F.expr("pending div 10").alias("pending_rate"))


@query(f"with {MSG_SQL}, r as (select seq, payload, priority, row_number() over (order by priority, seq) - 1 rn from msg where topic = 'signup' and channel = 'ch0') select seq, priority, rn as rank from r where rn between 10 and 19")
def zrange_decode(spark, sf_dir):
    """Members of one set by rank, decoded: a page of a top-k, so ranks come from the page and not from a window over all."""
    rows = messages(spark, sf_dir).filter("topic = 'signup' and channel = 'ch0'")
    page = rows.select("seq", F.get_json_object("payload", "$.k").cast("int").alias("priority")).orderBy("priority", "seq").offset(10).limit(10)
    from pyspark.sql import Window

    return page.withColumn("rank", (F.row_number().over(Window.orderBy("priority", "seq")) + 9).cast("long"))


@query(f"with {MSG_SQL} select channel, topic, count(*) total, count(*) filter (status = 'published') pending, greatest(0, count(*) - count(*) filter (status = 'published')) ready from msg group by channel, topic")
def queue_depth(spark, sf_dir):
    return dashboard.queue_depth(messages(spark, sf_dir))


_QUEUES_SQL = """, q as (select channel, topic, moodType, count(*) size from msg {where} group by all)
  select channel, string_agg(topic || '/' || moodType || '=' || size, ',' order by topic, moodType) as queues from q group by channel"""


def _queue_text(queues):
    text = F.transform("queues", lambda q: F.concat(q["topic"], F.lit("/"), q["moodType"], F.lit("="), q["size"].cast("string")))
    return queues.select("channel", F.array_join(text, ",").alias("queues"))


@query(f"with {MSG_SQL}{_QUEUES_SQL.format(where='')}")
def queue_list(spark, sf_dir):
    return _queue_text(dashboard.queues_by_channel(messages(spark, sf_dir)))


@query(f"with {MSG_SQL}" + _QUEUES_SQL.format(where="where moodType = 'delay'"))
def schedule_list(spark, sf_dir):
    return _queue_text(dashboard.queues_by_channel(messages(spark, sf_dir).filter("moodType = 'delay'")))


@query(
    f"""with {MSG_SQL} select count(distinct channel || ':' || topic) queues, count(*) db_size, count(*) filter (status = 'failed' and logType = 'logic') failed,
    count(*) filter (status = 'success' and logType = 'logic') succeeded from msg"""
)
def dashboard_total(spark, sf_dir):
    logic = F.col("logType") == "logic"
    return messages(spark, sf_dir).agg(
        F.count_distinct(F.concat_ws(":", "channel", "topic")).alias("queues"),
        F.count(F.lit(1)).alias("db_size"),
        F.count_if(logic & (F.col("status") == "failed")).alias("failed"),
        F.count_if(logic & (F.col("status") == "success")).alias("succeeded"),
    )


@query(
    f"""with {MSG_SQL}, b as (select hostName, seq, us // 1000000 + 50 expired_s, row_number() over (partition by hostName order by seq desc) rn from msg)
    select hostName, seq, expired_s from b where rn = 1 and expired_s >= (select max(us) // 1000000 from msg) - 600"""
)
def pod_liveness(spark, sf_dir):
    log = messages(spark, sf_dir)
    now_s = log.agg(F.expr("max(us) div 1000000")).first()[0] or 0
    return dashboard.live_hosts(log.select("hostName", "seq", (F.expr("us div 1000000") + 50).alias("expired_s")), now_s - 600)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in _TABLES))
def table_stats(spark, sf_dir):
    """Rows of each table; counts come from the files' footers."""
    names = _TABLES
    counted = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = counted[0]
    for one in counted[1:]:
        out = out.union(one)
    return out


_TASKS_SQL = "tasks as (select distinct gid, cast(branch_id as int) - 1 as position, 'task' || branch_id as task_id from branch)"


def _tasks(spark, sf_dir):
    return branches(spark, sf_dir).select("gid", (F.col("branch_id").cast("int") - 1).alias("position"), F.concat(F.lit("task"), "branch_id").alias("task_id")).distinct()


@query(
    f"""with {BRANCH_SQL}, {_TASKS_SQL} select gid, task_id, lpad(cast(position + 1 as varchar), 2, '0') branch_id, op, cast(position * 2 + nth as int) idx, 'prepared' status
    from tasks, (values (0, 'compensate'), (1, 'action')) o(nth, op)"""
)
def workflow_expand(spark, sf_dir):
    return workflow.expand(_tasks(spark, sf_dir))


@query(f"with {BRANCH_SQL} select gid, idx from (select *, lag(status, 2) over (partition by gid order by idx) p from branch) where idx % 2 = 1 and status = 'prepared' and (idx < 2 or p = 'succeed')")
def workflow_next_action(spark, sf_dir):
    return workflow.next_actions(branches(spark, sf_dir))


@query(
    f"""with {BRANCH_SQL} select gid, idx from (select *, lead(status, 1) over w s1, lead(status, 2) over w s2, lead(status, 3) over w s3 from branch window w as (partition by gid order by idx))
    where idx % 2 = 0 and status = 'prepared' and s1 <> 'prepared' and (s2 is null or s2 = 'succeed' or s3 = 'prepared')"""
)
def workflow_next_compensate(spark, sf_dir):
    return workflow.next_compensations(branches(spark, sf_dir))


@query(
    f"""with {BRANCH_SQL}, s as (select gid, count(*) filter (op = 'action') n_actions, count(*) filter (op = 'action' and status = 'succeed') n_done,
    count(*) filter (op = 'action' and status = 'failed') n_failed, count(*) filter (op <> 'action' and status = 'prepared') n_open from branch group by gid)
    select gid, case when n_done = n_actions then 'succeed' when n_failed > 0 and n_open = 0 then 'failed' when n_failed > 0 then 'aborting' else 'prepared' end status, n_actions, n_done, n_failed from s"""
)
def workflow_rollup(spark, sf_dir):
    return workflow.rolled_up(branches(spark, sf_dir))


@query(f"with {MSG_SQL} select seq, case when status <> 'failed' or priority < 20 then 'succeed' when priority > 80 then '' else 'failed' end as status from msg")
def branch_status(spark, sf_dir):
    """Errors are failed messages; those of low priority are skipped, those of high priority go on."""
    error = F.when(F.col("status") == "failed", F.lit("error"))
    return messages(spark, sf_dir).select("seq", workflow.outcome(error, F.col("priority") < 20, F.col("priority") > 80).alias("status"))


@query(f"with {BRANCH_SQL} select gid // 2 as gid, branch_id, op, min(gid * 6 + idx) as at from branch group by all")
def branch_unique(spark, sf_dir):
    """Of branches with the same id and operation in a workflow the first stays; two workflows of the view are one here."""
    rows = branches(spark, sf_dir).select(F.expr("gid div 2").alias("gid"), "branch_id", "op", (F.col("gid") * 6 + F.col("idx")).alias("at"))
    return workflow.first_of_each(rows, ["gid", "branch_id", "op"], "at")


_GLOBAL_SQL = f"{BRANCH_SQL}, g as (select gid, case when bool_or(status = 'failed') then 'aborting' else 'prepared' end status from branch group by gid)"


def _globals(spark, sf_dir):
    return branches(spark, sf_dir).groupBy("gid").agg(F.when(F.bool_or(F.col("status") == "failed"), "aborting").otherwise("prepared").alias("status"))


@query(f"with {_GLOBAL_SQL} select gid, status from g where status = 'aborting' and gid > 100 order by gid limit 25")
def trans_scan(spark, sf_dir):
    """The next workflows of a status after a cursor, by their id."""
    from tidelog.operators.eventlog import after_key

    return after_key(_globals(spark, sf_dir).filter("status = 'aborting'"), "gid", 100, 25)


@query(f"with {_GLOBAL_SQL} select gid, case when gid % 3 = 0 and status = 'prepared' then 'succeed' else status end as status from g")
def trans_cas(spark, sf_dir):
    stored = _globals(spark, sf_dir)
    changes = stored.filter("gid % 3 = 0").select("gid", F.lit("prepared").alias("expected"), F.lit("succeed").alias("new"))
    return workflow.compare_and_set(stored, changes)


@query(f"with {_GLOBAL_SQL} select gid, case when gid % 2 = 0 then status else 'new' end as status from g")
def trans_save_new(spark, sf_dir):
    every = _globals(spark, sf_dir)
    return workflow.save_new(every.filter("gid % 2 = 0"), every.select("gid", F.lit("new").alias("status")))


@query(f"with {_GLOBAL_SQL} select b.gid, idx, case when b.idx = 1 and g.status = 'prepared' then 'succeed' else b.status end as status from branch b join g on g.gid = b.gid")
def branch_upsert(spark, sf_dir):
    stored = branches(spark, sf_dir).select("gid", "idx", "status")
    changes = stored.filter("idx = 1").withColumn("status", F.lit("succeed"))
    return workflow.upsert_branches(stored, changes, _globals(spark, sf_dir), "prepared")


@query(f"with {BRANCH_SQL}, {_TASKS_SQL} select b.gid, b.idx, b.op, t.task_id from branch b join tasks t on t.gid = b.gid and t.position = cast(b.branch_id as int) - 1")
def branch_task_join(spark, sf_dir):
    own = branches(spark, sf_dir).withColumn("position", F.col("branch_id").cast("int") - 1)
    return own.join(_tasks(spark, sf_dir), ["gid", "position"]).select("gid", "idx", "op", "task_id")


@query(f"with {_GLOBAL_SQL} select b.gid, b.idx, b.status as branch_status, g.status as global_status from branch b join g on g.gid = b.gid")
def workflow_state_join(spark, sf_dir):
    own = branches(spark, sf_dir).select("gid", "idx", F.col("status").alias("branch_status"))
    return own.join(_globals(spark, sf_dir).withColumnRenamed("status", "global_status"), "gid")


_RECORD_SQL = "rec as (select o_orderkey gid, o_orderpriority topic, o_orderstatus status, strftime(o_orderdate, '%Y-%m-%d') created from orders)"


def _records(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gid"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created")
    )


@query(f"with {_RECORD_SQL} select * from rec where status = 'F' order by created desc, gid desc limit 10 offset 10")
def workflow_list(spark, sf_dir):
    from tidelog.operators.eventlog import matching, page_of

    return page_of(matching(_records(spark, sf_dir), status="F", topic=""), 2, 10, F.desc("created"), F.desc("gid"))


@query(f"with {_RECORD_SQL} select * from rec where status = 'O' order by created, gid limit 10")
def workflow_logs_page(spark, sf_dir):
    from tidelog.operators.eventlog import matching, page_of

    return page_of(matching(_records(spark, sf_dir), status="O"), 1, 10, F.asc("created"), F.asc("gid"))


@query(f"with {_RECORD_SQL} select * from rec")
def workflow_record_write(spark, sf_dir):
    """Appends workflow records to a log and reads what it then holds."""
    from tidelog.sources.log_store import append, read

    return read(spark, append(_records(spark, sf_dir), "workflow-records", ["status"]))
