"""Queries on handlers, tries that stop, ordered publishing and logins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import admin, handlers
from tidelog.operators.delivery import MICROS
from tidelog.plans.admin_queries import _ROLE_SQL, _USER_SQL, _roles, _users
from tidelog.plans.log_queries import _chain_sql
from tidelog.plans.registry import query
from tidelog.sources.views import MSG_SQL, messages, table

_FAILED_SQL = "case when topic = 'error' then 'bad ' || id end"


@query(
    f"""with {MSG_SQL}, h as (select seq, {_FAILED_SQL} failed, case when seq % 3 = 0 then 'not undone' end cancelled from msg)
    select seq, case when failed is null then null when cancelled is null then failed else failed || chr(10) || cancelled end as error,
    case when failed is null then 'success' else 'failed' end as status, 0 as retry from h"""
)
def handler_errors(spark, sf_dir):
    """A handler that fails for topic error and can't always cancel."""
    failed = F.when(F.col("topic") == "error", F.concat(F.lit("bad "), "id"))
    handler = handlers.Handle(failed, F.when(F.col("seq") % 3 == 0, "not undone"))
    return handlers.handled(messages(spark, sf_dir).select("seq", "topic", "id"), handler).drop("topic", "id")


@query(f"with {MSG_SQL} select seq, 'handle is nil' || chr(10) || 'cancel is nil' as error, 'failed' as status, 0 as retry from msg where logType = 'dlq'")
def handler_default(spark, sf_dir):
    """A handler with nothing in it."""
    return handlers.handled(messages(spark, sf_dir).filter("logType = 'dlq'").select("seq"), handlers.Handle())


_TRIES_SQL = f"""{MSG_SQL}, t as (select seq, seq % 4 last, unnest(range(0, 5)) attempt from msg where status = 'failed'),
    e as (select *, case when (seq + attempt) % 5 = 0 then null when (seq + attempt) % 7 = 0 then 'gone' else 'late ' || attempt end error from t)"""


@query(f"with {_TRIES_SQL} select seq, cast(min(attempt) as int) as tried, arg_min(coalesce(error, ''), attempt) as error from e where error is null or error = 'gone' or attempt >= last group by seq")
def retry_outcome(spark, sf_dir):
    """Tries of failed messages that end with a success, with an error that is not tried again, or with the last one."""
    tries = messages(spark, sf_dir).filter("status = 'failed'").select("seq", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt"))
    sum_ = F.col("seq") + F.col("attempt")
    error = F.when(sum_ % 5 == 0, F.lit(None)).when(sum_ % 7 == 0, "gone").otherwise(F.concat(F.lit("late "), F.col("attempt").cast("string")))
    ended = handlers.retry_outcome(tries.withColumn("error", error), ["seq"], F.col("seq") % 4, F.col("error").isin("gone"))
    return ended.withColumn("error", F.coalesce("error", F.lit("")))


def _publish_sql(key: str, mood: str, refusal: str) -> str:
    chain = _chain_sql(key, 6 * 3600 * MICROS, "accepted", "rejected", "named")
    chain = chain.replace(MSG_SQL, f"{MSG_SQL}, mine as (select * replace (case when seq % 13 = 0 then '' else id end as id) from msg where moodType = '{mood}'), named as (select * from mine where id <> '')")
    chain = chain.replace("select k as key, us, seq, decision from r", "")
    return f"""{chain}
    select m.seq, m.id, m.channel, m.topic, case when m.id = '' then 'id is required' when r.decision = 'rejected' then '{refusal}' end as error from mine m left join r on r.seq = m.seq"""


def _publishing(spark, sf_dir, mood):
    rows = messages(spark, sf_dir).filter(F.col("moodType") == mood)
    return rows.withColumn("id", F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("id")))


@query(_publish_sql("channel || ':' || topic || ':' || orderKey", "sequential", "duplicate"))
def publish_sequence(spark, sf_dir):
    """Publishing in sequence: a key that was taken within six hours is a duplicate."""
    rows = _publishing(spark, sf_dir, "sequential")
    return handlers.published_in_order(rows, F.concat_ws(":", "channel", "topic", "orderKey"), 6 * 3600 * MICROS, "duplicate").select("seq", "id", "channel", "topic", "error")


@query(_publish_sql("orderKey", "sequential_by_lock", handlers.LOCKED))
def publish_lock(spark, sf_dir):
    """Publishing by lock: while an order key is held, messages with it are refused."""
    rows = _publishing(spark, sf_dir, "sequential_by_lock")
    return handlers.published_in_order(rows, F.col("orderKey"), 6 * 3600 * MICROS, handlers.LOCKED).select("seq", "id", "channel", "topic", "error")


@query(
    """with t as (select event_id // 3 gid, event_id % 3 as position, case when event_type = 'error' then 'broken' end e, case when user_id % 4 = 0 then 'stuck' end r from events),
    f as (select gid, min(position) filter (e is not null) broken from t group by gid)
    select t.gid, t.position, case when broken is null then 'executed' when position = broken then 'failed' when position > broken then 'skipped' when r is null then 'rolled_back' else 'rollback_failed' end as outcome
    from t join f using (gid)"""
)
def workflow_run(spark, sf_dir):
    """Workflows of three tasks; those of error events fail, and some users' tasks can't be rolled back."""
    tasks = table(spark, sf_dir, "events").select(
        F.expr("event_id div 3").alias("gid"),
        (F.col("event_id") % 3).alias("position"),
        F.when(F.col("event_type") == "error", "broken").alias("execute_error"),
        F.when(F.col("user_id") % 4 == 0, "stuck").alias("rollback_error"),
    )
    return handlers.run_tasks(tasks).select("gid", "position", "outcome")


_LOGIN_SQL = "login as (select *, 'pw' || id % 10 as password from usr)"


def _logins(spark, sf_dir):
    return _users(spark, sf_dir).withColumn("password", F.concat(F.lit("pw"), (F.col("id") % 10).cast("string")))


@query(f"with {_USER_SQL}, {_ROLE_SQL}, {_LOGIN_SQL} select id, account, name as roleName from login join rol using (roleId) where account = 'Customer#000000007' and password = 'pw7' and active = 1")
def login(spark, sf_dir):
    """The account with its role, if it is active and the password is its own."""
    return admin.logged_in(_logins(spark, sf_dir), _roles(spark, sf_dir), "Customer#000000007", "pw7").select("id", "account", "roleName")


@query(f"with {_USER_SQL} select id, account from usr where account = 'Customer#000000018' and id % 6 = 0 and active = 1")
def login_by_type(spark, sf_dir):
    """An active account that logs in through another service."""
    users = _users(spark, sf_dir).withColumn("type", F.when(F.col("id") % 6 == 0, "google").otherwise(F.col("type")))
    return admin.logged_in_by(users, "Customer#000000018", "google").select("id", "account")
