"""Queries on accounts, roles, alert rules and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import admin, eventlog
from tidelog.plans.registry import query
from tidelog.sources.views import MSG_SQL, messages, table

_USER_SQL = """usr as (select c_custkey id, c_name account, c_nationkey roleId, c_mktsegment type, case when c_custkey % 4 = 0 then 0 else 1 end active, '' detail from customer)"""
_ROLE_SQL = "rol as (select n_nationkey roleId, n_name name, [n_regionkey, n_nationkey] roles from nation)"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("account"),
        F.col("c_nationkey").alias("roleId"),
        F.col("c_mktsegment").alias("type"),
        F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(1).alias("active"),
        F.lit("").alias("detail"),
    )


def _roles(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("roleId"), F.col("n_name").alias("name"), F.array("n_regionkey", "n_nationkey").alias("roles"))


@query(f"with {_USER_SQL} select id, account from usr order by account, id limit 10 offset 10")
def user_page(spark, sf_dir):
    return eventlog.page_of(_users(spark, sf_dir).select("id", "account"), 2, 10, F.asc("account"), F.asc("id"))


@query(f"with {_USER_SQL} select id, account from usr where regexp_matches(account, '00[1-3]$', 'i')")
def user_regex(spark, sf_dir):
    return admin.account_matches(_users(spark, sf_dir).select("id", "account"), "00[1-3]$")


@query(f"with {_USER_SQL}, {_ROLE_SQL} select id, account, usr.roleId, name as roleName, array_to_string(roles, ',') as roles from usr join rol using (roleId)")
def user_role_join(spark, sf_dir):
    joined = admin.with_roles(_users(spark, sf_dir).select("id", "account", "roleId"), _roles(spark, sf_dir))
    return joined.withColumn("roles", F.array_join(F.col("roles").cast("array<string>"), ","))


_MAIL_SQL = "mail as (select * replace (case when id % 5 = 0 then account else 'c' || id || '@shop.org' end as account) from usr)"


@query(f"with {_USER_SQL}, {_ROLE_SQL}, {_MAIL_SQL} select id, account from mail join rol using (roleId) where active = 1 and regexp_matches(account, '{admin.EMAIL}') and list_contains(roles, 3)")
def role_check(spark, sf_dir):
    """Active users with a right; accounts that are no e-mail addresses have none."""
    mail = F.when(F.col("id") % 5 == 0, F.col("account")).otherwise(F.concat(F.lit("c"), "id", F.lit("@shop.org")))
    return admin.may(_users(spark, sf_dir).withColumn("account", mail), _roles(spark, sf_dir), F.lit(3)).select("id", "account")


@query(f"with {_ROLE_SQL} select roleId, name from rol order by name limit 10")
def role_page(spark, sf_dir):
    return eventlog.page_of(_roles(spark, sf_dir).select("roleId", "name"), 1, 0, F.asc("name"))


@query("select s_suppkey as id, s_name as name from supplier order by s_name limit 10")
def tenant_page(spark, sf_dir):
    return eventlog.page_of(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), 0, 10, F.asc("name"))


@query("select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as addTime, o_orderpriority as uri from orders order by o_orderdate, o_orderkey limit 10 offset 20")
def opt_log_page(spark, sf_dir):
    logs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("addTime"), F.col("o_orderpriority").alias("uri"))
    return eventlog.page_of(logs, 3, 10, F.asc("addTime"), F.asc("id"))


@query(f"with {_USER_SQL} select id, account from usr where active = 1 and type = 'BUILDING'")
def active_users(spark, sf_dir):
    return _users(spark, sf_dir).filter("active = 1 and type = 'BUILDING'").select("id", "account")


@query(f"with {_USER_SQL} select id, account, case when id % 6 = 0 then 'google' else type end type, case when id % 3 = 0 then 'edited' else detail end detail from usr")
def partial_update(spark, sf_dir):
    users = _users(spark, sf_dir).select("id", "account", "type", "detail")
    changes = users.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "google").otherwise("").alias("type"), F.lit("edited").alias("detail"))
    return eventlog.partial_update(users, changes, "id", ["type", "detail"])


@query(f"with {_USER_SQL} select id, case when id % 5 = 0 then 'new' else account end account from usr")
def upsert_latest(spark, sf_dir):
    users = _users(spark, sf_dir).select("id", "account")
    return eventlog.upsert_latest(users, users.filter("id % 5 = 0").withColumn("account", F.lit("new")), ["id"])


#: Rules as they are configured: kinds, channel, topics (none: all), ways to send.
RULES = [
    (1, ["dlq"], "ch1", [], ["email"]),
    (2, ["failed"], "ch2", ["error", "view"], ["email", "slack"]),
    (3, ["failed", "dlq"], "ch3", [], ["slack"]),
    (4, ["system"], "", [], ["slack"]),
    (5, ["dlq"], "ch2", ["error"], ["email"]),
]
_RULE_SQL = "rule(rule, kinds, channel, topics, send) as (values " + ", ".join(f"({r}, {k}, '{c}', {t}::varchar[], {s})" for r, k, c, t, s in RULES) + ")"


def _rules(spark):
    return spark.createDataFrame(RULES, "rule int, when array<string>, channel string, topics array<string>, then array<string>")


_MATCH_SQL = f"""{MSG_SQL}, {_RULE_SQL}, hit as (
  select seq, msg.channel, topic, rule, send from msg join rule on rule.channel = msg.channel
  where status = 'failed' and (logType = 'dlq' and list_contains(kinds, 'dlq') and len(topics) = 0
    or logType = 'logic' and list_contains(kinds, 'failed') and (len(topics) = 0 or list_contains(topics, topic))))"""


def _alerts(spark, sf_dir):
    failed = messages(spark, sf_dir).filter("status = 'failed'").select("seq", "channel", "topic", "logType")
    dead = admin.matched_rules(failed.filter("logType = 'dlq'"), _rules(spark), "dlq")
    return dead.unionByName(admin.matched_rules(failed.filter("logType = 'logic'"), _rules(spark), "failed")).select("seq", "channel", "topic", "rule", "then")


@query(f"with {_MATCH_SQL} select seq, channel, topic, rule from hit")
def alert_match(spark, sf_dir):
    return _alerts(spark, sf_dir).drop("then")


@query(f"with {_MATCH_SQL} select seq, rule, unnest(send) as target from hit")
def alert_dispatch(spark, sf_dir):
    return admin.dispatched(_alerts(spark, sf_dir)).select("seq", "rule", "target")


@query(f"with {MSG_SQL} select channel, topic, count(*) filter (status <> 'failed') >= count(*) // 2 + 1 as reached from msg group by channel, topic")
def quorum(spark, sf_dir):
    """Whether more than half of the answers of a group are good."""
    good = F.count_if(F.col("status") != "failed") >= F.floor(F.count(F.lit(1)) / 2) + 1
    return messages(spark, sf_dir).groupBy("channel", "topic").agg(good.alias("reached"))


@query(f"with {MSG_SQL} select seq, us + 8000000 - priority * 1000 - 80000 as until_us from msg where moodType = 'sequential_by_lock'")
def mutex_until(spark, sf_dir):
    """The end of a lock's validity: eight seconds less the time it took to get, less a hundredth for drifting clocks."""
    rows = messages(spark, sf_dir).filter("moodType = 'sequential_by_lock'")
    return rows.select("seq", (F.col("us") + 8_000_000 - F.col("priority") * 1000 - 8_000_000 // 100).alias("until_us"))


_NAME_SQL = "case when p_partkey % 10 = 0 then 'abc_' else cast(20260108000 + p_partkey as varchar) || '_' end || replace(p_name, ' ', '-') || '.up.json'"
_MIGRATION_SQL = f"m as (select {_NAME_SQL} as name from part), v as (select name, coalesce(try_cast(string_split(name, '_')[1] as bigint), 0) as version from m)"


def _migrations(spark, sf_dir):
    key = F.col("p_partkey")
    front = F.when(key % 10 == 0, "abc_").otherwise(F.concat((key + 20260108000).cast("string"), F.lit("_")))
    named = table(spark, sf_dir, "part").select(F.concat(front, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".up.json")).alias("name"))
    return named.withColumn("version", admin.version_of(F.col("name")))


@query(f"with {_MIGRATION_SQL} select name, version from v order by version, name")
def migration_order(spark, sf_dir):
    return _migrations(spark, sf_dir).orderBy("version", "name")


@query(f"with {_MIGRATION_SQL} select name, version from v where version > 20260108100")
def migration_pending(spark, sf_dir):
    return admin.pending_migrations(_migrations(spark, sf_dir), 20260108100)
