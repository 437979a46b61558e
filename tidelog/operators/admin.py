"""Accounts, roles, alert rules, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the name and rights of their role; users without a role that exists are left out.

    Roles are not broadcast by hand: Spark does it where their size, which it knows, allows.
    """
    return users.join(roles.select("roleId", F.col("name").alias("roleName"), "roles"), "roleId")


# What counts as an e-mail address.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def may(users: DataFrame, roles: DataFrame, right: Column) -> DataFrame:
    """Active users whose account is an e-mail address and whose role has a right."""
    return with_roles(users.filter((F.col("active") == 1) & F.col("account").rlike(EMAIL)), roles).filter(F.array_contains("roles", right))


def logged_in(users: DataFrame, roles: DataFrame, account: str, password: str) -> DataFrame:
    """The active user of an account and password, with the role."""
    return with_roles(users.filter((F.col("account") == account) & (F.col("password") == password) & (F.col("active") == 1)), roles)


def logged_in_by(users: DataFrame, account: str, kind: str) -> DataFrame:
    """The active user of an account of a kind, as another service has named it; without a password."""
    return users.filter((F.col("account") == account) & (F.col("type") == kind) & (F.col("active") == 1))


def account_matches(users: DataFrame, pattern: str) -> DataFrame:
    """Users whose account has a match of the pattern anywhere, in either case."""
    return users.filter(F.col("account").rlike(f"(?i){pattern}"))


def matched_rules(log: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Log rows with each rule(rule, when, channel, topics, then) that they meet.

    A rule names the kinds it is for; those for ``system`` look no further. Others need the row's channel, and its
    topic among theirs, if they have any. Dead letters are matched by channel alone, against rules without topics.
    """
    wanted = rules.filter(F.array_contains("when", kind))
    if kind == "system":
        # Each row with each rule, through one constant key: Spark broadcasts the rules only where it knows them to be few.
        rules_of_all = wanted.drop("channel", "topics", "when").withColumn("_all", F.lit(1))
        return log.withColumn("_all", F.lit(1)).join(rules_of_all, "_all").drop("_all")
    topic = F.size("topics") == 0 if kind == "dlq" else (F.size("topics") == 0) | F.array_contains("topics", F.col("topic"))
    return log.join(wanted.drop("when"), "channel").filter(topic).drop("topics")


def dispatched(matches: DataFrame) -> DataFrame:
    """One row for each way in which a matched rule sends its alert."""
    return matches.withColumn("target", F.explode("then")).drop("then")


def version_of(name: Column) -> Column:
    """The number before the first underscore of a migration's name; 0 where there is none."""
    return F.coalesce(F.split(name, "_")[0].try_cast("long"), F.lit(0).cast("long"))


def pending_migrations(migrations: DataFrame, current: int) -> DataFrame:
    return migrations.filter(F.col("version") > current).orderBy("version")
