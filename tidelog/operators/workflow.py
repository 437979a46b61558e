"""Workflows of actions and compensations: expansion, what runs next, states, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _by_index() -> WindowSpec:
    """Branches of a workflow in order; their number is that of its tasks."""
    return Window.partitionBy("gid").orderBy("idx")


def expand(tasks: DataFrame) -> DataFrame:
    """Two branches a task(gid, position, task_id): compensation, then action; idx runs on, branch_id has two digits."""
    ops = F.posexplode(F.array(F.lit("compensate"), F.lit("action"))).alias("at", "op")
    return tasks.select("gid", "task_id", F.lpad((F.col("position") + 1).cast("string"), 2, "0").alias("branch_id"), "position", ops).select(
        "gid", "task_id", "branch_id", "op", (F.col("position") * 2 + F.col("at")).cast("int").alias("idx"), F.lit("prepared").alias("status")
    )


def next_actions(branches: DataFrame) -> DataFrame:
    """Actions that may run: prepared, and the action before them has succeeded."""
    before = F.lag("status", 2).over(_by_index())
    return branches.withColumn("before", before).filter("idx % 2 = 1 and status = 'prepared' and (idx < 2 or before = 'succeed')").select("gid", "idx")


def next_compensations(branches: DataFrame) -> DataFrame:
    """Compensations that may run: prepared, of an action that ran, and the next task needs none or has had it."""
    after = {k: F.lead("status", k).over(_by_index()) for k in (1, 2, 3)}
    seen = branches.withColumns({f"after{k}": c for k, c in after.items()})
    return seen.filter("idx % 2 = 0 and status = 'prepared' and after1 <> 'prepared' and (after2 is null or after2 = 'succeed' or after3 = 'prepared')").select("gid", "idx")


def rolled_up(branches: DataFrame) -> DataFrame:
    """(gid, status): succeed when all actions have, aborting when one failed, failed when all that ran are undone."""
    actions = F.col("op") == "action"
    state = branches.groupBy("gid").agg(
        F.count_if(actions).alias("n_actions"),
        F.count_if(actions & (F.col("status") == "succeed")).alias("n_done"),
        F.count_if(actions & (F.col("status") == "failed")).alias("n_failed"),
        F.count_if(~actions & (F.col("status") == "prepared")).alias("n_open"),
    )
    status = F.when(F.col("n_done") == F.col("n_actions"), "succeed").when((F.col("n_failed") > 0) & (F.col("n_open") == 0), "failed").when(F.col("n_failed") > 0, "aborting").otherwise("prepared")
    return state.select("gid", status.alias("status"), "n_actions", "n_done", "n_failed")


def outcome(error: Column, skipped: Column, ongoing: Column) -> Column:
    """Status of a branch after a run: no error or a skipped one is success, an ongoing one changes nothing."""
    return F.when(error.isNull() | skipped, "succeed").when(ongoing, F.lit("")).otherwise("failed")


def first_of_each(branches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: later ones with the same key are conflicts."""
    columns = [c for c in branches.columns if c not in keys]
    first = branches.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(order)).alias("first"))
    return first.select(*keys, *(F.col(f"first.{c}").alias(c) for c in columns))


def compare_and_set(old: DataFrame, changes: DataFrame) -> DataFrame:
    """old(gid, status) after changes(gid, expected, new): only where the stored status is the expected one."""
    joined = old.join(changes, "gid", "left")
    return joined.select("gid", F.when(F.col("status") == F.col("expected"), F.col("new")).otherwise(F.col("status")).alias("status"))


def save_new(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved with the rows of new whose gid is not there yet; where it is, the saved rows go on."""
    return saved.unionByName(new.join(saved.select("gid").distinct(), "gid", "left_anti"))


def upsert_branches(stored: DataFrame, changes: DataFrame, states: DataFrame, expected: str) -> DataFrame:
    """stored(gid, idx, status) with changes set at their idx, for workflows whose state(gid, status) is expected."""
    allowed = changes.join(states.filter(F.col("status") == expected).select("gid"), "gid", "left_semi")
    return stored.join(allowed.select("gid", "idx"), ["gid", "idx"], "left_anti").unionByName(allowed)
