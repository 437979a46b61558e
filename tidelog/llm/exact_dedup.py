"""Exact deduplication: 128-bit content hash, byte comparison inside the groups, one stable row kept."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import text_or_empty, written

#: Deleted before texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"
_SHIFT = Decimal(2**64)


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are byte for byte the same after white space is deleted. The row with the most
    code points in its original text stays, then that of the smallest doc_id.

    Rows are grouped by (content hash, text): the hash picks the partition and the group's slot, the text's bytes
    decide, so texts of one hash but different bytes stay apart. Grouping combines on the map side, so a group of
    any size arrives as one row per task. The SHA-256 of the text leads a row back to its group; were two different
    texts to agree in both digests, the job would stop rather than merge them.

    Null text counts as empty; empty texts are one group. Rows that repeat the kept row's doc_id and length are
    kept like it. A null doc_id never stays while another row of the group has an id; where none has, keep_id is
    null and the rows are kept. Other columns of docs are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    normal = F.translate(text_or_empty("text"), WHITE_SPACE, "")
    # One fixed-width number orders rows by length, then by smaller id, so that the aggregate stays hash-based.
    order = F.char_length(text_or_empty("text")).cast("decimal(10,0)") * F.lit(_SHIFT) - F.col("doc_id").cast("decimal(20,0)")
    rows = docs.select("doc_id", F.char_length(text_or_empty("text")).alias("n_points"), order.alias("rank"), normal.alias("normal"))
    hashed = rows.select("doc_id", "n_points", "rank", "normal", content_hash(F.col("normal")).alias("h"), F.sha2("normal", 256).alias("text_sha256"))
    # A table of the digests: a join on them would make them anew for its filter and for its keys.
    digests = written(spark, hashed.drop("normal", "n_points"), "exact-digests")
    groups = hashed.groupBy("h", "text_sha256", "normal").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best_rank"), F.max(F.when(F.col("rank").isNotNull(), F.col("n_points"))).alias("best_points")
    )
    kept_id = F.col("best_points").cast("decimal(10,0)") * F.lit(_SHIFT) - F.col("best_rank")
    groups = written(spark, groups.select("h", "text_sha256", "group_size", "best_rank", kept_id.cast("long").alias("keep_id")), "exact-groups")
    if groups.groupBy("h", "text_sha256").count().filter("count > 1").limit(1).count():
        raise ValueError("two different texts agree in the content hash and in SHA-256")
    return digests.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("rank").eqNullSafe(F.col("best_rank")).alias("kept"), "text_sha256"
    )
