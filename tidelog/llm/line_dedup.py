"""Line deduplication over overlapping windows of three lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import text_or_empty

WINDOW_LINES = 3


def _lines() -> Column:
    return F.split(text_or_empty("text"), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, position, a, b, place) of each window that has a line which is not blank.

    a and b are a 128-bit identity of the three lines; place is one number that orders windows by (doc_id, position).
    """
    hashed = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty("text")).alias("text_hash"),
        F.transform(
            _lines(),
            lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.trim(x) == "").alias("blank")),
        ).alias("h"),
    )
    hashed = hashed.filter(F.col("doc_id").isNotNull() & (F.size("h") >= WINDOW_LINES))
    count = F.size("h") - (WINDOW_LINES - 1)
    zipped = F.arrays_zip(*(F.slice("h", k + 1, count).alias(f"l{k}") for k in range(WINDOW_LINES)))
    parts = [F.col(f"w.l{k}") for k in range(WINDOW_LINES)]
    blank = parts[0]["blank"]
    for part in parts[1:]:
        blank = blank & part["blank"]
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("position").cast("decimal(10,0)")
    return (
        hashed.select("doc_id", "text_hash", F.posexplode(zipped).alias("position", "w"))
        .filter(~blank)
        .select("doc_id", "text_hash", "position", F.xxhash64(*(p["a"] for p in parts)).alias("a"), F.xxhash64(*(p["b"] for p in parts)).alias("b"), place.alias("place"))
    )


def cut_rows(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed): each row of docs as a struct, and what :func:`line_dedup` makes of its text."""
    windows = _windows(docs)
    repeated = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")).filter("n > 1").select("a", "b", "first_place")
    later = windows.join(repeated, ["a", "b"]).filter("place > first_place")
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.array(*(x + F.lit(k) for k in range(WINDOW_LINES))))))
    islands = starts.select("doc_id", "text_hash", covered.alias("covered")).select(
        "doc_id",
        "text_hash",
        F.size("covered").alias("n_removed"),
        F.sort_array(F.array_except("covered", F.transform("covered", lambda x: x + 1))).alias("begins"),
        F.sort_array(F.array_except("covered", F.transform("covered", lambda x: x - 1))).alias("ends"),
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(text_or_empty("text")).alias("text_hash"))
    joined = rows.join(islands, ["doc_id", "text_hash"], "left")
    joined = joined.select("row", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "begins", "ends", F.split(F.coalesce("row.text", F.lit("")), "\n", -1).alias("lines"))
    segments = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("ends", lambda x: x + 1)).alias("from_line"), F.concat(F.col("begins"), F.array(F.size("lines"))).alias("to_line")
    )
    cut = joined.withColumn("segments", F.when(F.col("n_removed") > 0, segments))
    kept = F.flatten(F.transform("segments", lambda s: F.slice("lines", s["from_line"] + 1, s["to_line"] - s["from_line"])))
    text = F.when(F.col("n_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("row.text"))
    return cut.select("row", text.alias("text"), F.size("lines").alias("n_lines"), "n_removed")


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text without repeated passages, n_lines, n_removed.

    A window is three consecutive lines, taken at each line. Of windows with the same lines, the first by
    (doc_id, position) in all documents stays; the lines that later ones cover are removed, merged where windows
    overlap. Lines end at a line feed and count as they are; a window of blank lines never counts.

    Windows are counted with map-side sums, so a passage in a third of the rows reaches its reducer as one row a task;
    the join that leads back to the documents is one that Spark splits where a key is hot. What a document loses is
    gathered by document, and so is bounded by one row's text.

    Null text stays null, with one empty line; texts under three lines stay. Rows with a null doc_id stay unchanged
    and count for nothing. Rows of one doc_id that repeat each other count as one document: neither loses what the
    other has at the same place. Other columns of docs are ignored. An empty table gives an empty result.
    """
    return cut_rows(docs.select("doc_id", "text")).select("row.doc_id", "text", "n_lines", "n_removed")
