"""A corpus through five stages: language ID, line dedup, near dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.byte_bpe import bpe_digest
from tidelog.llm.decontamination import find_items
from tidelog.llm.language_id import UNKNOWN, language_of, train
from tidelog.llm.line_dedup import cut_rows
from tidelog.llm.near_dedup import near_dedup
from tidelog.llm.shared import table, written

#: A document goes when its language's score is under that of two even decisions.
LEAST_LANGUAGE_SCORE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter, or with a score no better than chance, go.

    The model learns from the labelled documents of the input. All columns stay as they are. Null and empty texts have no
    letter and go; rows that repeat each other stay or go together; null ids don't matter. Without any label all go.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), language_of(train(docs), docs).alias("found"))
    return named.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three or more lines that stood earlier; documents with no more than white space left go.

    n_chars is that of the new text. Rows with a null doc_id or text stay as they are; rows of one doc_id and text count
    as one document.
    """
    cut = cut_rows(docs).filter(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the first of their group of near copies, or alone.

    Rows of one doc_id are one document and stay or go together. Rows with a null doc_id and texts without words are
    linked with nothing and stay.
    """
    return docs.join(near_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands.

    Rows go by their id and text, so rows with a null doc_id go like others, and of rows of one doc_id only those that
    hold an item. Null and empty texts hold none.
    """
    own = F.xxhash64("doc_id", "text").alias("_own")
    found = find_items(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_own")).distinct()
    return docs.select("*", own).join(found, "_own", "left_anti").select(docs.columns)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids: doc_id, n_tokens, ids_sha256, decoded_sha256; a row for each row, null text as empty."""
    return bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_digests),
]
#: SQL can't express the language model or the merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
