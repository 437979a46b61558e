"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.byte_bpe import bpe_digest
from tidelog.llm.decontamination import find_items
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.language_id import identify_languages
from tidelog.llm.license_scan import license_scan
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.near_dedup import near_dedup
from tidelog.llm.secret_scan import secret_scan
from tidelog.llm.shared import table
from tidelog.llm.token_files import token_file_digest
from tidelog.llm.warc import archive_pages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_exact_dedup,
        op3_language_id,
        op4_license_scan,
        op5_near_dedup,
        op6_token_files,
        op7_byte_bpe,
        op8_secret_scan,
        op9_decontamination,
        op10_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from tidelog.llm.oracles import ORACLES

    return dict(ORACLES)
