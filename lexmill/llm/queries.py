"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.bpe import digest, encode_decode
from lexmill.llm.common import table
from lexmill.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from lexmill.llm.html_extract import extract
from lexmill.llm.langid import language_id
from lexmill.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from lexmill.llm.media import media_columns
from lexmill.llm.minhash import near_components
from lexmill.llm.packing import pack
from lexmill.llm.quality import quality
from lexmill.llm.substring_dedup import substring_dedup


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_line_dedup, op3_suffix_array, op4_bpe, op5_language_id, op6_quality, op7_minhash, op8_media, op9_html, op10_exact_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL}
