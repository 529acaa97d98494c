"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaflux.llm import decontaminate, host_quality, html_text, katz, language_id, sentencepiece_scan, simhash, substring_dedup, suffix_dedup, url_filter
from viaflux.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_remainder(key: str, mod: int):
    """crc32 of the key as text, modulo."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.host_quality(_table(spark, sf_dir, "documents")).drop("host_rate")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = F.coalesce(held_out_remainder("doc_id", 4) == 2, F.lit(False))
    profiles = language_id.fit_profiles(docs.where(~out))
    src = docs.select("doc_id", out.alias("held_out"), "text")
    return language_id.predict(src, profiles).drop("text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.token_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1,
        "op2_host_quality": op2,
        "op3_katz": op3,
        "op4_decontaminate": op4,
        "op5_suffix_dedup": op5,
        "op6_url_filter": op6,
        "op7_substring_dedup": op7,
        "op8_language_id": op8,
        "op9_simhash": op9,
        "op10_sentencepiece": op10,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
