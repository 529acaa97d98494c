"""A training corpus from raw documents: five stages, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A null or empty text is rejected by the first stage; repeated rows are
copies of each other and one stays; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaflux.llm import decontaminate, language_id, sentencepiece_scan, simhash, substring_dedup
from viaflux.llm.registry import held_out_remainder
from viaflux.storage import Scratch

#: Documents with a lower score (0 to 1) are in no known language. Labelled documents score from 0.40 on (median 0.65 to 0.77), random
#: letters, base64 and languages that were not learned up to 0.34 from forty letters on; less than that tells nothing.
MIN_LANGUAGE_SCORE = 0.36
MIN_LETTERS = 40


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars counted anew."""
    return df.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, and those with a few letters only."""
    held_out = F.coalesce(held_out_remainder("doc_id", 4) == 2, F.lit(False))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    found = language_id.predict(docs, language_id.fit_profiles(docs.where(~held_out)), prefix="__")
    return found.where((F.col("__lang_pred") != language_id.UNKNOWN) & ((F.col("__score") >= MIN_LANGUAGE_SCORE) | (letters < MIN_LETTERS))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a Jaccard similarity of 0.8 in five-word shingles the first row stays."""
    # rows in a struct, so that no name can clash; written, so that row numbers are the same at every reading
    rows = Scratch(spark).write(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    first = simhash.similar_firsts(rows.select("id", F.col("row.text").alias("text")), key="id")
    return rows.join(first, "id", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document of nothing else goes with them."""
    return _like(substring_dedup.dedup(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with token ids (little-endian 32-bit numbers), their count, and whether they decode to the text."""
    both = sentencepiece_scan.decode(sentencepiece_scan.encode(docs))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], "sp_ids", F.expr("cast(octet_length(sp_ids) div 4 as bigint)").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The stages fit profiles, fingerprints and segmentations that SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
