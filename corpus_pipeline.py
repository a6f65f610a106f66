"""The corpus pipeline: language ID, quality rules, near-duplicates, packing. Counts as part of subpackage llm.

Each stage works on all that its predecessor kept. The documents go from stage to stage as Parquet in the folder that
driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import language_id, near_dedup, packing, quality_rules
from pointweave.llm.common import stored

#: A document whose best language has less than this share of the probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def kept_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id (null is one, too) decided (doc_id, kept) keeps, with the columns of docs.

    Rows that repeat a doc_id stay if any of them is kept."""
    kept = decided.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not `und` (as of null text and text without letters), and no doubt about which. Where the column lang is null, it gets the language found."""
    found = language_id.identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    kept = kept.groupBy(F.col("doc_id").alias("_kept")).agg(F.min("lang_pred").alias("_found"))
    met = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]))
    return met.withColumn("lang", F.coalesce("lang", "_found")).select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language; null text passes none."""
    return kept_rows(docs, quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id; null text is in no group and stays."""
    return kept_rows(docs, near_dedup.near_duplicates(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in their sequences; null text is a separator alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality rules", rules),
    ("MinHash near-dedup", near_duplicates),
    ("packing", packed),
]

#: SQL has no tokenizer, no trained language model and no packing; the tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
