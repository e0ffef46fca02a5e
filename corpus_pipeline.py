"""Corpus preparation: numbered operators applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of ``documents``.  Rows with null ids, null texts or repeats
pass as the operators' docstrings say; empty tables give empty results.
"""
from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from heatwise.llm import neardup, packing, quality, secrets, toxicity
from heatwise.llm.scratch import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.fit(docs, labels).score(docs, score_col="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are probably of low quality go."""
    return quality.keep_good(docs, Scratch(spark, "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows the text."""
    clean = docs.withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                            .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_poor),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = scratch.keep(stage(spark, rows, sf_dir), name, "snappy")
    return rows


#: Learned models, sampling and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
