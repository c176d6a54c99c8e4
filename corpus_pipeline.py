"""The corpus pipeline: stages that each turn documents into documents, the last into token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomite.llm import bpe_bitmap, mixing, near_dedup, quality_ftrl, quality_rules
from fathomite.llm.common import materialize
from fathomite.llm.queries import RANKS


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts. It learns from all labelled documents of the training fold,
    also those that the rules have rejected: they are what it knows bad text from."""
    model = quality_ftrl.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_ftrl.keep_scored(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id: 5-word shingles, similarity 0.8."""
    return near_dedup.keep_one_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the documents as the target weights of their sources take them, up to twice."""
    return mixing.mix_documents(docs, length_col="n_chars")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids); each row's ids are decoded and compared with its text."""
    return bpe_bitmap.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("lang", "source"), verify=True)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("source_mixing", mixing_stage),
    ("byte_level_bpe", encoding_stage),
]
#: The classifier's weights, the fingerprints and the token ids are beyond SQL; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
