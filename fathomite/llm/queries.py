"""Queries over the corpus tables, one for each operator, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_bitmap, fill_middle, html_region, importance, lang_cnn, media_chunks, mixing, packing, quality_ftrl, quality_rules, simhash_anchor, toxicity_zdict, url_rules


#: Rank file of the public vocabulary that texts are encoded by.
RANKS = "byte_bpe_50k.tiktoken"
#: Tokenizer file that documents are packed by.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchor.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity_zdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zdict.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumn("failed", F.array_join("failed", ",")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.main_texts(_table(spark, sf_dir, "pages"))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_columns(_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_bpe_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_bitmap.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.languages(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_anchor": op1_simhash_anchor,
    "op2_quality_ftrl": op2_quality_ftrl,
    "op3_toxicity_zdict": op3_toxicity_zdict,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_region": op5_html_region,
    "op6_media_chunks": op6_media_chunks,
    "op7_url_rules": op7_url_rules,
    "op8_mixing": op8_mixing,
    "op9_bpe_bitmap": op9_bpe_bitmap,
    "op10_lang_cnn": op10_lang_cnn,
    "op11_importance": op11_importance,
    "op12_fill_middle": op12_fill_middle,
    "op13_best_fit": op13_best_fit,
}
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.oracle_sql(),
    "op7_url_rules": url_rules.oracle_sql(),
    "op8_mixing": mixing.oracle_sql(),
    "op11_importance": importance.oracle_sql(),
    "op12_fill_middle": fill_middle.oracle_sql(),
}
