"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chosen_path, compression, counts_sql, ctw, isolation, langid, licenses, mixing, pivots
from .text import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = compression.fit(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), compression.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= compression.CUT).cast("int"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    found = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), langid.identify(model, F.col("text")).alias("_p"))
    return found.select("doc_id", "held_out", "_p.*")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, sf_dir, "documents").select("doc_id", tokenizer.digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read(spark, sf_dir, "conversations"))


ORACLES["op9_chat_format"] = chat.ORACLE


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.duplicates(read(spark, sf_dir, "embeddings"))


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.report(read(spark, sf_dir, "documents"))


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.report(read(spark, sf_dir, "documents"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


ORACLES["op5_embedding_dedup"] = pivots.ORACLE
ORACLES["op8_ngram_join"] = chosen_path.ORACLE


# what SQL can express of the operators above that have no SQL of their own


@query
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = isolation.narrow(read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


@query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


@query
def word_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


ORACLES["rule_counts"] = counts_sql.RULE_COUNTS
ORACLES["mix_targets"] = counts_sql.MIX_TARGETS
ORACLES["word_base"] = counts_sql.WORD_BASE
