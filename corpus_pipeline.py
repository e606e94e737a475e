"""Documents to token ids: identify, filter, deduplicate, mix, encode.

Each stage works on all rows that the one before it kept and returns the columns of
``documents``; the last returns the digests of each document's ids.  Stages are written
as Parquet in the shared folder and read again, so a lost executor repeats one stage at
most.  Nulls in any column, empty texts and repeated rows have the results that the
operators' docstrings state; an empty table runs through to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkglyph import staging
from sparkglyph.llm import bpe, chosen_path, isolation, langid, mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of one of the learnt languages."""
    model = langid.fit(docs)
    return docs.where(~langid.identify(model, F.col("text"))["rejected"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the isolation forests."""
    return isolation.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return chosen_path.dedupe(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", tokenizer.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("mix_sources", mix),
    ("bpe", encode),
]
#: Kneser-Ney models, forests and token ids have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
