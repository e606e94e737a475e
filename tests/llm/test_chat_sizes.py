"""Conversations and records beyond what Spark's JSON reader takes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkglyph.llm import chat


def test_turns_of_any_length_are_formatted(spark):
    n = 21_000_000
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string")
    rows = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("x"), n)).otherwise("q"))
    got = {r.conv_id: r for r in chat.report(rows).collect()}[1]
    assert (got.n_turns, got.loss_chars) == (2, n)
    assert got.formatted_chars == 2 * 24 + len("user") + len("assistant") + 1 + n
    assert got.loss_sha256 == hashlib.sha256(b"x" * n).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(b"user\nq\nassistant\n" + b"x" * n + b"\n").hexdigest()


def test_a_record_too_large_to_read_is_an_error(spark):
    one = spark.range(1).select(F.concat(F.lit('{"prompt": "p", "response": "'), F.repeat(F.lit("x"), 21_000_000), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="cannot read a record of this many characters: 21000031"):
        chat.chat(one).select(F.size("turns")).collect()
