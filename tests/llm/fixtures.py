"""Small tables for the operators: invented prose, copies, junk, nulls, long and repeated rows."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "and", "tion", "ing", "er", "on", "at", "ly", "is", "of"], "fr": ["le", "la", "eau", "é", "ment", "tion", "qu", "oi", "des", "è"]}[lang]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)]
    lines = [" ".join(words[i : i + 12]) + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        text = prose(rng, rng.randint(20, 200), lang)
        if i % 10 == 7:
            text = " ".join(w + "***" for w in text.split())
        if i % 10 == 8 and i > 10:
            text = rows[i - 5][1]
        if i % 10 == 9 and i > 10:
            words = rows[i - 6][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text, lang, f"s{i % 4}" if i % 11 else None, len(text)))
    return rows


def labels(rows: list[tuple]) -> list[tuple]:
    return [(r[0], 0 if "***" in r[1] else 1, 0) for r in rows if r[0] % 2 == 1 or "***" in r[1]]


def odd(seed: int = 2) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    long = prose(rng, 60_000)
    return [(1, None, "en", "a", None), (None, "the and ing the and ing", None, None, 3), (3, "", "fr", None, 0), (4, long, "en", "a", 5), (5, "one two", "en", "a", 7), (5, "one two", "en", "a", 7), (6, "one two", "en", "b", 7), (7, "\t \n", "fr", "b", 3), (8, "é" * 5000, None, "b", 1), (9, "12 34 !!", "en", "", 8)]


#: Names that operators use inside.
EXTRA = ("_id", "_text", "_set", "cls", "size", "key", "score", "_p", "n_words", "keys", "kept", "_copies", "rep")


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])
    return df
