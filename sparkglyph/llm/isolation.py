"""Quality rules: counts of a text, and isolation forests over them.

``rule_counts`` takes the counts from the bytes of each whole text.  A few
statistics made of them fall into families (symbols, case, layout, repetition,
shape).  For each family an isolation forest is grown from a bounded sample of
labelled rows; its score tells how soon random splits set a document apart.  The
threshold of each family is calibrated on all labelled rows: of the thresholds
that lose at most ``LOSS`` of the good ones, the one that takes the most bad ones;
a family that doesn't tell them apart rejects nothing.

Defined cases: a null or empty text has no words and fails the base rule; rows
that repeat are judged each on its own; without labels no family rejects
anything; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import staging
from . import bytesops as B
from .text import fresh

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_upper", "n_lower", "n_digits", "n_points", "n_bars", "n_twin_words")
#: What counts as a symbol, a point and a bar.
SYMBOLS, POINTS, BARS = b"#*$%&|<>", b"!?", b"|"
FAMILIES = {
    "symbols": ("symbols_a_word",),
    "points": ("points_a_word",),
    "case": ("upper_share",),
    "layout": ("bars_a_word", "words_a_line"),
    "repetition": ("dup_line_share", "repeat_share"),
    "twins": ("twin_share",),
    "shape": ("chars_a_word", "digit_share"),
}
TREES, SAMPLE, LOSS, BINS = 60, 256, 0.0002, 1000
#: Labelled rows, about, of which the forests are grown.
MOST_LABELLED = 10_000
#: Pairs of hashes that are sent to every executor (12 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_LUTS = {"n_symbols": _lut(SYMBOLS), "n_upper": _lut(bytes(range(65, 91))), "n_lower": _lut(bytes(range(97, 123))), "n_digits": _lut(b"0123456789"), "n_points": _lut(POINTS), "n_bars": _lut(BARS)}


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a slice of texts, an array each."""
    data, offsets = B.closed(texts)
    n = len(offsets) - 1
    out = {"n_bytes": np.diff(offsets) - 1}
    for name, lut in _LUTS.items():
        out[name] = B.per_document(lut[data], offsets)
    separates = B.SEPARATOR[data]
    out["word_chars"] = B.per_document(~separates & ((data & 0xC0) != 0x80), offsets)
    starts, ends = B.runs(~separates)
    bounds = np.searchsorted(starts, offsets)
    out["n_words"] = np.diff(bounds)
    doc = np.repeat(np.arange(n), out["n_words"])
    prefix = B.prefix_hash(data)
    # lines: each text was closed with a line feed
    stops = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], stops[:-1] + 1])
    holds = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[holds], stops[holds]
    at = np.searchsorted(offsets, begins, "right") - 1
    again = B.later(B.span_hash(prefix, begins, stops) ^ B.mixed(at.astype(np.uint64) + B.MIX1))
    out["n_lines"] = np.bincount(at, minlength=n)
    out["n_dup_lines"] = np.bincount(at[again], minlength=n)
    # words in windows of five that stand twice or more in their text
    words = B.span_hash(prefix, starts, ends)
    twin = np.zeros(len(words), bool)
    twin[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_twin_words"] = np.bincount(doc[twin], minlength=n)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= 5:
        hashes = B.window_hash(words, 5)
        first = np.flatnonzero(doc[: len(hashes)] == doc[4:])
        hit = first[B.repeated(hashes[first] ^ B.mixed(doc[first].astype(np.uint64) + B.MIX2))]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + 5, 1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def _counts(texts: pa.Array) -> pa.StructArray:
    parts = [counts_of(texts.slice(a, b - a)) for a, b in B.slices(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS], names=list(COUNTS))


COUNTS_DDL = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def rule_counts(text: Column | str) -> Column:
    """All counts of the whole text as a struct."""

    @arrow_udf(COUNTS_DDL)
    def counts(texts: pa.Array) -> pa.Array:
        return _counts(texts)

    return counts(text)


def statistics(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The statistics that the forests see."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return {
        "symbols_a_word": c["n_symbols"] / words,
        "points_a_word": c["n_points"] / words,
        "upper_share": c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1),
        "bars_a_word": c["n_bars"] / words,
        "words_a_line": np.log1p(c["n_words"] / lines),
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
        "twin_share": c["n_twin_words"] / words,
        "chars_a_word": np.log1p(c["word_chars"] / words),
        "digit_share": c["n_digits"] / chars,
    }


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees side by side; a leaf points to itself and holds its path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    sample: int

    @classmethod
    def grow(cls, x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2))))) + 2
        grown = []
        for _ in range(trees):
            nodes: list[list] = []

            def split(rows: np.ndarray, at: int, nodes: list[list] = nodes) -> int:
                me = len(nodes)
                nodes.append([0, 0.0, me, me, at + float(mean_path(len(rows)))])
                lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
                open_ = np.flatnonzero(hi > lo)
                if at < depth and len(rows) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    v = float(rng.uniform(lo[f], hi[f]))
                    under = x[rows, f] <= v
                    nodes[me][:2] = [f, v]
                    nodes[me][2] = split(rows[under], at + 1)
                    nodes[me][3] = split(rows[~under], at + 1)
                return me

            split(rng.choice(len(x), sample, replace=False), 0)
            grown.append(nodes)
        most = max(map(len, grown))
        full = np.array([t + [[0, 0.0, k, k, 0.0] for k in range(len(t), most)] for t in grown])
        return cls(full[:, :, 0].astype(int), full[:, :, 1], full[:, :, 2].astype(int), full[:, :, 3].astype(int), full[:, :, 4], depth, sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / expected path): near 1 for rows that splits set apart at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[t, at]] <= self.value[t, at], self.left[t, at], self.right[t, at])
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / max(float(mean_path(self.sample)), 1e-9))


@dataclass
class Rules:
    """A forest and a threshold for each family."""

    forests: dict[str, Forest]
    thresholds: dict[str, float]

    def scores(self, counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s = statistics(counts)
        n = len(next(iter(s.values())))
        return {name: self.forests[name].score(np.column_stack([s[c] for c in cols])) if name in self.forests else np.zeros(n) for name, cols in FAMILIES.items()}

    def verdict(self, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base rule failed; kept; the largest excess over a threshold."""
        failed = base_failed(counts["n_words"], counts["n_repeat_words"])
        excess = np.full(len(failed), -1.0)
        for name, s in self.scores(counts).items():
            excess = np.maximum(excess, s - self.thresholds.get(name, 2.0))
        return failed, ~failed & (excess <= 0), excess


def threshold(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """From counts by score bin: keep all but ``loss`` of the good rows and take what bad ones that leaves."""
    over_good, over_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    total, caught = max(good.sum(), 1), max(bad.sum(), 1)
    fit = np.flatnonzero((over_good <= loss * total) & (over_bad / caught > 5 * over_good / total) & (over_bad > 0))
    if not len(fit):
        return 2.0
    low = int(fit[0])
    high = low + int(np.argmax(over_bad[low:] < over_bad[low]) or 1)  # the border may rise until it loses a bad row
    return (low + high - 1) / 2 / len(good) if high - 1 > low else low / len(good)


def fit(counts: DataFrame, labels: DataFrame, seed: int = 11, most: int = MOST_LABELLED) -> Rules:
    """``counts``: ``_id`` and the counts; ``labels``: doc_id and quality, where 1 is good.

    The forests grow on about ``most`` labelled rows, picked by hash; the thresholds see all.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_lid")).agg(F.max("quality").alias("_quality"))
    marked = staging.stage(counts.join(marks, F.col("_id") == F.col("_lid")).drop("_lid"), "rules-labelled")
    share = min(1.0, most / max(1, marked.count()))
    some = marked.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(share * float(1 << 30))).toPandas().sort_values(["_id", *COUNTS])
    if not len(some):
        return Rules({}, {})
    s = statistics({c: some[c].to_numpy() for c in COUNTS})
    rules = Rules({name: Forest.grow(np.column_stack([s[c] for c in cols]), TREES, SAMPLE, seed) for name, cols in FAMILIES.items()}, {})

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, v in rules.scores({c: frame[c].to_numpy() for c in COUNTS}).items():
                yield pd.DataFrame({"family": name, "bin": np.minimum((v * BINS).astype(int), BINS - 1), "quality": frame["_quality"].to_numpy()})

    table = marked.mapInPandas(scored, "family string, bin int, quality int").groupBy("family", "bin", "quality").count().toPandas()
    for name in FAMILIES:
        of = table[table["family"] == name]
        good, bad = (np.bincount(x["bin"], x["count"], BINS) for x in (of[of["quality"] == 1], of[of["quality"] != 1]))
        rules.thresholds[name] = threshold(good, bad)
    staging.drop(marked)
    return rules


def narrow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """``_id``, the counts of every row and the columns of ``more``."""
    own = more or {}
    return docs.select(F.col(doc_id).alias("_id"), *[c.alias(k) for k, c in own.items()], rule_counts(F.col(text)).alias("_c")).select("_id", *own, "_c.*")


VERDICT = "base_failed boolean, kept boolean, excess double"


def judge(counts: DataFrame, rules: Rules) -> DataFrame:
    """The counts with base_failed, kept and the excess over the nearest threshold."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            failed, kept, excess = rules.verdict({c: frame[c].to_numpy() for c in COUNTS})
            yield frame.assign(base_failed=failed, kept=kept, excess=excess)

    return counts.mapInPandas(of, counts._jdf.schema().toDDL() + ", " + VERDICT)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Texts are counted once; the hashes of those that are not kept are taken out of ``docs``.
    """
    names = fresh(docs, "_one", "_two")
    hashes = [F.xxhash64(text), F.hash(text)]
    counts = staging.stage(narrow(docs, doc_id, text, {n: h for n, h in zip(names, hashes, strict=True)}), "rules-counts")
    gone = staging.stage(judge(counts, fit(counts.drop(*names), labels)).where("not kept").select(*names).distinct(), "rules-gone")
    same = (hashes[0] == F.col(names[0])) & (hashes[1] == F.col(names[1]))
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, same, "left_anti")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    counts = staging.stage(narrow(docs), "rules-counts")
    return judge(counts, fit(counts, labels)).select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "excess")
