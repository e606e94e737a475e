"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from text labelled good and one from
text labelled bad.  A text is cut into windows of ``WINDOW`` bytes, all of them, and
each is compressed with either dictionary; the sum of the differences of the sizes,
divided by the text's bytes, says which kind it resembles.  A logistic curve fitted on
other labelled rows makes it a probability.  Texts that repeat themselves compress to
next to nothing with either dictionary, which leaves no difference; so the curve also
sees how far the logarithm of the size by the good dictionary over the text's bytes
falls short of its median in good rows.  Windows keep the dictionary's part the
same for long texts, which else compress well by their own repetitions.

The dictionaries and the curve are learnt from bounded samples of the labelled rows:
``DICTIONARY_ROWS`` and ``CALIBRATION_ROWS`` a class, about, picked by a hash of the id.
Dictionaries see at most ``WINDOWS_A_ROW`` windows of each sampled text, random ones of a
longer text; scores use all windows.
Only labels and texts are inputs.

Defined cases: null and empty texts have a difference of 0 and get the curve's value
there; a document with several labels counts as good if one says so; without rows of
both classes every score is the share of good labels (0.5 without labels); rows that
repeat are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytesops as B

WINDOW, LEVEL, DICTIONARY_BYTES = 2048, 3, 1 << 16
DICTIONARY_ROWS, CALIBRATION_ROWS, WINDOWS_A_ROW = 1500, 1500, 3
CUT = 0.3


def windows(data: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[k : k + WINDOW] for k in range(0, len(raw), WINDOW)]


@dataclass
class Classifier:
    """The two dictionaries and the curve; compressors are made once in each worker."""

    good: bytes
    bad: bytes
    slope: tuple[float, ...] = (0.0, 0.0)
    offset: float = 0.0
    typical: float = 0.0

    def _compressor(self, dictionary: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(dictionary)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False, write_checksum=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def difference(self, texts: pa.Array) -> np.ndarray:
        """(size by the bad dictionary - size by the good one) a byte, over all windows, and the log of the good one's size a byte."""
        out = np.zeros((len(texts), 2))
        if not self.good or not self.bad:
            return out
        if "_pair" not in self.__dict__:
            self._pair = self._compressor(self.good), self._compressor(self.bad)
        good, bad = (c.compress for c in self._pair)
        data, at = B.flat(texts)
        for i in range(len(texts)):
            small = large = 0
            for w in windows(data[at[i] : at[i + 1]]):
                small += len(good(w))
                large += len(bad(w))
            if n := at[i + 1] - at[i]:
                out[i] = (large - small) / n, np.log(small / n)
        return out

    def inputs(self, found: np.ndarray) -> np.ndarray:
        return np.column_stack([found[:, 0], np.minimum(found[:, 1] - self.typical, 0.0)])

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(self.difference(texts)) @ np.array(self.slope) + self.offset, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of a logistic regression, by Newton's steps."""
    scale = np.abs(x).mean(axis=0)
    scale[scale == 0] = 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def train(samples: list[bytes]) -> bytes:
    """A dictionary from windows; the windows themselves where they are too few to train on."""
    samples = sorted(s for s in samples if s)
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> Classifier:
    """``labels``: doc_id and quality (1 good, 0 bad) of the rows to learn from."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_lid")).agg((F.max("quality") >= 1).cast("int").alias("_good"))
    sizes = {r["_good"]: r["n"] for r in marks.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = 1.0 if sizes.get(1) else 0.0 if sizes.get(0) else 0.5
        return Classifier(b"", b"", offset=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    part = lambda n: F.when(F.col("_good") == 1, min(1.0, n / sizes[1])).otherwise(min(1.0, n / sizes[0]))
    draw = F.pmod(F.xxhash64("_lid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # half of the draws at most make dictionaries, so that some rows are always left to calibrate on
    picked = marks.withColumns({"_draw": draw, "_d": F.least(part(DICTIONARY_ROWS), F.lit(0.5)), "_c": part(CALIBRATION_ROWS)}).where("_draw < _d + _c")
    picked = picked.select("_lid", "_good", (F.col("_draw") < F.col("_d")).alias("_dict"))
    # of a size bounded by the two parameters
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_lid"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.flat(batch.column("_text"))
            rows = []
            for i, (key, good) in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_good").to_pylist(), strict=True)):
                found = windows(data[at[i] : at[i + 1]])
                pick = np.random.default_rng([seed, abs(hash(key))]).permutation(len(found))[:WINDOWS_A_ROW]
                rows += [(good, found[k]) for k in sorted(pick)]
            if rows:
                yield pa.record_batch([pa.array([g for g, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], names=["good", "window"])

    taken = chosen.where("_dict").mapInArrow(sampled, "good int, window binary").collect()
    made = Classifier(*(train([bytes(r["window"]) for r in taken if r["good"] == g]) for g in (1, 0)))
    held = docs.sparkSession.sparkContext.broadcast(made)

    @arrow_udf("struct<x:double,r:double>")
    def difference(texts: pa.Array) -> pa.Array:
        found = held.value.difference(texts)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "r"])

    rest = chosen.where("not _dict").select("_good", difference("_text").alias("_x")).select("_good", "_x.*").toPandas().sort_values(["x", "r", "_good"])
    # classes were sampled at different rates; weigh them back by repeating the prior in the offset
    made.typical = float(rest.loc[rest["_good"] == 1, "r"].median()) if (rest["_good"] == 1).any() else 0.0
    if not len(rest):
        return made
    made.slope, made.offset = curve(made.inputs(rest[["x", "r"]].to_numpy()), rest["_good"].to_numpy(float))
    n1, n0 = max(1, int(rest["_good"].sum())), max(1, int((rest["_good"] == 0).sum()))
    made.offset += float(np.log(sizes[1] / sizes[0]) - np.log(n1 / n0))
    return made


def score(model: Classifier, text: Column) -> Column:
    held = SparkSession.active().sparkContext.broadcast(model)

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts))

    return of(text)
