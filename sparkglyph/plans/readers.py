"""Reading lines and judging glyphs by outside services: batches in, as many answers out.

A service is any callable of one of the two forms below; it runs inside the tasks, so a
lost task only repeats its own batches.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..raster import kernels as K
from ..raster import shapes
from ..sources import images

#: Lines in a request, height of a line's image; characters and candidates in a request to judge.
LINES, HEIGHT, CHARACTERS, CANDIDATES = 5, 64, 6, 12


@dataclass(frozen=True)
class Reading:
    text: str
    confidence: float


Transcriber = Callable[[Sequence[np.ndarray]], Sequence[Reading]]
Verifier = Callable[[dict[str, Sequence[np.ndarray]]], dict[str, Sequence[bool]]]


def encode_line(ink: np.ndarray, height: int = HEIGHT) -> str:
    """Base64 of a PNG with dark ink; a line is made smaller to ``height`` rows, never larger."""
    small = shapes.scaled(ink, height / ink.shape[0]) if ink.shape[0] > height else ink
    return base64.b64encode(images.encode(np.where(small, 0, 255).astype(np.uint8))).decode()


def contact_sheet(masks: Sequence[np.ndarray], cell: int = 64, columns: int = 6) -> np.ndarray:
    """Candidates side by side in cells, each shrunk to fit, dark on white."""
    rows = -(-len(masks) // columns)
    out = np.full((rows * cell, columns * cell), 255, np.uint8)
    for k, mask in enumerate(masks):
        m = shapes.scaled(mask, min(1.0, (cell - 8) / max(mask.shape)))
        y, x = k // columns * cell + (cell - m.shape[0]) // 2, k % columns * cell + (cell - m.shape[1]) // 2
        out[y : y + m.shape[0], x : x + m.shape[1]][m] = 0
    return out


def transcribe(lines: DataFrame, reader: Transcriber, size: int = LINES) -> DataFrame:
    """page_id, line_index, text, confidence, error of every line; a batch that fails has an error and no text."""
    kind = "page_id long, line_index int, text string, confidence double, error string"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), size):
                part = frame.iloc[a : a + size]
                try:
                    found = list(reader([K.unpack(m, h, w) for m, h, w in zip(part["ink"], part["h"], part["w"], strict=True)]))
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} answers to {len(part)} lines")
                    rows = [(r.text, r.confidence, None) for r in found]
                except Exception as error:  # one bad batch doesn't end the job
                    rows = [(None, 0.0, f"{type(error).__name__}: {error}")] * len(part)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "line_index": part["line_index"].to_numpy(), "text": [r[0] for r in rows], "confidence": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return lines.select("page_id", "line_index", "h", "w", "ink").mapInPandas(read, kind)


def verify(glyphs: DataFrame, judge: Verifier, most: int = CANDIDATES) -> DataFrame:
    """glyph_id and verdict of the first ``most`` samples of each character; if the service fails all of them pass, a missing answer doesn't."""
    rank = F.row_number().over(Window.partitionBy("char").orderBy("glyph_id"))
    some = glyphs.withColumn("_r", rank).where(F.col("_r") <= most).select("char", "glyph_id", "h", "w", "mask")

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("glyph_id")
        char = frame["char"].iloc[0]
        try:
            answers = list(judge({char: [K.unpack(m, h, w) for m, h, w in zip(frame["mask"], frame["h"], frame["w"], strict=True)]}).get(char, []))
        except Exception:  # a judge that can't be asked rejects nothing
            answers = [True] * len(frame)
        answers = [bool(x) for x in answers][: len(frame)]
        return pd.DataFrame({"char": frame["char"], "glyph_id": frame["glyph_id"], "ok": answers + [False] * (len(frame) - len(answers))})

    return some.groupBy("char").applyInPandas(judged, "char string, glyph_id long, ok boolean")


def verified(glyphs: DataFrame, verdicts: DataFrame, least: int = 1) -> DataFrame:
    """Glyphs without those that were rejected, unless fewer than ``least`` of a character's would stay."""
    rows = glyphs.join(verdicts.select("glyph_id", "ok"), "glyph_id", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    stay = F.count_if("ok").over(Window.partitionBy("char"))
    return rows.withColumn("_stay", stay).where(F.col("ok") | (F.col("_stay") < least)).drop("_stay", "ok")
