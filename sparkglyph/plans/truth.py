"""Made-up pages whose every pixel is labelled, and how well boxes find their characters.

A character is a few strokes drawn by its code point, so any alphabet can be written; a page
is made by its number alone, so reruns and lost tasks give the same page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charset as C
from ..raster import kernels as K
from ..raster import paper as P

PAGE = "page_id long, source string, h int, w int, gray binary, error string, labels binary, truth array<struct<line:int,index:int,char:string,label:int>>"


@dataclass(frozen=True)
class Hand:
    """Measures of the writing, in pixels, and of the photo."""

    xheight: int = 36
    stroke: int = 5
    gap: int = 9
    space: int = 26
    pitch: int = 130
    margin: int = 50
    slant: float = 0.0
    noise: float = 3.0
    camera: bool = False


def extent(char: str) -> tuple[float, float]:
    """Top and foot of a character over the baseline, in x-heights."""
    if char in C.DESCENDER:
        return 1.0, -0.6
    return (1.7 if char in C.ASCENDER or char.isupper() or char.isdigit() else 1.0), 0.0


def letter(char: str, hand: Hand, seed: int) -> np.ndarray:
    """Mask of one character: a stem or bowl and strokes that its code point picks, with a little noise."""
    rng, own = np.random.default_rng(ord(char)), np.random.default_rng([seed, ord(char)])
    top, foot = extent(char)
    width = C.WIDTHS.get(char, C.UPPER_WIDTH if char.isupper() else C.OTHER_WIDTH)
    h, w = round((top - foot) * hand.xheight), max(hand.stroke + 2, round(width * hand.xheight * 0.8))
    corners = [(0, 0), (0, h - 1), (w - 1, h - 1), (w - 1, 0), (w / 2, h / 2)]
    order = [0, 1, *(2 + rng.permutation(3)[: 2 if w > 2 * hand.stroke else 0])]
    path = np.array([corners[k] for k in order], float) + own.normal(0, 0.8, (len(order), 2))
    mask = np.zeros((h, w), bool)
    for a, b in zip(path, path[1:], strict=False):
        for t in np.linspace(0, 1, 2 * max(h, w)):
            x, y = (a + (b - a) * t).round().astype(int)
            x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
            mask[y, x] = True
    return K.dilate(np.pad(mask, hand.stroke // 2), hand.stroke // 2)


def draw(lines: list[str], hand: Hand, seed: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, str, int]]]:
    """Gray page, labels (0: none) and the truth: line, index, character and label."""
    letters = [[(i, c, letter(c, hand, seed * 1000 + k)) for i, c in enumerate(t) if c != " "] for k, t in enumerate(lines)]
    across = [sum(m.shape[1] + hand.gap for _, _, m in row) + t.count(" ") * hand.space for row, t in zip(letters, lines, strict=True)]
    lean = int(np.ceil(abs(np.tan(np.radians(hand.slant))) * hand.pitch))
    h, w = 2 * hand.margin + hand.pitch * len(lines), 2 * hand.margin + max([1, *across]) + 2 * lean
    labels, truth = np.zeros((h, w), np.int32), []
    for k, (row, text) in enumerate(zip(letters, lines, strict=True)):
        x, baseline = hand.margin + lean, hand.margin + hand.pitch * k + round(hand.pitch * 0.7)
        at = dict((i, (c, m)) for i, c, m in row)
        for i in range(len(text)):
            if i not in at:
                x += hand.space
                continue
            c, m = at[i]
            top = baseline - round(extent(c)[0] * hand.xheight) - hand.stroke // 2
            truth.append((k, i, c, len(truth) + 1))
            labels[top : top + m.shape[0], x : x + m.shape[1]][m] = len(truth)
            x += m.shape[1] + hand.gap
        if hand.slant:
            band = slice(hand.margin + hand.pitch * k, hand.margin + hand.pitch * (k + 1))
            labels[band] = K.shear(labels[band], -hand.slant, baseline - band.start)
    rng = np.random.default_rng([seed, 1])
    gray = np.where(labels > 0, 45.0, 225.0)
    return np.clip(gray + rng.normal(0, hand.noise, gray.shape), 0, 255).astype(np.uint8), labels, truth


def photographed(gray: np.ndarray, seed: int) -> np.ndarray:
    """The page as a camera might see it: a little perspective and rotation, darker corners, blur and noise."""
    rng = np.random.default_rng([seed, 2])
    h, w = gray.shape
    flat = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    bent = P.warped(gray, P.homography(flat, flat + rng.uniform(-0.006, 0.006, (4, 2)) * [w, h]), h, w)
    y, x = np.mgrid[:h, :w]
    shade = 1 - 0.15 * (((x / w - 0.5) ** 2 + (y / h - 0.5) ** 2) / 0.5)
    return np.clip(K.gaussian(P.turned(bent, float(rng.uniform(-0.6, 0.6))), 0.7) * shade + rng.normal(0, 2, gray.shape), 0, 255).astype(np.uint8)


def pages(texts: DataFrame, hand: Hand = Hand()) -> DataFrame:
    """A page for each row (page_id, lines: its texts), with labels and truth."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, lines in zip(frame["page_id"], frame["lines"], strict=True):
                gray, labels, truth = draw(list(lines), hand, int(key))
                seen = photographed(gray, int(key)) if hand.camera else gray
                rows.append((key, f"made/{key}", *gray.shape, seen.tobytes(), None, labels.tobytes(), [dict(zip(("line", "index", "char", "label"), t, strict=True)) for t in truth]))
            yield pd.DataFrame(rows, columns=["page_id", "source", "h", "w", "gray", "error", "labels", "truth"])

    return texts.select("page_id", "lines").mapInPandas(made, PAGE)


SCORE = "page_id long, line_index int, char_index int, char string, purity double, coverage double"


def scores(boxes: DataFrame, lines: DataFrame, made: DataFrame) -> DataFrame:
    """Purity and coverage of every box that has a true character; boxes without pixels of any have purity 0.

    ``boxes``: the cut ones; ``lines``: where each line's image begins (ox, oy); ``made``: :func:`pages`.
    A line of whose characters fewer were drawn than read is left out, as are characters without a pixel.
    """
    drawn = made.select("page_id", F.explode("truth").alias("t")).groupBy("page_id", F.col("t.line").alias("line_index")).agg(F.count(F.lit(1)).alias("_drawn"))
    read = boxes.groupBy("page_id", "line_index").agg(F.count(F.lit(1)).alias("_read"))
    whole = read.join(drawn, ["page_id", "line_index"]).where("_read <= _drawn").select("page_id", "line_index")
    rows = boxes.join(whole, ["page_id", "line_index"]).join(lines.select("page_id", "line_index", "ox", "oy"), ["page_id", "line_index"])
    box = F.struct("line_index", "char_index", "char", "x0", "y0", "ox", "oy", F.col("h").alias("bh"), F.col("w").alias("bw"), "mask")
    packed = rows.groupBy("page_id").agg(F.collect_list(box).alias("boxes")).join(made.select("page_id", "h", "w", "labels", "truth"), "page_id")

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                labels = np.frombuffer(r.labels, np.int32).reshape(r.h, r.w)
                total = np.bincount(labels.ravel(), minlength=len(r.truth) + 1)
                of = {(t["line"], t["index"]): t["label"] for t in r.truth}
                for b in r.boxes:
                    own = of.get((b["line_index"], b["char_index"]))
                    if own is None or not total[own]:
                        continue
                    y, x = np.nonzero(K.unpack(b["mask"], b["bh"], b["bw"]))
                    y, x = y + b["y0"] + b["oy"], x + b["x0"] + b["ox"]
                    ok = (y >= 0) & (y < r.h) & (x >= 0) & (x < r.w)
                    seen = labels[y[ok], x[ok]]
                    hit, some = int((seen == own).sum()), int((seen > 0).sum())
                    out.append((r.page_id, b["line_index"], b["char_index"], b["char"], hit / some if some else 0.0, hit / total[own]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORE.split(", ")])

    return packed.mapInPandas(judged, SCORE)


def summary(scored: DataFrame) -> DataFrame:
    """Means and medians of purity and coverage, and the shares of good and bad characters."""
    both = F.least("purity", "coverage")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("characters"), *[f(c).alias(f"{name}_{c}") for c in ("purity", "coverage") for name, f in (("mean", F.avg), ("median", F.median))],
        share(both > 0.8).alias("good"), share(both > 0.6).alias("fair"), share(both < 0.4).alias("bad"),
    )


