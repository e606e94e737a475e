"""Pages to character sets: ink, lines, boxes, glyphs, as a chain of tables.

Rows of pages and lines go through Arrow batches; everything that relates rows to each
other (priors, outliers, sets) is DataFrame work.  The only table that is read on the
driver is the one of character widths, which the alphabet bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import staging
from ..functions import charset as C
from ..functions import recipes
from ..operators import robust, stats
from ..raster import kernels as K
from ..raster import paper as P
from ..raster import shapes
from ..sources import fonts
from . import readers

LINE = "page_id long, line_index int, h int, w int, ink binary, ox int, oy int, stroke double, baseline double, xheight double"
BOX = "page_id long, line_index int, char_index int, char string, h int, w int, mask binary, x0 int, y0 int, cut_left int, cut_right int, baseline double, xheight double, word int, word_cost double, word_scale double, word_length int"
SPACE, PASSES, LEAST_CONFIDENCE, SUSPICIOUS_SCALE = 0.75, 2, 0.35, 0.20


#: A streak is a line whose widest part is so much wider than high, of at most so many parts;
#: a fragment has less than this share of its page's usual x-height.
STREAK_ASPECT, STREAK_PARTS, FRAGMENT = 10, 12, 0.45
#: Letters whose height is the x-height, and samples that make a line's own one.
REFERENCE, LEAST_SAMPLES = "acemnorsuvwxz", 4
#: Fixed value: a median x-height under this, in pixels, is worth a warning.
LOW_RESOLUTION = 26.0


def prepared(pages: DataFrame, paper: bool = True, rules: bool = False) -> DataFrame:
    """Pages cut out of their photos, resized and upright; what can't be prepared has an error."""

    def upright(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    gray, _ = P.prepared(np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w), paper, rules)
                    rows.append((r.page_id, r.source, *gray.shape, gray.tobytes(), None))
                except Exception as error:
                    rows.append((r.page_id, r.source, 0, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["page_id", "source", "h", "w", "gray", "error"])

    kind = "page_id long, source string, h int, w int, gray binary, error string"
    fine = pages.where("error is null").select("page_id", "source", "h", "w", "gray")
    return fine.mapInPandas(upright, kind).unionByName(pages.where("error is not null").select("page_id", "source", "h", "w", "gray", "error"))


def unreadable(pages: DataFrame) -> DataFrame:
    """Source and error of every page that couldn't be used, by source."""
    return pages.where("error is not null").select("source", "error").orderBy("source")


def is_streak(part: np.ndarray) -> bool:
    """A line that is the shadow of the page's edge: one long thin part and few others."""
    labels, n = K.components(part)
    spans = [np.ptp(np.nonzero(labels == k)[::-1], axis=1) + 1 for k in range(1, n + 1)] if n <= STREAK_PARTS else []
    widest = max(spans, key=lambda s: s[0], default=None)
    return widest is not None and widest[0] >= STREAK_ASPECT * widest[1]


def lines(pages: DataFrame) -> DataFrame:
    """Text lines of every readable page (page_id, h, w, gray), top to bottom, with baseline and x-height."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                gray = np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w)
                ink = K.ink(K.even_light(gray))
                stroke, k = K.stroke_width(ink), 0
                for a, b in K.line_bands(ink):
                    x = np.flatnonzero(ink[a:b].any(axis=0))
                    part = ink[a:b, x[0] : x[-1] + 1] if len(x) else ink[:0, :0]
                    if len(x) and not is_streak(part):
                        rows.append((r.page_id, k, *part.shape, K.pack(part), int(x[0]), a, stroke, *K.line_metrics(part)))
                        k += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    return pages.where("error is null").select("page_id", "h", "w", "gray").mapInPandas(found, LINE)


def whole_lines(lines_: DataFrame, share: float = FRAGMENT, least: int = 3) -> DataFrame:
    """Lines of at least ``share`` of their page's median x-height, numbered anew; a page of fewer than ``least`` keeps all."""
    page = Window.partitionBy("page_id")
    rows = lines_.withColumns({"_m": F.median("xheight").over(page), "_n": F.count(F.lit(1)).over(page)})
    kept = rows.where((F.col("_n") < least) | (F.col("_m") <= 0) | (F.col("xheight") >= share * F.col("_m")))
    return kept.withColumn("line_index", (F.row_number().over(page.orderBy("line_index")) - 1).cast("int")).drop("_m", "_n")


def lines_from_bands(pages: DataFrame, bands: DataFrame, pad: float = 0.3) -> DataFrame:
    """Lines of worksheets: whole components go to the band (page_id, line_index, y0, y1) that their middle lies in.

    A band reaches over its edges by ``pad`` of its height, and no stroke is cut at them.
    """
    packed = bands.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_index", "y0", "y1"))).alias("bands"))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ink = K.ink(K.even_light(np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w)))
                labels, n = K.components(ink)
                ys = np.nonzero(labels)[0]
                middle = np.bincount(labels[labels > 0], ys, n + 1)[1:] / np.maximum(K.areas(labels, n), 1)
                stroke = K.stroke_width(ink)
                for band in r.bands:
                    room = pad * (band["y1"] - band["y0"])
                    own = np.concatenate([[False], (middle >= band["y0"] - room) & (middle < band["y1"] + room)])[labels]
                    if own.any():
                        y, x = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
                        part = own[y[0] : y[-1] + 1, x[0] : x[-1] + 1]
                        rows.append((r.page_id, band["line_index"], *part.shape, K.pack(part), int(x[0]), int(y[0]), stroke, *K.line_metrics(part)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    return pages.where("error is null").select("page_id", "h", "w", "gray").join(packed, "page_id").mapInPandas(found, LINE)


def slants(lines_: DataFrame) -> DataFrame:
    """The correcting angle of every line."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "line_index": frame["line_index"], "angle": [K.slant(K.unpack(m, h, w)) for m, h, w in zip(frame["ink"], frame["h"], frame["w"], strict=True)]})

    return lines_.select("page_id", "line_index", "h", "w", "ink").mapInPandas(of, "page_id long, line_index int, angle double")


def upright_lines(lines_: DataFrame) -> DataFrame:
    """Lines sheared by the median angle of all of them, with room on both sides for what moves out."""
    angle = slants(lines_).agg(F.coalesce(F.median("angle"), F.lit(0.0))).scalar()

    def sheared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ink = K.unpack(r.ink, r.h, r.w)
                pad = int(np.ceil(abs(np.tan(np.radians(r.angle_)) * r.h))) + 2
                moved = K.shear(np.pad(ink, ((0, 0), (pad, pad))), r.angle_, r.baseline) if abs(r.angle_) >= P.LEAST_SKEW else ink
                rows.append((r.page_id, r.line_index, *moved.shape, K.pack(moved), r.ox - (moved.shape[1] - r.w) // 2, r.oy, r.stroke, r.baseline, r.xheight))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    names = [c.split()[0] for c in LINE.split(", ")]
    return lines_.select(*names).withColumn("angle_", angle).mapInPandas(sheared, LINE)


def transcribed(lines_: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines with text and confidence (a line without one: empty, 0) and the reason if it can't be used."""
    rows = lines_.join(texts.select("page_id", "line_index", "text", "confidence"), ["page_id", "line_index"], "left")
    rows = rows.withColumns({"text": F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), "confidence": F.coalesce("confidence", F.lit(0.0))})
    return rows.withColumn("reason", F.when(F.col("text") == "", "unread").when(F.col("confidence") < LEAST_CONFIDENCE, "unsure"))


def _tokens(text: str) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    for c in text:
        if out and out[-1][1] == (c == " "):
            out[-1] = (out[-1][0] + c, c == " ")
        else:
            out.append((c, c == " "))
    return out


def cut_line(ink: np.ndarray, text: str, baseline: float, xheight: float, stroke: float, width: Callable[[str], float], space: float) -> list[tuple]:
    """Boxes of a line's characters: words first, then the characters of each, between cheapest seams."""
    h, w = ink.shape
    cost, steps = K.seam_costs(ink, baseline, xheight, stroke)
    full = np.append(cost, 0.0)
    tokens = _tokens(text)
    widths = np.array([space * len(t) if blank else sum(map(width, t)) for t, blank in tokens])
    bounds, _ = K.split_anyway(0, w, widths, full)

    def seam(x: int) -> np.ndarray:
        if x >= w:
            return np.full(h, w)
        path = np.zeros(h, int)
        at = x
        for y in range(h - 1, -1, -1):
            path[y] = at
            at = min(max(at + int(steps[y - 1, at]) if y else at, 0), w - 1)
        return path

    out, index, word = [], 0, 0
    columns = np.arange(w)
    for (token, blank), lo, hi in zip(tokens, bounds, bounds[1:], strict=False):
        if blank:
            index += len(token)
            continue
        own = np.array([width(c) for c in token])
        cuts, price = K.split_anyway(lo, hi, own, full)
        scale = (hi - lo) / own.sum() if own.sum() > 0 else 0.0
        for c, a, b in zip(token, cuts, cuts[1:], strict=False):
            left, right = seam(a), seam(b)
            part = ink & (columns >= left[:, None]) & (columns < right[:, None])
            y, x = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
            if len(y) and b > a:
                mask = part[y[0] : y[-1] + 1, x[0] : x[-1] + 1]
                out.append((index, c, *mask.shape, K.pack(mask), int(x[0]), int(y[0]), a, b, baseline, xheight, word, price, scale, len(token)))
            index += 1
        word += 1
    return out


def boxes(usable: DataFrame, widths: dict[str, float], space: float, shares: dict[str, float]) -> DataFrame:
    """Character boxes of every usable line; ``widths`` are measured ones, ``shares`` the priors."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda c: widths.get(c, shares.get(c, C.UPPER_WIDTH if c.isupper() else C.OTHER_WIDTH))
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ink = K.unpack(r.ink, r.h, r.w)
                rows += [(r.page_id, r.line_index, *b) for b in cut_line(ink, r.text, r.baseline, r.xheight, r.stroke, of, space)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOX.split(", ")])

    return usable.select("page_id", "line_index", "h", "w", "ink", "stroke", "baseline", "xheight", "text").mapInPandas(cut, BOX)


def measured(boxes_: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Median width of each character with ``least`` boxes, in units of its line's scale; and that of spaces."""
    advance = F.col("cut_right") - F.col("cut_left")
    sized = boxes_.withColumns({"advance": advance, "prior": C.width_prior(F.col("char"))})
    line = Window.partitionBy("page_id", "line_index")
    sums = sized.withColumns({"_a": F.sum("advance").over(line), "_p": F.sum("prior").over(line)})
    scaled = sums.withColumn("scale", F.when(F.col("_p") > 0, F.col("_a") / F.col("_p")).otherwise(0.0)).where("scale > 0")
    widths = scaled.groupBy("char").agg(F.greatest(F.median(F.col("advance") / F.col("scale")), F.lit(0.1)).alias("width"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = line.orderBy("char_index")
    gaps = scaled.withColumns({"_step": F.lead("char_index").over(order) - F.col("char_index"), "_gap": (F.lead("cut_left").over(order) - F.col("cut_right")) / F.col("scale")})
    space = gaps.where("_step = 2 and _gap > 0").agg(F.greatest(F.median("_gap"), F.lit(0.1)).alias("space"))
    return widths, space


def segmented(usable: DataFrame, passes: int = PASSES) -> DataFrame:
    """Boxes after the first cut and ``passes`` more, each with the widths that the one before measured.

    Boxes are written between passes, so a lost executor repeats one pass at most.
    """
    usable = staging.stage(usable, "usable-lines")
    widths: dict[str, float] = {}
    space = SPACE
    current = staging.stage(boxes(usable, widths, space, C.WIDTHS), "boxes")
    for _ in range(passes):
        found, gap = measured(current)
        widths |= {r["char"]: float(r["width"]) for r in found.collect()}
        space = next((float(r["space"]) for r in gap.collect() if r["space"] is not None), space)
        after = staging.stage(boxes(usable, widths, space, C.WIDTHS), "boxes")
        staging.drop(current)
        current = after
    return current


def without_misaligned(boxes_: DataFrame, least: int = 10) -> DataFrame:
    """Without boxes of words that cost too much or are scaled unlike the rest, unless most words would go."""
    rows = robust.with_scalars(boxes_, med=F.median("word_cost"), n=F.count(F.lit(1)), ref=F.median(F.when((F.col("word_length") >= 3) & (F.col("word_scale") > 0), F.col("word_scale"))), refs=F.count_if((F.col("word_length") >= 3) & (F.col("word_scale") > 0)))
    rows = robust.with_scalars(rows, mad=F.median(F.abs(F.col("word_cost") - F.col("med"))))
    limit = F.col("med") + 6 * F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad"))
    off = (F.col("word_length") >= 3) & (F.col("word_scale") > 0) & (F.col("refs") >= 8) & (F.abs(F.col("word_scale") / F.col("ref") - 1) > SUSPICIOUS_SCALE)
    suspicious = (F.col("n") >= least) & ((F.col("word_cost") > limit) | off)
    return robust.with_breaker(rows, suspicious).select(*boxes_.columns)


def without_outlier_lines(boxes_: DataFrame) -> DataFrame:
    """Without the boxes of lines that are written much tighter or wider than the others."""
    line = boxes_.groupBy("page_id", "line_index").agg((F.sum(F.col("cut_right") - F.col("cut_left")) / F.sum(C.width_prior(F.col("char")) * F.col("xheight"))).alias("_scale"))
    off = robust.asymmetric(line, "_scale").select("page_id", "line_index")
    return boxes_.join(off, ["page_id", "line_index"], "left_anti")


def with_xheights(boxes_: DataFrame, reference: str = REFERENCE, least: int = LEAST_SAMPLES) -> DataFrame:
    """Boxes with the x-height that letters of that height show: their line's median, else the document's, else as it was."""
    tall = F.when(F.col("char").isin(*reference), F.col("h").cast("double"))
    document = boxes_.agg(F.median(tall)).scalar()
    own = boxes_.groupBy("page_id", "line_index").agg(F.when(F.count(tall) >= least, F.median(tall)).alias("_own"))
    return boxes_.join(own, ["page_id", "line_index"]).withColumn("xheight", F.coalesce("_own", document, "xheight")).select(*boxes_.columns)


def resolution_warning(lines_: DataFrame, least: float = LOW_RESOLUTION) -> DataFrame:
    """The median x-height of the lines and a warning if it is low; never an error."""
    found = lines_.agg(F.median(F.when(F.col("xheight") > 0, F.col("xheight"))).alias("median_xheight"))
    return found.withColumn("warning", F.when(F.col("median_xheight") < least, F.format_string("letters are only %.0f pixels high", "median_xheight")))


def glyphs(boxes_: DataFrame, x_height: float = 500.0) -> DataFrame:
    """Boxes in font units, of plausible shape for their class, with a signature."""
    rows = boxes_.where("xheight > 0").withColumn("scale", x_height / F.col("xheight"))
    rows = rows.withColumns({"advance": (F.col("cut_right") - F.col("cut_left")) * F.col("scale"), "bearing": (F.col("x0") - F.col("cut_left")) * F.col("scale"), "right_bearing": (F.col("cut_right") - F.col("x0") - F.col("w")) * F.col("scale"), "ascent": (F.col("baseline") - F.col("y0")) * F.col("scale"), "descent": (F.col("y0") + F.col("h") - F.col("baseline")) * F.col("scale")})
    rule = rows.withColumn("class", C.vertical_class(F.col("char")))
    low, high, down = (F.coalesce(*[F.when(F.col("class") == k, F.lit(v[i])) for k, v in C.PLAUSIBLE.items()]) for i in range(3))
    height = F.col("h") * F.col("scale") / x_height
    fits = (height >= low) & (height <= high) & (F.col("descent") / x_height <= down)

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["signature"] = [K.signature(K.unpack(m, h, w), a / 1000, b / 1000, s / 1000).astype(np.float32).ravel() for m, h, w, a, b, s in zip(frame["mask"], frame["h"], frame["w"], frame["ascent"], frame["bearing"], frame["scale"], strict=True)]
            yield frame

    marked = rule.withColumn("plausible", fits)
    # a character that the rule would leave without a sample keeps all of them
    some = F.max(F.col("plausible").cast("int")).over(Window.partitionBy("char"))
    kept = marked.withColumn("_some", some).where("plausible or _some = 0").drop("_some", "plausible", "class")
    kept = kept.withColumn("glyph_id", F.xxhash64("page_id", "line_index", "char_index"))
    schema = kept._jdf.schema().toDDL() + ", signature array<float>"
    return kept.mapInPandas(signed, schema)


def library(glyphs_: DataFrame) -> DataFrame:
    """Seen, kept and dropped samples of each character, its medoid and its median measures."""
    sets = robust.character_sets(glyphs_.select("char", "glyph_id", "signature"), "char", "glyph_id", "signature")
    measures = glyphs_.groupBy("char").agg(*[F.median(c).alias(c) for c in ("advance", "bearing", "descent")])
    return sets.join(measures, "char")


def weak(sets: DataFrame, least: int = 3) -> DataFrame:
    """Characters with fewer than ``least`` samples, by character."""
    return sets.where(F.col("kept") < least).select("char", "kept").orderBy("char")


def coverage_report(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Seen, dropped and chosen samples of each character, the scarcest first."""
    n = chosen.groupBy("char").agg(F.count(F.lit(1)).alias("variants"))
    return sets.join(n, "char", "left").select("char", "seen", "dropped", "kept", F.coalesce("variants", F.lit(0)).alias("variants")).orderBy("kept", "seen", "char")


SHAPE = "char string, glyph_id long, h int, w int, mask binary, scale double, ascent double, bearing double, advance double"


def chosen_glyphs(glyphs_: DataFrame, count: int = fonts.VARIANTS) -> DataFrame:
    """The samples that a font shows of each character, with their place among them."""
    picked = robust.variants(glyphs_, "char", "glyph_id", "signature", count)
    return glyphs_.join(picked, ["char", "glyph_id"]).select("rank", *[c.split()[0] for c in SHAPE.split(", ")])


def filled(chosen: DataFrame) -> DataFrame:
    """Glyphs for missing characters that can be made of the chosen ones: composed of two, or a small letter enlarged.

    Both tables have a few rows for each character of the alphabet, so they meet in one task a character.
    """
    spark = chosen.sparkSession
    first = chosen.where("rank = 0").drop("rank")
    plan = recipes.fill_plan(spark, first).where("tier <> 'referenced'")
    # a donor may itself be composed, so its recipe's donor stands in where it isn't there
    base = first.select(*[F.col(c).alias(f"b_{c}") for c in first.columns])
    donor = first.select(F.col("char").alias("d_char"), *[F.col(c).alias(f"d_{c}") for c in ("h", "w", "mask")])
    parts = plan.join(base, F.col("base") == F.col("b_char")).join(donor, F.col("donor") == F.col("d_char"), "left")
    measures = first.agg(F.median(F.when(F.col("char").rlike("^[A-Z]$"), F.col("ascent"))).alias("cap"), F.median(F.when(F.col("char").isin(*REFERENCE), F.col("ascent"))).alias("low")).withColumn("ratio", F.coalesce(F.greatest(F.col("cap") / F.col("low"), F.lit(1.05)), F.lit(1.4)))
    rows = parts.join(F.broadcast(measures.select("ratio")))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                mask, rise, grow = K.unpack(r.b_mask, r.b_h, r.b_w), 0, 1.0
                if r.tier == "composed":
                    found = shapes.composed(mask, K.unpack(r.d_mask, int(r.d_h), int(r.d_w))) if r.d_mask is not None else None
                    if found is None:
                        continue
                    mask, rise = found
                else:
                    grow = r.ratio
                    mask = shapes.deformed(shapes.transferred(mask, grow, K.stroke_width(mask)), r.ord)
                out.append((r.char, int(r.ord), *mask.shape, K.pack(mask), r.b_scale, (r.b_ascent + rise * r.b_scale) * grow, r.b_bearing * grow, r.b_advance * grow))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHAPE.split(", ")])

    return rows.mapInPandas(made, SHAPE)


def boxes_of(pages: DataFrame, texts: DataFrame | None = None, reader: readers.Transcriber | None = None, lines_: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Boxes and lines of prepared pages, read from a table or by a service; ``lines_`` are those of worksheets."""
    found = staging.stage(whole_lines(lines(pages)) if lines_ is None else lines_, "lines")
    if texts is None:
        if reader is None:
            raise ValueError("either texts or a reader")
        texts = staging.stage(readers.transcribe(found, reader), "texts")
    usable = staging.stage(upright_lines(transcribed(found, texts).where("reason is null").drop("reason", "confidence")).join(texts.select("page_id", "line_index", F.trim("text").alias("text")), ["page_id", "line_index"]), "upright")
    return segmented(usable), usable


def font(pages: DataFrame, family: str, texts: DataFrame | None = None, reader: readers.Transcriber | None = None, judge: readers.Verifier | None = None, lines_: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole job: from pages to a font file, with the tables that tell how it went."""
    boxes_, usable = boxes_of(pages, texts, reader, lines_)
    kept = with_xheights(without_misaligned(without_outlier_lines(boxes_)))
    samples = staging.stage(glyphs(kept), "glyphs")
    if judge is not None:
        samples = staging.stage(readers.verified(samples, readers.verify(samples, judge)), "verified")
    sets = staging.stage(library(samples), "sets")
    chosen = staging.stage(chosen_glyphs(samples), "chosen")
    made = staging.stage(filled(chosen), "filled")
    every = chosen.drop("rank").unionByName(made)
    return {"font": fonts.font_files(every, family), "sets": sets, "chosen": chosen, "filled": made, "weak": weak(sets), "report": coverage_report(sets, chosen), "resolution": resolution_warning(usable), "unreadable": unreadable(pages)}
