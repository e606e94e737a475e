import json

import numpy as np
import pytest

from sparkglyph.plans import handwriting as H
from sparkglyph.plans import readers, truth
from sparkglyph.raster import kernels as K
from sparkglyph.raster import shapes
from sparkglyph.sources import dump, fonts, images

TEXT = ["ana lune dal cos", "nade ula ensi co", "daun lea nad gos", "una alde dan cis"]


def made_pages(spark, n=3, **hand):
    return truth.pages(spark.createDataFrame([(k, TEXT) for k in range(n)], "page_id long, lines array<string>"), truth.Hand(**hand)).cache()


def texts_of(spark, n=3):
    return spark.createDataFrame([(p, k, t, 0.9) for p in range(n) for k, t in enumerate(TEXT)], "page_id long, line_index int, text string, confidence double")


@pytest.mark.parametrize("slant", [0.0, 14.0])
def test_boxes_of_made_pages_are_pure(spark, slant):
    pages = made_pages(spark, slant=slant)
    found = H.whole_lines(H.lines(pages))
    if slant:
        angles = [r.angle for r in H.slants(found).collect()]
        assert abs(abs(np.median(angles)) - slant) <= 4
        assert [r.angle for r in H.slants(H.upright_lines(found)).collect()] and abs(np.median([r.angle for r in H.slants(H.upright_lines(found)).collect()])) <= 4
        return
    boxes, lines = H.boxes_of(pages, texts_of(spark))
    got = truth.summary(truth.scores(boxes, lines, pages)).first()
    assert got.characters >= 0.95 * 3 * sum(len(t.replace(" ", "")) for t in TEXT)
    assert got.median_purity > 0.85 and got.median_coverage > 0.85 and got.bad < 0.25


def test_job_from_pages_to_font(spark, tmp_path):
    pages = made_pages(spark)
    lines = H.lines(pages)
    assert lines.count() == 3 * len(TEXT)
    order = {(r.h, r.w, bytes(r.ink)): TEXT[r.line_index] for r in lines.collect()}

    def reader(strips):
        return [readers.Reading(order[(*s.shape, K.pack(s))], 0.8) for s in strips]

    asked = []

    def judge(candidates):
        asked.append(list(candidates))
        return {c: [True] * len(m) for c, m in candidates.items()}

    out = H.font(pages, "Own Hand", reader=reader, judge=judge)
    path = dump.save_font(out["font"], str(tmp_path / "deep" / "own.ttf"))
    font = fonts.parse(open(path, "rb").read())
    chars = set("".join(TEXT)) - {" "}
    assert {ord(c) for c in chars} <= set(font["codes"])
    # capitals that are their small letter enlarged
    assert {r.char for r in out["filled"].collect()} >= {"C", "O", "S", "U"}
    report = dump.summary_lines(out["sets"], out["weak"], out["filled"]).collect()
    assert report[0].line.startswith(f"{len(chars)} characters") and len(report) == 3
    said = json.loads(dump.payload(dump.summary_lines(out["sets"], out["weak"], out["filled"]), out["resolution"]).first().value)
    assert len(said["summary"]) == 3 and "warnings" in said
    assert out["report"].first().kept <= out["report"].collect()[-1].kept
    dump.write({"sets": out["sets"]}, str(tmp_path / "dump"))
    assert dump.zipped(str(tmp_path / "dump"))[:2] == b"PK"


def test_readers_that_fail(spark):
    lines = spark.createDataFrame([(1, k, 2, 2, bytearray(K.pack(np.ones((2, 2), bool)))) for k in range(7)], "page_id long, line_index int, h int, w int, ink binary").coalesce(1)

    def reader(strips):
        if len(strips) < 5:
            raise OSError("gone")
        return [readers.Reading("x", 1.0)] * len(strips)

    got = readers.transcribe(lines, reader).orderBy("line_index").collect()
    assert [r.text for r in got] == ["x"] * 5 + [None] * 2 and got[6].error == "OSError: gone"
    glyphs = spark.createDataFrame([(c, i, 2, 2, bytearray(K.pack(np.ones((2, 2), bool)))) for i, c in enumerate("aab")], "char string, glyph_id long, h int, w int, mask binary")

    def judge(candidates):
        if "b" in candidates:
            raise OSError("gone")
        return {c: [False] for c in candidates}

    verdicts = readers.verify(glyphs, judge)
    assert {r.glyph_id: r.ok for r in verdicts.collect()} == {0: False, 1: False, 2: True}
    assert readers.verified(glyphs, verdicts).count() == 3  # a character keeps its samples if all would go


def test_fragments_and_streaks(spark):
    rows = [(1, k, x) for k, x in enumerate([30.0, 31.0, 5.0, 29.0])] + [(2, 0, 3.0)]
    kept = H.whole_lines(spark.createDataFrame(rows, "page_id long, line_index int, xheight double")).orderBy("page_id", "line_index").collect()
    assert [(r.page_id, r.line_index, r.xheight) for r in kept] == [(1, 0, 30.0), (1, 1, 31.0), (1, 2, 29.0), (2, 0, 3.0)]
    edge = np.zeros((20, 300), bool)
    edge[9:12] = True
    assert H.is_streak(edge) and not H.is_streak(K.ink(truth.draw(["ana"], truth.Hand(), 1)[0]))


def test_bands_take_whole_components(spark):
    gray, labels, marks = truth.draw(["lap", "gel"], truth.Hand(), 4)
    page = spark.createDataFrame([(1, *gray.shape, bytearray(gray.tobytes()), None)], "page_id long, h int, w int, gray binary, error string")
    bands = spark.createDataFrame([(1, k, 50 + 130 * k + 20, 50 + 130 * k + 110) for k in range(2)], "page_id long, line_index int, y0 int, y1 int")
    got = {r.line_index: r for r in H.lines_from_bands(page, bands).collect()}
    for k in range(2):
        own = np.isin(labels, [n for line, _, _, n in marks if line == k])
        assert abs(int(K.unpack(got[k].ink, got[k].h, got[k].w).sum()) - int(own.sum())) < 0.05 * own.sum()


def test_shapes():
    base, donor = np.zeros((40, 30), bool), np.zeros((50, 30), bool)
    base[:, 5:25] = True
    donor[14:, 5:25] = True
    donor[2:8, 12:18] = True
    mask, rise = shapes.composed(base, donor)
    assert rise == 6 + 4 and mask.shape == (50, 30) and mask[:6].sum() == 36
    below, none = shapes.composed(base, donor[::-1])
    assert none == 0 and below[-6:].sum() == 36
    assert shapes.composed(base, base) is None
    ring = np.zeros((80, 60), bool)
    ring[10:70, 10:50] = True
    ring[25:55, 22:38] = False
    curves = shapes.traced(ring)
    assert len(curves) == 2 and K.iou(shapes.rasterized(curves, *ring.shape), ring) > 0.93
    assert shapes.traced(np.zeros((4, 4), bool)) == [] and len(shapes.points(curves[0])) == 1 + 3 * len(curves[0][1])
    assert abs(K.stroke_width(shapes.weighted(ring, 20)) - 20) < abs(K.stroke_width(ring) - 20) + 1
    assert (shapes.deformed(ring, 3) == shapes.deformed(ring, 3)).all()
    assert shapes.transferred(ring, 1.5, 12).shape[0] > 80


def test_encoded_lines_and_sheets():
    import base64

    line = np.zeros((128, 300), bool)
    line[40:90, 20:280] = True
    image = images.decode(base64.b64decode(readers.encode_line(line)))
    assert image.shape == (64, 150) and image[32, 75] == 0 and image[0, 0] == 255
    assert images.decode(base64.b64decode(readers.encode_line(line[:30]))).shape == (30, 300)
    assert readers.contact_sheet([line] * 7).shape == (128, 384)
