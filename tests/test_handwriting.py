import numpy as np

from sparkglyph.plans import handwriting as H
from sparkglyph.raster import kernels as K
from sparkglyph.sources import geometry, images

from .strokes import page

TEXT = ["ana lune dal", "nade ula en", "daun lea nad", "una alde dan"]


def test_pages_to_character_sets(spark, tmp_path):
    truth = {}
    for p in range(3):
        gray, marks = page(TEXT, seed=p)
        (tmp_path / f"p{p}.png").write_bytes(images.encode(gray))
        truth |= {(f"p{p}.png", k, i): (c, a, b) for k, i, c, a, b in marks}
    pages = images.read_pages(spark, str(tmp_path))
    name = {r.page_id: r.source.rsplit("/", 1)[1] for r in pages.select("page_id", "source").collect()}
    found = H.lines(pages)
    where = {(r.page_id, r.line_index): r for r in found.collect()}
    assert len(where) == 3 * len(TEXT)
    texts = spark.createDataFrame([(p, k, t, 0.9) for p in name for k, t in enumerate(TEXT)], "page_id long, line_index int, text string, confidence double")
    usable = H.transcribed(found, texts).where("reason is null")
    cut = H.segmented(usable)
    scores = []
    for r in cut.collect():
        c, a, b = truth[name[r.page_id], r.line_index, r.char_index]
        x = np.nonzero(K.unpack(r.mask, r.h, r.w))[1] + r.x0 + where[r.page_id, r.line_index].ox
        scores.append(((x >= a) & (x < b)).mean() if c == r.char else 0)
    assert len(scores) == len(truth) and np.median(scores) > 0.95 and np.mean(np.array(scores) < 0.4) < 0.1
    sets = {r.char: r for r in H.library(H.glyphs(H.without_misaligned(cut))).collect()}
    assert set(sets) == set("anlued") and all(r.kept + r.dropped == r.seen for r in sets.values())
    assert sets["l"].advance < sets["a"].advance


def test_unread_lines_have_reasons(spark):
    lines = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "page_id long, line_index int")
    texts = spark.createDataFrame([(1, 0, " \t", 0.9), (1, 1, "x", 0.2)], "page_id long, line_index int, text string, confidence double")
    assert [r.reason for r in H.transcribed(lines, texts).orderBy("line_index").collect()] == ["unread", "unsure", "unread"]


def test_geometry_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(13)], "n int, t string")
    bands = geometry.lay_out(lines, "n", "t").collect()
    assert {(r.page_index, r.band) for r in bands} == {(i // 10, i % 10) for i in range(13)} and max(r.marker_ids[-1] for r in bands) == 7
    (tmp_path / "s.json").write_text('{"sheets": [{"page_index": 0, "width": 1654, "height": 2339, "dpi": 200, "marker_ids": [0, 1], "marker_corners": [[[0.5, 1.0]]], "bands": [{"index": 0, "text": "ab", "baseline_y": 5}]}]}')
    sheet = geometry.read_sheets(spark, str(tmp_path / "s.json"))
    (tmp_path / "again.json").write_text(geometry.to_json(sheet).first().value)
    assert geometry.read_sheets(spark, str(tmp_path / "again.json")).collect() == sheet.collect() and sheet.first().bands[0].text == "ab"
    (tmp_path / "c.txt").write_text("one  \n\n two\n")
    assert [r.text for r in geometry.corpus(spark, str(tmp_path / "c.txt")).collect()] == ["one", " two"]
