import numpy as np

from sparkglyph.functions import recipes
from sparkglyph.raster import kernels as K
from sparkglyph.sources import fonts
from sparkglyph.streaming import profiles


def ring():
    mask = np.zeros((60, 40), bool)
    mask[5:55, 5:35] = True
    mask[20:40, 15:25] = False
    return mask


def test_font_reads_back(spark):
    rows = [("a", 1, 60, 40, K.pack(ring()), 10.0, 600.0, 20.0, 450.0), ("a", 2, 3, 3, K.pack(np.ones((3, 3), bool)), 10.0, 30.0, 0.0, 450.0), ("ş", 3, 2, 2, K.pack(np.zeros((2, 2), bool)), 1.0, 1.0, 0.0, 100.0)]
    glyphs = spark.createDataFrame(rows, "char string, glyph_id long, h int, w int, mask binary, scale double, ascent double, bearing double, advance double")
    made = fonts.font_files(glyphs, "Own Hand").collect()[0]
    assert (made.glyph_count, made.characters, made.empty_outlines) == (8, 2, 3)
    font = fonts.parse(bytes(made.font))
    assert font["names"] == [".notdef", "space", "a", "a.alt1", "a.alt2", "scedilla", "scedilla.alt1", "scedilla.alt2"]
    assert font["codes"] == {32: 1, 97: 2, 0x15F: 5} and font["advances"][2] == 450
    outer, inner = font["outlines"][2]
    assert abs(fonts.area(outer)) == 300 * 500 and abs(fonts.area(inner)) == 100 * 200 and fonts.area(outer) * fonts.area(inner) < 0
    assert font["outlines"][4] == font["outlines"][2]
    words = np.frombuffer(bytes(made.font) + b"\0" * (-len(made.font) % 4), ">u4")
    assert int(words.sum(dtype=np.uint64)) & 0xFFFFFFFF == 0xB1B0AFBA


def test_fill_plan_has_tiers(spark):
    present = spark.createDataFrame([(c,) for c in "cCsoiIuv"] + [("ö",), ("ş",)], "char string")
    plan = {r.char: (r.tier, r.base, r.donor) for r in recipes.fill_plan(spark, present).collect()}
    assert plan["ç"] == ("composed", "c", "ş") and plan["Ç"] == ("composed", "C", "ç") and plan["ü"] == ("composed", "u", "ö")
    assert plan["V"] == ("transferred", "v", None) and plan["b"] == ("referenced", "b", None) and "c" not in plan


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 5.0), ("2024-01-02 00:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, event_type string, value double").parquet(str(tmp_path / "in"))
    query = profiles.windowed_counts(stream).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(r.start), r.event_type): (r.n, r.total) for r in spark.table("seen").collect()}
    assert got["2024-01-01 00:00:00", "a"] == (2, 3.0) and len(got) == 3


def test_glyph_names():
    from sparkglyph.functions import charset

    want = {"a": "a", "ç": "ccedilla", "Ğ": "Gbreve", "İ": "Idotaccent", "ı": "dotlessi", "7": "seven", "%": "percent", "ţ": "uni0163", "漢": "uni6F22", "😀": "uni1F600", "é": "eacute"}
    assert {c: charset.name_of(c) for c in want} == want
    assert all(charset.name_of(c).isidentifier() and not charset.name_of(c).startswith("uni") for c in charset.CHARSET)
