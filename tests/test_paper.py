import numpy as np
import pytest

from sparkglyph.raster import kernels as K
from sparkglyph.raster import paper as P

from .strokes import page

TEXT = ["ana lune dal", "nade ula en", "daun lea nad", "una alde dan"]


def on_desk(tone, seed=1):
    gray, _ = page(TEXT, seed=0)
    pad = int(0.12 * max(gray.shape))
    out = np.full((gray.shape[0] + 2 * pad, gray.shape[1] + 2 * pad), float(tone))
    out[pad:-pad, pad:-pad] = gray
    return np.clip(out + np.random.default_rng(seed).normal(0, 4, out.shape), 0, 255).astype(np.uint8), gray


@pytest.mark.parametrize("tone", [120, 45, 25])
def test_paper_is_found_on_a_desk(tone):
    photo, gray = on_desk(tone)
    found = P.find_paper(photo)
    assert found is not None and abs(found.shape[0] - gray.shape[0]) < 30 and abs(found.shape[1] - gray.shape[1]) < 30
    assert len(K.line_bands(K.ink(K.even_light(found)))) == len(TEXT)


def test_page_alone_needs_no_paper():
    gray, _ = page(TEXT)
    _, ink = P.prepared(gray)
    assert len(K.line_bands(ink)) == len(TEXT)
    assert P.find_paper(np.full((300, 200), 200, np.uint8)) is None


@pytest.mark.parametrize("angle", [-4.0, 3.0])
def test_skew_is_turned_back(angle):
    gray, _ = page(TEXT, noise=0)
    ink = K.ink(P.turned(gray, -angle))
    assert abs(P.skew(ink) - angle) <= 0.8
    assert len(K.line_bands(P.turned(ink, P.skew(ink), 0.0))) == len(TEXT)


def test_rules_go_and_strokes_that_cross_stay():
    ink = np.zeros((100, 300), bool)
    ink[50:52] = True
    ink[43:60, 100:104] = True
    out = P.without_rules(ink)
    assert out[50:52, 100:104].all() and out.sum() == 17 * 4


def test_perspective_is_undone():
    gray, _ = page(TEXT, noise=0)
    h, w = gray.shape
    flat = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    bent = np.array([[30, 20], [w - 40, 45], [w - 10, h - 15], [12, h - 60]], float)
    photo = P.warped(gray, P.homography(flat, bent), h, w)
    back = P.warped(photo, P.homography(bent, flat), h, w)
    assert np.abs(back[20:-20, 20:-20].astype(int) - gray[20:-20, 20:-20]).mean() < 6
    corners = {k: np.array([[x, y], [x + 20, y], [x + 20, y + 20], [x, y + 20]], float) for k, (x, y) in enumerate([(5, 5), (w - 30, 5), (w - 30, h - 30), (5, h - 30)])}
    seen = {k: P.projected(P.homography(flat, bent), c) for k, c in corners.items() if k}
    again = P.registered(photo, seen, corners, h, w)
    assert np.abs(again[20:-20, 20:-20].astype(int) - gray[20:-20, 20:-20]).mean() < 6
    with pytest.raises(ValueError):
        P.registered(photo, {0: corners[0]}, corners, h, w)
    points, images = np.concatenate([corners[k] for k in seen]), np.concatenate(list(seen.values()))
    images[5] += 80  # one corner is misread
    matrix = P.robust_homography(points, images)
    assert np.abs(P.projected(matrix, flat) - bent).max() < 0.5


def test_corners_and_hulls():
    square = np.array([[0, 0], [10, 0], [10, 8], [0, 8]], float)
    assert (P.ordered(square[[2, 0, 3, 1]]) == square).all()
    points = np.array([[x, y] for x in range(11) for y in range(9)])
    assert {tuple(p) for p in P.hull(points)} == {tuple(p) for p in square}
    assert P.inside(square, 20, 20).sum() == 11 * 9
    assert len(P.simplified(np.array([[0, 0], [5, 0.1], [10, 0], [10, 8], [0, 8]], float), 0.5)) == 4


def png(depth, color, rows, palette=b""):
    import struct
    import zlib

    h, w = len(rows), rows[0][0]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(b"".join(b"\0" + r for _, r in rows))) + part(b"IEND", b"")


def test_other_depths_and_palettes_are_read(spark):
    from sparkglyph.sources import images

    assert images.decode(png(1, 0, [(10, b"\xaa\x80")])).tolist() == [[255, 0] * 4 + [255, 0]]
    assert images.decode(png(16, 0, [(2, b"\x12\x34\xff\x00")])).tolist() == [[0x12, 0xFF]]
    assert images.decode(png(2, 3, [(3, b"\x18")], bytes([0, 0, 0, 255, 255, 255, 255, 0, 0]))).tolist() == [[0, 255, 76]]
    pages = spark.createDataFrame([("file:/a/x.png", None), ("file:/a/y.png", "bad")], "source string, error string")
    assert [r.name for r in images.missing(pages, spark.createDataFrame([("x.png",), ("y.png",), ("z.png",)], "name string")).collect()] == ["y.png", "z.png"]


def test_layout():
    from sparkglyph.functions import layout

    assert layout.wrapped("aa bb  cccccc d", len, 5) == ["aa bb", "cccccc", "d"]
    assert layout.writable([(1, 10, 4, 20)], 30, 6).sum() == 3 * 16
    page = layout.rendered("ab a", {"a": (np.ones((500, 300), bool), 500.0, 20.0, 400.0)}, 40, 200)
    assert page.min() == 0 and (page == 0).sum() == 2 * 20 * 12
