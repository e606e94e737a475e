"""TrueType files from outline rows: a small writer and a reader to check it by.

A font has one row for each glyph, bounded by the alphabet and the variants of each
character, so its file is made in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charset as C
from ..operators import sequence
from ..raster import kernels as K

UNITS = 1000
VARIANTS = 3


@dataclass
class Shape:
    name: str
    code: int | None
    advance: int
    contours: list[list[tuple[int, int]]]


def to_units(mask: np.ndarray, scale: float, ascent: float, bearing: float) -> list[list[tuple[int, int]]]:
    """Contours of a mask in font units: y upward, the ink's top at ``ascent``, its left edge at ``bearing``."""
    paths = [[(round(bearing + x * scale), round(ascent - y * scale)) for x, y in path] for path in K.outline(mask)]
    return paths if sum(map(area, paths)) <= 0 else [p[::-1] for p in paths]


def area(path: Sequence[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, [*path[1:], path[0]], strict=True)) / 2


def _glyph(contours: list[list[tuple[int, int]]]) -> bytes:
    points = [p for c in contours for p in c]
    if not points:
        return b""
    xs, ys = zip(*points, strict=True)
    ends = np.cumsum([len(c) for c in contours]) - 1
    steps = lambda v: struct.pack(f">{len(v)}h", *np.diff([0, *v]).tolist())
    out = struct.pack(">hhhhh", len(contours), min(xs), min(ys), max(xs), max(ys)) + struct.pack(f">{len(ends)}H", *ends.tolist()) + struct.pack(">H", 0) + b"\x01" * len(points) + steps(xs) + steps(ys)
    return out + b"\0" * (-len(out) % 4)


def _cmap(codes: dict[int, int]) -> bytes:
    groups = b"".join(struct.pack(">III", c, c, g) for c, g in sorted(codes.items()))
    table = struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(codes)) + groups
    return struct.pack(">HHHHI", 0, 1, 3, 10, 12) + table


def build(shapes: Sequence[Shape], family: str, ascender: int = 800, descender: int = -300) -> bytes:
    """A TrueType file; the first glyph is the one for characters that are not there."""
    shapes = [Shape(".notdef", None, UNITS // 2, []), *shapes]
    data = [_glyph(s.contours) for s in shapes]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    points = [[p for c in s.contours for p in c] for s in shapes]
    left = [min((x for x, _ in p), default=0) for p in points]
    box = [f((q[i] for p in points for q in p), default=0) for i, f in ((0, min), (1, min), (0, max), (1, max))]
    widest = max(s.advance for s in shapes)
    names = b"".join(bytes([len(n)]) + n for n in (s.name.encode()[:63] for s in shapes))
    texts = [(1, family), (2, "Regular"), (4, family), (6, family.replace(" ", ""))]
    strings = [t.encode("utf-16-be") for _, t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    codes = {s.code: i for i, s in enumerate(shapes) if s.code is not None}
    tables = {
        b"OS/2": struct.pack(">HhHHHhhhhhhhhhhh10sIIII4sHHHhhhHH", 3, widest // 2, 400, 5, 0, *[0] * 11, b"\0" * 10, 0, 0, 0, 0, b"NONE", 64, min(codes, default=0) & 0xFFFF, max(codes, default=0) & 0xFFFF, ascender, descender, 0, ascender, -descender) + b"\0" * 18,
        b"cmap": _cmap(codes),
        b"glyf": b"".join(data),
        b"head": struct.pack(">IIIIHHQQhhhhHHhhh", 0x10000, 0x10000, 0, 0x5F0F3CF5, 3, UNITS, 0, 0, *box, 0, 8, 2, 1, 0),
        b"hhea": struct.pack(">IhhhHhhhhhhhhhhhH", 0x10000, ascender, descender, 0, widest, min(left), 0, box[2], 1, *[0] * 7, len(shapes)),
        b"hmtx": b"".join(struct.pack(">Hh", s.advance, x) for s, x in zip(shapes, left, strict=True)),
        b"loca": struct.pack(f">{len(at)}I", *at.tolist()),
        b"maxp": struct.pack(">IHHHHHHHHHHHHHH", 0x10000, len(shapes), max(map(len, points)), max(len(s.contours) for s in shapes), 0, 0, 1, *[0] * 8),
        b"name": struct.pack(">HHH", 0, len(texts), 6 + 12 * len(texts)) + b"".join(struct.pack(">HHHHHH", 3, 1, 0x409, k, len(s), int(a)) for (k, _), s, a in zip(texts, strings, starts, strict=False)) + b"".join(strings),
        b"post": struct.pack(">IIhhIIIII", 0x20000, 0, -100, 50, 0, 0, 0, 0, 0) + struct.pack(f">H{len(shapes)}H", len(shapes), *range(258, 258 + len(shapes))) + names,
    }
    total = lambda raw: sum(struct.unpack(f">{len(raw) // 4}I", raw)) & 0xFFFFFFFF
    padded = {k: v + b"\0" * (-len(v) % 4) for k, v in sorted(tables.items())}
    power = len(padded).bit_length() - 1
    head = struct.pack(">IHHHH", 0x10000, len(padded), 16 << power, power, 16 * len(padded) - (16 << power))
    place = 12 + 16 * len(padded)
    for tag, raw in padded.items():
        head += tag + struct.pack(">III", total(raw), place, len(tables[tag]))
        place += len(raw)
    font = head + b"".join(padded.values())
    adjust = struct.pack(">I", (0xB1B0AFBA - total(font)) & 0xFFFFFFFF)
    at_head = struct.unpack(">I", font[font.index(b"head") + 8 : font.index(b"head") + 12])[0] + 8
    return font[:at_head] + adjust + font[at_head + 4 :]


def parse(font: bytes) -> dict[str, object]:
    """Glyph names, advances, character codes and contours of a file made by :func:`build`."""
    n = struct.unpack(">H", font[4:6])[0]
    tables = {font[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", font[20 + 16 * i : 28 + 16 * i]) for i in range(n)}
    raw = {k: font[a : a + size] for k, (a, size) in tables.items()}
    count = struct.unpack(">H", raw[b"maxp"][4:6])[0]
    at = struct.unpack(f">{count + 1}I", raw[b"loca"])
    advances = [struct.unpack(">H", raw[b"hmtx"][4 * i : 4 * i + 2])[0] for i in range(count)]
    groups = struct.unpack(">I", raw[b"cmap"][24:28])[0]
    codes = {c: g for c, _, g in struct.iter_unpack(">III", raw[b"cmap"][28 : 28 + 12 * groups])}
    names, place = [], 34 + 2 * count
    while place < len(raw[b"post"]) and len(names) < count:
        size = raw[b"post"][place]
        names.append(raw[b"post"][place + 1 : place + 1 + size].decode())
        place += size + 1
    outlines = []
    for a, b in zip(at, at[1:], strict=False):
        g = raw[b"glyf"][a:b]
        if not g:
            outlines.append([])
            continue
        k = struct.unpack(">h", g[:2])[0]
        ends = struct.unpack(f">{k}H", g[10 : 10 + 2 * k])
        p = 10 + 2 * k + 2 + ends[-1] + 1
        m = ends[-1] + 1
        xs, ys = (np.cumsum(struct.unpack(f">{m}h", g[p + 2 * m * i : p + 2 * m * (i + 1)])).tolist() for i in (0, 1))
        points = list(zip(xs, ys, strict=True))
        outlines.append([points[s : e + 1] for s, e in zip([0, *[x + 1 for x in ends[:-1]]], ends, strict=True)])
    return {"names": names, "advances": advances, "codes": codes, "outlines": outlines}


def calt_feature(names: DataFrame, char: str = "char", slot: str = "slot", name: str = "name") -> DataFrame:
    """Text of the contextual alternates: classes of each variant, aligned by character."""
    per = names.groupBy(slot).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(char, name))), lambda x: x[name]), " ").alias("members"))
    return per.select(slot, F.concat(F.lit("@v"), F.col(slot).cast("string"), F.lit(" = ["), F.col("members"), F.lit("];")).alias("line"))


def font_files(glyphs: DataFrame, family: str, key: str = "family") -> DataFrame:
    """One row for each value of ``key``: the file, its glyphs and characters, and empty outlines.

    ``glyphs``: char, glyph_id, h, w, mask, scale, ascent, bearing, advance.  Each character gets
    ``VARIANTS`` glyphs, its samples in turn where it has fewer.
    """
    laid = sequence.cycled(glyphs, "char", ["glyph_id"], VARIANTS).withColumn(key, F.lit(family))

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        shapes, empty = [Shape("space", 32, UNITS // 3, [])], 0
        for r in frame.sort_values(["char", "slot"]).itertuples(index=False):
            base = C.name_of(r.char)
            contours = to_units(K.unpack(r.mask, r.h, r.w), r.scale, r.ascent, r.bearing)
            empty += not contours
            shapes.append(Shape(base if r.slot == 0 else f"{base}.alt{r.slot}", ord(r.char) if r.slot == 0 else None, max(0, round(r.advance)), contours))
        return pd.DataFrame([(frame[key].iloc[0], build(shapes, family), len(shapes) + 1, frame["char"].nunique(), empty)], columns=[key, "font", "glyph_count", "characters", "empty_outlines"])

    columns = [key, "char", "slot", "h", "w", "mask", "scale", "ascent", "bearing", "advance"]
    return laid.select(*columns).groupBy(key).applyInPandas(made, f"{key} string, font binary, glyph_count int, characters int, empty_outlines int")
