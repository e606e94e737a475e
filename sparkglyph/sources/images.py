"""Page images in and out: PNG and binary PGM with the standard library alone, JPEG by Spark's own image source.

Files whose name ends as a JPEG's does are decoded in the JVM and turned as their EXIF orientation says.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
PAGE = "page_id long, source string, h int, w int, gray binary, error string"
#: Weights of red, green and blue in gray.
LUMA = np.array([0.299, 0.587, 0.114])
#: First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
JPEG, JPEG_FILES = r"(?i)\.jp(e|g|eg)$", "*.[jJ][pP]{[eE],[gG],[eE][gG]}"
#: The tag of the orientation, and how the stored rows are turned for orientations 1 to 8.
ORIENTATION = 0x0112
TURNS = [lambda g: g, np.fliplr, lambda g: g[::-1, ::-1], np.flipud, lambda g: g.T, lambda g: np.rot90(g, -1), lambda g: g[::-1, ::-1].T, np.rot90]


def _unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), np.int64)
    for y, (row, kind) in enumerate(zip(rows.astype(np.int64), kinds.tolist(), strict=True), 1):
        up = out[y - 1]
        if kind == 0:
            out[y, step:] = row
        elif kind == 2:
            out[y, step:] = row + up[step:] & 255
        elif kind == 1:
            out[y, step:] = row.reshape(-1, step).cumsum(axis=0).ravel() & 255
        else:
            own = out[y]
            for i, v in enumerate(row.tolist(), step):
                a, b, c = int(own[i - step]), int(up[i]), int(up[i - step])
                if kind == 3:
                    guess = a + b >> 1
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i] = v + guess & 255
    return out[1:, step:].astype(np.uint8)


def _samples(data: bytes, h: int, w: int, channels: int, depth: int, color: int) -> tuple[np.ndarray, bytes]:
    """The first h filtered lines of a PNG's data as 8-bit samples (of palettes: as they are), and the data behind them."""
    wide = -(-w * channels * depth // 8)
    lines = np.frombuffer(data, np.uint8, h * (wide + 1)).reshape(h, wide + 1)
    image = _unfilter(lines[:, 1:], lines[:, 0], max(1, channels * depth // 8)).reshape(h, wide)
    if depth == 16:
        image = image[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(image, axis=1).reshape(h, -1, depth)
        image = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, :w]
        image = image if color == 3 else np.rint(image * (255 / (2**depth - 1))).astype(np.uint8)
    return image.reshape(h, w, channels), data[h * (wide + 1) :]


def decode(raw: bytes) -> np.ndarray:
    """Gray page of a PNG or PGM file; ValueError says what is wrong."""
    if raw[:2] == b"P5":
        head, at = [], 2
        while len(head) < 3:
            end = at
            while raw[end : end + 1].isspace():
                end += 1
            at = end
            while not raw[at : at + 1].isspace():
                at += 1
            head.append(int(raw[end:at]))
        w, h, _ = head
        return np.frombuffer(raw, np.uint8, h * w, at + 1).reshape(h, w)
    if raw[:8] != PNG:
        raise ValueError("neither PNG, PGM nor named as JPEG")
    at, data, head, colors = 8, b"", b"", b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        head = body if kind == b"IHDR" else head
        colors = body if kind == b"PLTE" else colors
        data += body if kind == b"IDAT" else b""
        at += n + 12
    w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlace > 1 or depth not in (1, 2, 4, 8, 16):
        raise ValueError(f"PNG of depth {depth}, color type {color}, interlace {interlace} isn't read")
    data, image = zlib.decompress(data), np.zeros((h, w, channels), np.uint8)
    for x, y, across, down in PASSES if interlace else [(0, 0, 1, 1)]:
        size = (max(0, -(-(h - y) // down)), max(0, -(-(w - x) // across)))
        if all(size):
            image[y::down, x::across], data = _samples(data, *size, channels, depth, color)
    if color == 3:
        image = np.frombuffer(colors, np.uint8).reshape(-1, 3)[image[:, :, 0]]
    return image[:, :, 0].copy() if image.shape[2] < 3 else np.rint(image[:, :, :3] @ LUMA).astype(np.uint8)


def orientation(raw: bytes) -> int:
    """The EXIF orientation, 1 to 8, of a JPEG file; 1 where there is none or it can't be read."""
    at = 2
    while raw[at : at + 1] == b"\xff" and at + 4 <= len(raw) and raw[at + 1] != 0xDA:
        n = int.from_bytes(raw[at + 2 : at + 4])
        body = raw[at + 4 : at + 2 + n]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff, order = body[6:], "<" if body[6:8] == b"II" else ">"
            try:
                (first,) = struct.unpack_from(order + "I", tiff, 4)
                (count,) = struct.unpack_from(order + "H", tiff, first)
                for k in range(count):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * k)
                    if tag == ORIENTATION:
                        return value if 1 <= value <= len(TURNS) else 1
            except struct.error:
                return 1
        at += 2 + max(n, 2)
    return 1


def missing(pages: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    """Expected file names that no page was read from, and those whose page has an error."""
    read = pages.where("error is null").select(F.element_at(F.split("source", "/"), -1).alias(name))
    return expected.select(name).join(read, name, "left_anti").orderBy(name)


def encode(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = gray.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.pad(gray.astype(np.uint8), ((0, 0), (1, 0))).tobytes()
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def read_pages(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """One row for each image below the path or paths; what can't be read keeps its row, with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    photo = F.col("path").rlike(JPEG)

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, name, raw in zip(frame["page_id"], frame["path"], frame["content"], strict=True):
                try:
                    page = decode(bytes(raw))
                    rows.append((key, name, *page.shape, page.tobytes(), None))
                except Exception as error:
                    rows.append((key, name, 0, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["page_id", "source", "h", "w", "gray", "error"])

    def turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"at": frame["at"], "path": frame["path"], "turn": [orientation(bytes(raw)) for raw in frame["content"]]})

    def grayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, name, turn, h, w, channels, raw in frame[["page_id", "path", "turn", "height", "width", "nChannels", "data"]].itertuples(index=False):
                if h <= 0:
                    rows.append((key, name, 0, 0, None, "ValueError: not a JPEG that can be decoded"))
                    continue
                page = np.frombuffer(raw, np.uint8).reshape(h, w, channels)
                page = page[:, :, 0] if channels < 3 else np.rint(page[:, :, 2::-1] @ LUMA).astype(np.uint8)
                page = TURNS[turn - 1](page)
                rows.append((key, name, *page.shape, page.tobytes(), None))
            yield pd.DataFrame(rows, columns=["page_id", "source", "h", "w", "gray", "error"])

    # a page's number is a hash of its path, so reruns agree
    plain = files.where(~photo).select(F.xxhash64("path").alias("page_id"), "path", "content").mapInPandas(decoded, PAGE)
    if files.where(photo).select("path").isEmpty():  # names alone, no content
        return plain
    turn = files.where(photo).select(F.col("_metadata.file_path").alias("at"), "path", "content").mapInPandas(turns, "at string, path string, turn int")
    pixels = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", JPEG_FILES).option("recursiveFileLookup", "true").load(path)
    photos = pixels.select("image.*", F.col("_metadata.file_path").alias("file")).join(turn, F.col("file") == F.col("at"))
    return plain.unionByName(photos.select(F.xxhash64("path").alias("page_id"), "path", "turn", "height", "width", "nChannels", "data").mapInPandas(grayed, PAGE))
