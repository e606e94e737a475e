"""Text laid out by measured widths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def wrapped(text: str, width: Callable[[str], float], most: float) -> list[str]:
    """Lines of words, each as full as ``most`` allows; a word that is wider has a line of its own."""
    out: list[str] = []
    for word in text.split():
        if out and width(f"{out[-1]} {word}") <= most:
            out[-1] += f" {word}"
        else:
            out.append(word)
    return out


def writable(bands: list[tuple[int, int, int, int]], h: int, w: int, pad: float = 0.3) -> np.ndarray:
    """Mask of the bands (x0, y0, x1, y1) of a worksheet, each higher by ``pad`` of itself on both sides."""
    out = np.zeros((h, w), bool)
    for x0, y0, x1, y1 in bands:
        room = int(pad * (y1 - y0))
        out[max(0, y0 - room) : y1 + room, max(0, x0) : x1] = True
    return out


def rendered(text: str, glyphs: dict[str, tuple[np.ndarray, float, float, float]], size: int, most: int, space: float = 300.0) -> np.ndarray:
    """A preview: dark text on white.  ``glyphs``: mask, ascent, bearing and advance in units of 1/1000 of ``size``; others are blanks."""
    from ..raster import shapes

    advance = lambda t: sum(glyphs[c][3] if c in glyphs else space for c in t) * size / 1000
    lines = wrapped(text, advance, most)
    pitch = round(1.6 * size)
    page = np.full((pitch * max(1, len(lines)) + size, most + size), 255, np.uint8)
    for k, line in enumerate(lines):
        x, base = size / 2, size + pitch * k
        for c in line:
            if c in glyphs:
                mask, ascent, bearing, _ = glyphs[c]
                small = shapes.scaled(mask, size / 1000) if mask.size else mask
                y0, x0 = max(0, round(base - ascent * size / 1000)), max(0, round(x + bearing * size / 1000))
                part = small[: page.shape[0] - y0, : page.shape[1] - x0]
                page[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]][part] = 0
            x += advance(c)
    return page
