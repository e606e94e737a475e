"""Glyph shapes: marks, case transfer, weight, small deformations, smooth contours."""

from __future__ import annotations

import numpy as np

from . import kernels as K
from . import paper as P

#: X-height of the space shapes are made in, gap of a mark in base heights, upscaling of
#: the tracer, samples a curve when it is filled.
XHEIGHT, GAP, UPSCALE, SAMPLES = 100, 0.10, 4, 12
#: Fixed value: a mark whose foot stands over this share of the body's height is above it.
ABOVE = 0.6

Curve = tuple[tuple[float, float], list[tuple[tuple[float, float], tuple[float, float], tuple[float, float]]]]


def scaled(mask: np.ndarray, factor: float) -> np.ndarray:
    """The mask in another size, by area where it shrinks."""
    h, w = (max(1, round(n * factor)) for n in mask.shape)
    y, x = np.meshgrid((np.arange(h) + 0.5) / factor - 0.5, (np.arange(w) + 0.5) / factor - 0.5, indexing="ij")
    soft = K.gaussian(mask, 0.5 / factor) if factor < 0.75 else mask.astype(float)
    return P.sampled(soft, np.clip(x, 0, mask.shape[1] - 1), np.clip(y, 0, mask.shape[0] - 1)) >= 0.5


def cropped(mask: np.ndarray) -> np.ndarray:
    y, x = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return mask[y[0] : y[-1] + 1, x[0] : x[-1] + 1] if len(y) else mask[:0, :0]


def weighted(mask: np.ndarray, width: float) -> np.ndarray:
    """The mask with strokes of about ``width``: grown or eaten by half of what is missing on either side."""
    off = width - K.stroke_width(mask)
    r = round(abs(off) / 2)
    if not r:
        return mask
    room = np.pad(mask, r + 1)
    changed = K.dilate(room, r) if off > 0 else K.erode(room, r)
    return changed if changed.any() else mask


def body_and_mark(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest component, and all others."""
    labels, n = K.components(mask)
    if n < 2:
        return mask, np.zeros_like(mask)
    body = labels == 1 + int(K.areas(labels, n).argmax())
    return body, mask & ~body


def composed(base: np.ndarray, donor: np.ndarray) -> tuple[np.ndarray, int] | None:
    """``base`` with the donor's mark above or below it, centred, and by how many rows its top has moved up; None if the donor has no mark."""
    body, mark = body_and_mark(donor)
    if not mark.any():
        return None
    feet, rows = np.flatnonzero(body.any(axis=1)), np.flatnonzero(mark.any(axis=1))
    above = feet[-1] - rows[-1] > ABOVE * (feet[-1] - feet[0])
    mark, gap = cropped(mark), max(1, round(GAP * base.shape[0]))
    w = max(base.shape[1], mark.shape[1])
    middle = lambda m: np.pad(m, ((0, 0), ((w - m.shape[1]) // 2, w - m.shape[1] - (w - m.shape[1]) // 2)))
    parts = [middle(mark), np.zeros((gap, w), bool), middle(base)]
    return np.concatenate(parts if above else parts[::-1]), mark.shape[0] + gap if above else 0


def transferred(small: np.ndarray, ratio: float, width: float) -> np.ndarray:
    """A capital from its small letter: larger, with the hand's own stroke width."""
    return cropped(weighted(scaled(small, ratio), width))


def deformed(mask: np.ndarray, seed: int, strength: float = 1.5, smooth: float = 12.0) -> np.ndarray:
    """A smooth random displacement of a pixel or two, the same for the same seed."""
    pad = int(2 * strength) + 2
    room = np.pad(mask, pad)
    rng = np.random.default_rng(seed)
    dy, dx = (K.gaussian(rng.normal(size=room.shape), smooth) for _ in range(2))
    y, x = np.mgrid[: room.shape[0], : room.shape[1]].astype(float)
    unit = max(np.abs(dy).max(), np.abs(dx).max(), 1e-9)
    return cropped(P.sampled(room.astype(float), x + strength * dx / unit, y + strength * dy / unit, 0.0) > 0.5)


def traced(mask: np.ndarray, tolerance: float = 1.2) -> list[Curve]:
    """Closed cubic contours around the ink, smooth at sub-pixel size; nothing for an empty mask.

    The boundary of an enlarged, blurred copy is thinned to a polygon; the middles of its sides
    are on the curve and its corners pull it.
    """
    if not mask.any():
        return []
    large = np.kron(np.pad(mask, 1), np.ones((UPSCALE, UPSCALE)))
    out = []
    for path in K.outline(K.gaussian(large, UPSCALE / 2) > 0.5):
        corners = P.simplified(np.array(path, float), tolerance)
        if len(corners) < 3:
            continue
        corners = corners / UPSCALE - 1
        middles = (corners + np.roll(corners, -1, axis=0)) / 2
        pulls = np.roll(corners, -1, axis=0)
        segments = [(tuple(a + 2 / 3 * (c - a)), tuple(b + 2 / 3 * (c - b)), tuple(b)) for a, c, b in zip(middles, pulls, np.roll(middles, -1, axis=0), strict=True)]
        out.append((tuple(middles[0]), segments))
    return out


def points(curve: Curve) -> list[tuple[float, float]]:
    """The start and every point of every segment."""
    return [curve[0], *[p for segment in curve[1] for p in segment]]


def polygon(curve: Curve, samples: int = SAMPLES) -> np.ndarray:
    t = (np.arange(samples) + 1)[:, None] / samples
    at, out = np.array(curve[0]), []
    for a, b, c in (np.array(s) for s in curve[1]):
        out.append((1 - t) ** 3 * at + 3 * (1 - t) ** 2 * t * a + 3 * (1 - t) * t**2 * b + t**3 * c)
        at = c
    return np.concatenate(out)


def rasterized(curves: list[Curve], h: int, w: int) -> np.ndarray:
    """Pixels whose centre is inside by the even-odd rule."""
    flips = np.zeros((h, w + 1), np.int64)
    for curve in curves:
        ring = polygon(curve)
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            low, high = sorted((y0, y1))
            rows = np.arange(max(0, int(np.ceil(low - 0.5))), min(h, int(np.ceil(high - 0.5))))
            if len(rows):
                x = x0 + (rows + 0.5 - y0) / (y1 - y0) * (x1 - x0)
                np.add.at(flips, (rows, np.clip(np.ceil(x - 0.5).astype(int), 0, w)), 1)
    return (flips.cumsum(axis=1)[:, :w] % 2).astype(bool)
