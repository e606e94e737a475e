"""Procedural pages: each character is a few strokes in a cell, with its true extent."""

from __future__ import annotations

import numpy as np

#: Shapes on a 3 x 5 raster of strokes: rows from the top; the third to fifth are the x-height.
SHAPES = {"a": ("000", "000", "111", "101", "111"), "n": ("000", "000", "111", "101", "101"), "l": ("010", "010", "010", "010", "010"), "u": ("000", "000", "101", "101", "111"), "e": ("000", "000", "110", "111", "110"), "d": ("001", "001", "111", "101", "111")}
CELL, STROKE = 12, 5


def page(lines: list[str], seed: int = 0, noise: float = 3.0) -> tuple[np.ndarray, list[tuple[int, int, str, int, int]]]:
    """Gray page and (line, char index, char, x from, x to) of each character."""
    rng = np.random.default_rng(seed)
    w = 80 + max(map(len, lines)) * CELL * 4
    gray = np.full((60 + 130 * len(lines), w), 225.0)
    truth = []
    for k, text in enumerate(lines):
        x, top = 40, 40 + 130 * k
        for i, c in enumerate(text):
            if c == " ":
                x += 3 * CELL
                continue
            cells = [(r, q) for r, row in enumerate(SHAPES[c]) for q, on in enumerate(row) if on == "1"]
            left = min(q for _, q in cells)
            for r, q in cells:
                y, xx = top + r * CELL, x + (q - left) * CELL
                gray[y : y + CELL, xx : xx + (STROKE if len({q for _, q in cells}) == 1 else CELL)] = 40
            width = (max(q for _, q in cells) - left) * CELL + (STROKE if len({q for _, q in cells}) == 1 else CELL)
            truth.append((k, i, c, x, x + width))
            x += width + 6
    return np.clip(gray + rng.normal(0, noise, gray.shape), 0, 255).astype(np.uint8), truth
