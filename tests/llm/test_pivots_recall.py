"""Recall of border pairs does not fall with the number of pivots."""

import numpy as np
import pytest

from sparkglyph.llm import pivots


@pytest.mark.parametrize("most", [128, 256, 512, 1024])
def test_border_pairs_meet_at_any_number_of_pivots(most):
    rng = np.random.default_rng(1)
    points = pivots.spread(pivots.unit(rng.normal(size=(8 * most, 64))), most)
    a, b = pivots.unit(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    b = pivots.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    other = pivots.COSINE * a + np.sqrt(1 - pivots.COSINE**2) * b
    k = pivots.head_size(pivots.NEAREST, len(points))
    met = [len(np.intersect1d(x, y)) >= 2 for x, y in zip(pivots.heads(a, points, k), pivots.heads(other, points, k), strict=True)]
    assert np.mean(met) > 0.97
