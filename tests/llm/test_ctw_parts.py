"""A tree of more strings than may be sent has the depth and the scores of one that is sent whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkglyph.llm import ctw

from .fixtures import documents, frame


@pytest.mark.parametrize("most_grams, depth", [(500, 4), (500, 2), (0, 3)])
def test_depth_and_scores_do_not_depend_on_the_number_of_strings(spark, monkeypatch, most_grams, depth):
    monkeypatch.setattr(ctw, "PART", 300)
    # the held-out texts have strings that the training lacks
    odd = [(900, "Zyx 漢字 qqq\x00", "en", "s", 1), (901, "", "en", "s", 1), (902, None, "en", "s", 1)]
    docs = frame(spark, documents() + odd)
    training = docs.where("doc_id % 3 != 0")
    whole, parts = ctw.learn(training, depth=depth), ctw.learn(training, depth=depth, most_grams=most_grams)
    assert parts.model.tree.depth == depth and parts.model.tree.seen.size <= most_grams
    a, b = ({r.doc_id: r for r in ctw.score(docs, x, {"doc_id": F.col("doc_id")}).collect()} for x in (whole, parts))
    assert a.keys() == b.keys() and len(a) == 123
    assert np.allclose([a[i].score for i in a], [b[i].score for i in a], rtol=1e-6)
    assert all(a[i].n_tokens == b[i].n_tokens and abs(a[i].base_score - b[i].base_score) < 1e-9 for i in a)
