"""Queries against the SQL that they must equal, and models on labelled rows that they didn't learn from."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sparkglyph.llm import compression, isolation, queries
from sparkglyph.llm.text import remainder

from .fixtures import SCHEMA, documents, frame, labels, odd

NAMES = ["rule_counts", "mix_targets", "word_base"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    made = {"plain": documents(150), "odd": odd(), "both": documents(60) + odd(), "empty": []}
    # one source that is far larger than its share, and one that is far smaller
    made["uneven"] = [(i, t, lang, "big" if i % 9 else "small", n) for i, t, lang, _, n in documents(150)]
    out = {}
    for name, rows in made.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{out[name]}/documents.parquet")
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("table", ["plain", "odd", "both", "uneven", "empty"])
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name, table):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[table]}/documents.parquet/*.parquet'")
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, tables[table])
    assert found.columns == columns
    got, want = in_order(tuple(r) for r in found.collect()), in_order(want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-3) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_rules_on_labels_that_are_set_aside(spark):
    rows = documents(400)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels(rows), "doc_id long, quality int, toxic int")
    counts = isolation.narrow(docs).cache()
    rules = isolation.fit(counts, marks.where(remainder("doc_id", 5) != 0))
    held = isolation.judge(counts, rules).join(marks.where(remainder("doc_id", 5) == 0).withColumnRenamed("doc_id", "_id"), "_id").collect()
    assert len(held) > 20 and all(r.kept == (r.quality == 1) for r in held)


def test_compressed_sizes_match_plain_windows():
    samples = [f"{w} and {w} of the {w}s ".encode() * 8 for w in ("wind", "rain", "snow", "light")]
    model = compression.Classifier(compression.train(samples), compression.train([s.upper() for s in samples]), (3.0, 1.0), 0.5, -1.0)
    texts = ["", None, "wind and rain", "WIND AND RAIN é" * 400, "x" * compression.WINDOW, "ab" * compression.WINDOW + "c"]

    def size(window, dictionary):
        made = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=made, write_content_size=False, write_dict_id=False, write_checksum=False).compress(window))

    for text, found, score in zip(texts, model.difference(pa.array(texts)), model.score(pa.array(texts)), strict=True):
        raw = (text or "").encode()
        parts = [raw[k : k + compression.WINDOW] for k in range(0, len(raw), compression.WINDOW)]
        good, bad = (sum(size(p, d) for p in parts) for d in (model.good, model.bad))
        want = ((bad - good) / len(raw), math.log(good / len(raw))) if raw else (0.0, 0.0)
        assert np.allclose(found, want, rtol=0, atol=1e-12)
        assert math.isclose(score, 1 / (1 + math.exp(-(3.0 * want[0] + min(want[1] + 1.0, 0.0) + 0.5))), rel_tol=1e-9)
