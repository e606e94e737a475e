"""Registered queries against the SQL that they must agree with, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sparkglyph.operators import match, robust, sequence
from sparkglyph.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return c


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) and v == v else "null" if v is None or v != v else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_guards(spark):
    few = spark.createDataFrame([(1, -5.0), (2, 3.0)], "k int, v double")
    assert robust.asymmetric(few, "v").count() == 0
    assert robust.at_least_median_share(few, "v").count() == 2


def test_ties_go_to_the_first(spark):
    points = spark.createDataFrame([(1, 1, 5.0)], "g int, p int, v double")
    anchors = spark.createDataFrame([(1, 8, 4.0), (1, 3, 6.0), (1, 9, 50.0)], "g int, a int, at double")
    from pyspark.sql import functions as F

    assert match.nearest_within(points, anchors, "g", "p", "v", "a", "at", F.lit(2.0)).collect()[0].a == 3
    assert match.last_wins(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, o int, v string"), "k", "o", ["v"]).collect()[0].v == "y"


def test_tokens(spark):
    rows = spark.createDataFrame([("ab  cd",), (" a",)], "t string")
    assert [(r.token, r.is_space) for r in sequence.token_runs(rows, "t", ["t"]).collect()] == [("ab", False), ("  ", True), ("cd", False), (" ", True), ("a", False)]
