"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins on pre-aggregated minima; edges live in Parquet in the
shared folder between rounds, never on the driver.  A node with very many edges is
no hot key: minima of up to ``MOST_SENT`` nodes are sent to the edges, and beyond that
both sides of the join are plain tables, which lets Spark split the key.  Rounds
end when the edge table repeats itself, after a number that grows with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import staging

#: Rows of minima, two numbers each, that are sent to every executor.
MOST_SENT = 250_000


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that isn't the smallest of its component.

    Nodes are non-null numbers; loops and repeated edges don't matter; without edges the result is empty.
    """
    ends = edges.where(F.col(a) != F.col(b))
    current = staging.stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    sign = _sign(current)
    while sign[0]:
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(current.select("v", "u"))
        # a node without a smaller neighbour is its own minimum, as its edges say already
        least = staging.stage(both.groupBy("x").agg(F.min("y").alias("m")).where("m < x"), "minima")
        known = F.broadcast(least) if least.count() <= MOST_SENT else least
        large = both.where("y > x").join(known, "x", "left").select(F.col("y").alias("u"), F.coalesce("m", "x").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # where v is the minimum the row is (u, m); any other row is (v, m), and u keeps (u, m) by its own minimum row
        after = staging.stage(small.distinct(), "edges")
        found = _sign(after)
        staging.drop(current)
        staging.drop(least)
        current = after
        if found == sign:
            break
        sign = found
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
