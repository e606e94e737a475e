"""Joins with defaults, nearest and overlap matches, fills in tiers.

Both sides are hash-partitioned by an equality key; a join by distance is one by cells of
values, and none is over all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging

#: An item of more rows is frequent; rows in a block of owners, about; numbers in a table that is sent to every executor.
FREQUENT, BLOCK_ROWS, MOST_SENT = 1024, 250_000, 500_000


def left_default(expected: DataFrame, found: DataFrame, key: str, **defaults) -> DataFrame:
    """Every expected key; where nothing was found, the defaults."""
    rows = expected.join(found, key, "left")
    return rows.select(*expected.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def last_wins(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key: that of the greatest ``order``."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def nearest_within(points: DataFrame, anchors: DataFrame, key: str, point: str, value: str, anchor: str, at: str, most: Column) -> DataFrame:
    """For each point the nearest anchor with the same key, if it is within ``most`` (a column of anchors); ties to the least anchor.

    Values are dealt into cells as wide as the largest ``most``.  An anchor stands in its own
    cell and both beside it, so a point meets in its cell all anchors near enough to matter,
    and a key with very many rows is as many cells as its values span.
    """
    reach = anchors.agg(F.max(most)).scalar()
    wide = F.when(reach > 0, reach).otherwise(1.0)
    cell = lambda c: F.floor(F.col(c) / wide).cast("long")
    there = anchors.select(key, anchor, at, most.alias("_most"), F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)).alias("_cell"))
    pairs = points.withColumn("_cell", cell(value)).join(there, [key, "_cell"]).withColumn("_d", F.abs(F.col(value) - F.col(at)))
    best = pairs.groupBy(point).agg(F.min_by(F.struct(F.col(anchor).alias("anchor"), F.col("_d").alias("distance"), F.col("_most").alias("most")), F.struct("_d", anchor)).alias("b"))
    return best.where("b.distance <= b.most").select(point, F.col("b.anchor").alias(anchor), F.col("b.distance").alias("distance"))


def _rare_first(df: DataFrame, owner: str, item: str, often: DataFrame, least: int) -> DataFrame:
    """Each owner's items, and of them all but the ``least - 1`` most frequent ones."""
    ranked = df.select(owner, item).distinct().join(often, item).groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("_often", item))).alias("_i"))
    items = F.transform("_i", lambda x: x[item])
    return ranked.select(owner, items.alias("_items"), F.slice(items, 1, F.greatest(F.size("_i") - (least - 1), F.lit(0))).alias("_rare"))


def sharing(left: DataFrame, right: DataFrame, item: str, a: str, b: str, least: int) -> DataFrame:
    """Pairs of owners with at least ``least`` items in common, and their number ``hits``.

    Two such owners share one of their rarer items too, when each leaves out its ``least - 1`` most
    frequent ones; so the commonest items bring no pairs together, and are only counted for those found.
    """
    often = left.select(item).unionAll(right.select(item)).groupBy(item).agg(F.count(F.lit(1)).alias("_often"))
    x, y = _rare_first(left, a, item, often, least), _rare_first(right, b, item, often, least)
    met = x.select(a, F.explode("_rare").alias(item)).join(y.select(b, F.explode("_rare").alias(item)), item).select(a, b).distinct()
    both = met.join(x.select(a, F.col("_items").alias("_x")), a).join(y.select(b, F.col("_items").alias("_y")), b)
    return both.select(a, b, F.size(F.array_intersect("_x", "_y")).cast("long").alias("hits")).where(F.col("hits") >= least)


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() * len(df.columns) <= MOST_SENT else df


def sharing_within(df: DataFrame, owner: str, item: str, least: int) -> DataFrame:
    """Pairs a < b of owners with at least ``least`` items in common, with their number ``shared`` and the sizes ``n`` and ``m`` of both sets.

    Sets don't travel with pairs.  Owners are dealt into blocks by their order; for each item and block there
    is a list of owners, lists of the same item meet, and what is shuffled is two lists for each meeting, not
    their pairs, which are counted in the block of ``a``.  Of its frequent items an owner's ``least - 1`` most
    frequent ones bring it together with no owner of whom that holds too, and are only counted for pairs found.
    """
    spark = df.sparkSession
    rows = df.select(F.col(owner).alias("_a"), F.col(item).alias("_i"))
    owners = staging.stage(rows.where("_a IS NOT NULL").groupBy("_a").agg(F.count(F.lit(1)).alias("_rows")), "owners")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(owners.agg(F.sum("_rows")).first()[0] or 0) // BLOCK_ROWS))
    # the partition's number is in the upper bits, so numbers are in the order of owners and tell their blocks
    numbers = staging.stage(owners.select("_a").repartitionByRange(blocks, "_a").sortWithinPartitions("_a").withColumn("_no", F.monotonically_increasing_id()), "numbers")
    block = lambda c: F.shiftright(c, 33).cast("int")
    numbered = rows.join(_sent(numbers), "_a").select("_no", "_i")
    often = rows.where("_i IS NOT NULL").groupBy("_i").agg(F.count(F.lit(1)).alias("_often")).where(F.col("_often") > FREQUENT)
    often = staging.stage(often, "frequent") if least > 1 else None
    common = None
    if often is None or often.isEmpty():
        split = numbered.withColumn("_rare", F.lit(True))
    else:
        held = numbered.join(_sent(often), "_i").distinct()
        most = F.slice(F.sort_array(F.collect_list(F.struct("_often", "_i")), asc=False), 1, least - 1)
        common = staging.stage(held.groupBy("_no").agg(F.transform(most, lambda x: x["_i"]).alias("_common")), "common")
        left_out = F.broadcast(common) if common.count() * least <= MOST_SENT else common
        split = numbered.join(left_out, "_no", "left").select("_no", "_i", (~F.coalesce(F.array_contains("_common", F.col("_i")), F.lit(False))).alias("_rare"))
    rare, other = (F.collect_set(F.when(test, F.col("_no"))) for test in (F.col("_rare"), ~F.col("_rare")))
    lists = staging.stage(split.groupBy("_i", block(F.col("_no")).alias("_block")).agg(rare.alias("_r"), other.alias("_o")), "lists")
    sizes = lists.select(F.explode(F.concat("_r", "_o")).alias("_no")).groupBy("_no").agg(F.count(F.lit(1)).alias("n"))
    there = lists.select("_i", F.col("_block").alias("_there"), F.col("_r").alias("_s"), F.col("_o").alias("_p"))
    met = lists.join(there, "_i").where(F.col("_block") <= F.col("_there"))
    ways = F.array(F.struct(F.col("_r").alias("x"), F.concat("_s", "_p").alias("y")), F.struct(F.col("_o").alias("x"), F.col("_s").alias("y")))
    ways = met.select("_block", F.explode(F.filter(ways, lambda w: (F.size(w["x"]) > 0) & (F.size(w["y"]) > 0))).alias("w")).select("_block", "w.x", "w.y")
    pairs = ways.repartition(blocks, "_block").select("_block", F.explode("x").alias("x"), "y").select("_block", "x", F.explode("y").alias("y")).where("x < y")
    found = pairs.groupBy("_block", "x", "y").agg(F.count(F.lit(1)).alias("hits"))
    named = numbers.join(sizes, "_no")
    if common is not None:
        named = named.join(common, "_no", "left")
    named = staging.stage(named, "named")
    sent = F.broadcast(named) if named.count() * (3 if common is None else 2 + least) <= MOST_SENT else named
    side = lambda a, no, n, c: sent.select(F.col("_a").alias(a), F.col("_no").alias(no), F.col("n").alias(n), *([] if common is None else [F.col("_common").alias(c)]))
    both = found.where(F.col("hits") >= least) if common is None else found
    both = both.join(side("a", "x", "n", "_c"), "x").join(side("b", "y", "m", "_d"), "y")
    shared = F.col("hits") if common is None else F.col("hits") + F.greatest(F.size(F.array_intersect("_c", "_d")), F.lit(0))
    return both.select("a", "b", shared.cast("long").alias("shared"), "n", "m").where(F.col("shared") >= least)


def best_overlap(left: DataFrame, right: DataFrame, item: str, a: str, b: str, least: int = 3) -> DataFrame:
    """For each ``a`` the ``b`` that shares the most items, if at least ``least``; ties to the least ``b``."""
    hits = sharing(left, right, item, a, b, max(1, least))
    best = hits.groupBy(a).agg(F.min_by(F.struct(F.col(b), F.col("hits")), F.struct(-F.col("hits"), F.col(b))).alias("m"))
    return best.select(a, F.col(f"m.{b}").alias(b), F.col("m.hits").alias("hits"))


def absent(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def composable(recipes: DataFrame, present: DataFrame, base: str, donor: str, key: str) -> DataFrame:
    """Recipes of which both parts are present."""
    own = present.select(key).distinct()
    return recipes.join(own.withColumnRenamed(key, base), base, "left_semi").join(own.withColumnRenamed(key, donor), donor, "left_semi")


def first_tier(df: DataFrame, **tiers: Column) -> DataFrame:
    """``value`` of the first tier that has one, and the ``tier``'s name."""
    names = F.lit(None).cast("string")
    for name, c in reversed(list(tiers.items())):
        names = F.when(c.isNotNull(), name).otherwise(names)
    return df.withColumns({"value": F.coalesce(*tiers.values()), "tier": names})
