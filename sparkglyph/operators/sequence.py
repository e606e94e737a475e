"""Operators on ordered rows: runs, gaps, lags, extents, splits and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def token_runs(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Runs of spaces (U+0020) and of other characters, in order."""
    runs = F.regexp_extract_all(text, F.lit("( +|[^ ]+)"), F.lit(1))
    return df.select(*keys, F.posexplode(runs).alias("pos", "token")).withColumn("is_space", F.col("token").startswith(" "))


def token_width(token: Column, width, space: float = 0.75) -> Column:
    """Spaces count ``space`` each, other tokens the sum of their characters' widths."""
    letters = F.aggregate(F.transform(F.split(token, ""), width), F.lit(0.0), lambda s, x: s + x)
    return F.when(token.startswith(" "), F.length(token) * space).otherwise(letters)


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], inside: Column) -> DataFrame:
    """Rows that are inside, with ``island``: a number for each unbroken stretch of their group."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("_in", inside)
    starts = (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")
    return marked.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in").drop("_in", "_start")


def gap_medians(df: DataFrame, group: str, index: str, value: str, apart: int = 2) -> DataFrame:
    """Median of positive gaps to the next row of the group, where its index is a multiple of ``apart`` further."""
    w = Window.partitionBy(group).orderBy(index)
    rows = df.select(group, index, value, (F.lead(index).over(w) - F.col(index)).alias("step"), (F.lead(value).over(w) - F.col(value)).alias("gap"))
    return rows.where((F.col("step") % apart == 0) & (F.col("gap") > 0)).groupBy(group).agg(F.median("gap").alias("gap_median"), F.count(F.lit(1)).alias("n_gaps"))


def autocorrelation(profile: DataFrame, at: str, value: str, lags: int) -> DataFrame:
    """Mean-centred autocorrelation of a profile, over that of lag 0.

    Each place is joined to the ``lags`` places before it by an equality, not by a range.
    """
    mean = profile.agg(F.avg(value)).scalar()
    centred = profile.select(F.col(at).alias("at"), (F.col(value) - mean).alias("x"))
    shifted = centred.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "at", "x").select("lag", (F.col("at") + F.col("lag")).alias("at"), F.col("x").alias("y"))
    sums = shifted.join(centred, "at").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    zero = sums.where("lag = 0").select("s").scalar()
    return sums.select("lag", (F.col("s") / zero).alias("r"))


def first_peak(corr: DataFrame, least: float = 0.25) -> DataFrame:
    """The first lag that is a local maximum over ``least``; without one the lag of the largest value."""
    w = Window.partitionBy(F.lit(0)).orderBy("lag")  # as many rows as there are lags
    near = corr.where("lag > 0").withColumns({"_p": F.lag("r").over(w), "_n": F.lead("r").over(w)})
    peak = F.min(F.when((F.col("r") > least) & (F.col("r") >= F.col("_p")) & (F.col("r") > F.col("_n")), F.col("lag")))
    return near.agg(F.coalesce(peak, F.max_by("lag", F.struct("r", -F.col("lag")))).alias("pitch"))


def half_max_extent(profile: DataFrame, group: Sequence[str], at: str, value: str, share: float = 0.5) -> DataFrame:
    """First place and the place after the last with at least ``share`` of the group's largest value."""
    top = profile.groupBy(*group).agg(F.max(value).alias("_top"))
    hit = profile.join(top, list(group)).where(F.col(value) >= share * F.col("_top"))
    return hit.groupBy(*group).agg(F.min(at).alias("first_at"), (F.max(at) + 1).alias("end_at"))


def dense_thin_runs(profile: DataFrame, group: Sequence[str], at: str, value: str, least: float, thick: int, core: float = 0.85) -> DataFrame:
    """Runs of places over ``least``, cut to the core near their peak, that are at most ``thick`` long."""
    runs = islands(profile, group, [at], F.col(value) > least)
    peak = Window.partitionBy(*group, "island")
    inner = runs.withColumn("_peak", F.max(value).over(peak)).where(F.col(value) >= core * F.col("_peak"))
    spans = inner.groupBy(*group, "island").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max(value).alias("peak"))
    return spans.where(F.col("last_at") - F.col("first_at") + 1 <= thick)


def proportional_split(df: DataFrame, group: str, order: Sequence[str], weight: str, span: int) -> DataFrame:
    """Bounds that share ``span`` out among the rows of a group by weight, rounded half to even."""
    w = Window.partitionBy(group).orderBy(*order)
    so_far = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(group))
    return df.withColumn("bound", F.bround(span * so_far.cast("double") / total.cast("double"), 0).cast("long"))


#: Rows of a group that one task numbers, about.
RANGE = 100_000


def pages(df: DataFrame, group: Sequence[str], order: Sequence[str], per_page: int, most: int = RANGE) -> DataFrame:
    """Page and place on it of each row, ``per_page`` rows to a page.

    A group is cut at quantiles of its first order column into ranges of about ``most`` rows;
    each is numbered by itself and moved by the rows of the ranges before it.
    """
    first = order[0]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_k"))
    if sizes.where(F.col("_k") > most).isEmpty() or not isinstance(df.schema[first].dataType, NumericType):
        n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    else:
        steps = [k / 64 for k in range(1, 64)]
        cuts = df.groupBy(*group).agg(F.percentile_approx(first, steps, 1000).alias("_cuts"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
        keyed = df.join(cuts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_cuts"), same)
        # nulls come first, as in the order itself
        df = keyed.withColumn("_range", F.when(F.col(first).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(first)))))
        ranges = df.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_k"))
        before = F.coalesce(F.sum("_k").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moves = ranges.withColumn("_before", before).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), "_before")
        own = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(group)]) & (F.col("_range") == F.col("_r"))
        df = df.join(moves, own).drop(*[f"_g{i}" for i in range(len(group))], *[f"_h{i}" for i in range(len(group))], "_r", "_cuts")
        n = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1 + F.col("_before")
    return df.withColumn("_n", n).withColumns({"page": F.floor(F.col("_n") / per_page).cast("int"), "band": (F.col("_n") % per_page).cast("int")}).drop("_n", "_range", "_before")


def cycled(df: DataFrame, group: str, order: Sequence[str], slots: int) -> DataFrame:
    """``slots`` rows for each group, taken from its rows in turn."""
    w = Window.partitionBy(group)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_i") < slots)
    fits = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: s % F.least("_n", F.lit(slots)) == F.col("_i"))
    return ranked.withColumn("slot", F.explode(fits)).drop("_i", "_n")
