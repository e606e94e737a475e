"""Ratios, calibrations, thresholds and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import match


def exact(c: Column | str, places: int = 2) -> Column:
    """A value of so many decimal places as a decimal, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(28,{places})")


def ratio_of_sums(df: DataFrame, group: str, over: str, under: str) -> DataFrame:
    """Sum over sum (not the mean of ratios); 0 where the lower sum isn't positive."""
    sums = df.groupBy(group).agg(F.sum(exact(over)).cast("double").alias("o"), F.sum(exact(under)).cast("double").alias("u"))
    return sums.select(group, F.when(F.col("u") > 0, F.col("o") / F.col("u")).otherwise(0.0).alias("scale"))


def scaled_medians(df: DataFrame, scales: DataFrame, join: str, group: str, value: str, least: int) -> DataFrame:
    """Median of value over scale in each group with ``least`` rows; rows of scale 0 or less don't count."""
    rows = df.join(scales.where("scale > 0"), join)
    return rows.groupBy(group).agg(F.median(F.col(value) / F.col("scale")).alias("measured"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def otsu(df: DataFrame, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """The histogram bin that divides a column into the two classes farthest apart.

    Only the histogram is windowed: as many rows as there are bins.
    """
    bin_ = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    hist = df.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    part = hist.select("bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(everything).alias("w"), F.sum(F.col("n") * F.col("bin")).over(everything).alias("s"))
    w1 = (F.col("w") - F.col("w0")).cast("double")
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = part.where("w0 < w").select("bin", (F.col("w0") * w1 * apart * apart).alias("between"))
    return scored.agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold_bin"))


def line_through_medians(df: DataFrame, level: str, value: str, least: int) -> DataFrame:
    """Slope and intercept of the least-squares line through the median of each level with ``least`` rows.

    With fewer than two levels or a slope of 0.1 or less: the ratio of the means and no intercept.
    """
    points = df.groupBy(level).agg(F.median(value).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    fit = points.agg(F.regr_slope("m", level).alias("a"), F.regr_intercept("m", level).alias("b"), F.count(F.lit(1)).alias("levels"), (F.avg("m") / F.avg(level)).alias("ratio"))
    ok = (F.col("levels") >= 2) & (F.col("a") > 0.1)
    return fit.select(F.when(ok, F.col("a")).otherwise(F.col("ratio")).alias("slope"), F.when(ok, F.col("b")).otherwise(0.0).alias("intercept"))


def ratio_median(df: DataFrame, group: str, ratio: Column, least: int = 5) -> DataFrame:
    """Median ratio of each group with ``least`` rows, else 1."""
    rows = df.groupBy(group).agg(F.median(ratio).alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.select(group, "n", F.when(F.col("n") >= least, F.col("m")).otherwise(1.0).alias("factor"))


def bands(df: DataFrame, group: str, score: Column) -> DataFrame:
    """Share of scores over 0.8, over 0.6 and under 0.4."""
    of = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return df.groupBy(group).agg(of(score > 0.8).alias("good"), of(score > 0.6).alias("fair"), of(score < 0.4).alias("bad"), F.count(F.lit(1)).alias("n"))


def worst(df: DataFrame, group: str, score: Column, k: int = 12) -> DataFrame:
    """The ``k`` groups of the least mean score; ties to the least group."""
    return df.groupBy(group).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n")).orderBy("mean_score", group).limit(k)


def purity_coverage(df: DataFrame, group: str, own: Column, labelled: Column) -> DataFrame:
    """Own over labelled (0 if none is labelled) and own over all."""
    sums = df.groupBy(group).agg(F.count_if(own & labelled).alias("own"), F.count_if(labelled).alias("labelled"), F.count(F.lit(1)).alias("total"))
    return sums.select(group, F.when(F.col("labelled") > 0, F.col("own") / F.col("labelled")).otherwise(0.0).alias("purity"), (F.col("own") / F.col("total")).alias("coverage"))


def set_iou(df: DataFrame, a: str, item: str, least: int = 1) -> DataFrame:
    """Intersection over union of the item sets of all pairs of owners that share ``least`` items."""
    both = match.sharing_within(df, a, item, max(1, least))
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("iou"))


def contested(df: DataFrame, cell: list[str], label: str) -> DataFrame:
    """The label of each cell, or -2 where several claim it."""
    return df.groupBy(*cell).agg(F.when(F.min(label) != F.max(label), F.lit(-2)).otherwise(F.min(label)).cast("long").alias("label"))


def signed_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a closed polygon, last edge included."""
    nx, ny = (F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1)) for c in (xs, ys))
    cross = F.zip_with(F.arrays_zip(xs.alias("x"), ny.alias("y")), F.arrays_zip(nx.alias("x"), ys.alias("y")), lambda p, q: p["x"] * p["y"] - q["x"] * q["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2
