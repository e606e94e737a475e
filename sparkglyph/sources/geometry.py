"""Worksheet geometry: pages with markers and writing bands, as rows and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "struct<x0:int,y0:int,x1:int,y1:int>"
BAND = f"struct<index:int,text:string,ref_rect:{RECT},write_rect:{RECT},ascender_y:int,xheight_y:int,baseline_y:int,descender_y:int>"
FIELDS = f"page_index:int,width:int,height:int,dpi:int,marker_ids:array<int>,marker_corners:array<array<array<double>>>,bands:array<{BAND}>"
#: An A4 page in millimetres, markers on each page, most pages of a set.
PAGE_MM, MARKERS, MOST_PAGES = (210.0, 297.0), 4, 12


def mm_to_px(mm: Column | float, dpi: int) -> Column:
    return (F.lit(mm) if isinstance(mm, int | float) else mm) * dpi / 25.4


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of the sheet sets in JSON files."""
    files = spark.read.schema(f"sheets array<struct<{FIELDS}>>").option("multiLine", True).json(path)
    return files.select(F.explode("sheets").alias("s")).select("s.*")


def to_json(sheets: DataFrame) -> DataFrame:
    """All sheets of a set as one JSON text; a set has MOST_PAGES pages at most."""
    return sheets.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*sheets.columns))).alias("sheets"))).alias("value"))


def lay_out(lines: DataFrame, number: str, text: str, dpi: int = 200, per_page: int = 10, xheight_mm: float = 5.0, pitch_mm: float = 24.0, margin_mm: float = 20.0) -> DataFrame:
    """Bands of a worksheet for numbered lines of text, ``per_page`` to a page."""
    px = lambda mm: round(mm * dpi / 25.4)
    w, h = (px(x) for x in PAGE_MM)
    place = F.col("band")
    base = (F.lit(px(margin_mm + pitch_mm * 0.75)) + place * px(pitch_mm)).cast("int")
    x = px(xheight_mm)
    rows = lines.select((F.floor(F.col(number) / per_page)).cast("int").alias("page_index"), (F.col(number) % per_page).cast("int").alias("band"), F.col(text).alias("text"))
    return rows.select(
        "page_index", "band", "text", F.lit(w).alias("width"), F.lit(h).alias("height"),
        F.struct(F.lit(px(margin_mm)).alias("x0"), (base - 2 * x).alias("y0"), F.lit(w - px(margin_mm)).alias("x1"), (base + x).alias("y1")).alias("write_rect"),
        (base - 2 * x).alias("ascender_y"), (base - x).alias("xheight_y"), base.alias("baseline_y"), (base + x).alias("descender_y"),
        F.transform(F.sequence(F.lit(0), F.lit(MARKERS - 1)), lambda k: F.col("page_index") * MARKERS + k).alias("marker_ids"),
    )


def as_sheets(bands: DataFrame, dpi: int = 200) -> DataFrame:
    """Bands of :func:`lay_out` as one row for each page, as :func:`read_sheets` gives it; corners are not known before printing."""
    rect = F.col("write_rect").cast(RECT)
    band = F.struct(F.col("band").alias("index"), "text", F.lit(None).cast(RECT).alias("ref_rect"), rect.alias("write_rect"), "ascender_y", "xheight_y", "baseline_y", "descender_y")
    pages = bands.groupBy("page_index", "width", "height", "marker_ids").agg(F.sort_array(F.collect_list(band)).alias("bands"))
    return pages.select("page_index", "width", "height", F.lit(dpi).alias("dpi"), "marker_ids", F.lit(None).cast("array<array<array<double>>>").alias("marker_corners"), "bands")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file without trailing blanks, empty ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("text")).where("text <> ''")
