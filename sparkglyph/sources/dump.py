"""What a run leaves for people to look at: tables of its stages, a report, a folder as one file."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most lines, glyphs and weak characters that are shown.
LINES_SHOWN, GLYPHS_SHOWN, WEAK_SHOWN = 8, 320, 10


def write(stages: dict[str, DataFrame], path: str) -> None:
    """Each stage as Parquet below ``path``, numbered in order."""
    for k, (name, df) in enumerate(stages.items()):
        df.write.mode("overwrite").parquet(f"{path}/{k:02d}-{name}")


def save_font(fonts: DataFrame, path: str, column: str = "font") -> str:
    """Write the one font file of a table to a local path, with its folders."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as out:
        out.write(bytes(fonts.select(column).first()[0]))
    return path


def zipped(folder: str) -> bytes:
    """All files of a local folder in one archive, by name."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                out.write(os.path.join(base, name), os.path.relpath(os.path.join(base, name), folder))
    return raw.getvalue()


def line_table(lines: DataFrame) -> DataFrame:
    """``line | chars | width | px/char | confidence | text`` of each line."""
    chars = F.length("text")
    shown = F.format_string("%d | %d | %d | %.1f | %.2f | %s", "line_index", chars, "w", F.col("w") / F.greatest(chars, F.lit(1)), "confidence", "text")
    return lines.select("page_id", "line_index", shown.alias("row"))


def shown(df: DataFrame, order: str, most: int = LINES_SHOWN) -> DataFrame:
    return df.orderBy(order).limit(most)


def _listed(items: Column, most: int) -> Column:
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, ", ...").otherwise(""))


def summary_lines(sets: DataFrame, weak: DataFrame, filled: DataFrame, least: int = WEAK_SHOWN) -> DataFrame:
    """Three lines of report: what was seen, what is weak, what was made."""
    seen = sets.agg(F.format_string("%d characters from %d samples, %d dropped", F.count(F.lit(1)), F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("dropped"), F.lit(0))).alias("line"))
    few = weak.agg(F.array_sort(F.collect_list("char")).alias("c")).select(F.when(F.size("c") > 0, F.concat(F.lit("few samples: "), _listed(F.col("c"), least))).otherwise("enough samples of every character").alias("line"))
    made = filled.agg(F.array_sort(F.collect_list("char")).alias("c")).select(F.concat(F.size("c").cast("string"), F.lit(" made: "), _listed(F.col("c"), least)).alias("line"))
    rows = [df.withColumn("n", F.lit(k)) for k, df in enumerate((seen, few, made))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("n", "line").orderBy("n")


def payload(report: DataFrame, warnings: DataFrame, column: str = "warning") -> DataFrame:
    """The report's lines and, apart from them, the warnings, as one JSON text."""
    lines = report.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("summary"))
    off = warnings.agg(F.array_sort(F.collect_list(column)).alias("warnings"))
    return lines.join(F.broadcast(off)).select(F.to_json(F.struct("summary", "warnings")).alias("value"))
