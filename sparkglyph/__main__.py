"""Command line: worksheets, fonts from filled worksheets or free pages, previews.

Exit codes: 0 done, 1 nothing could be read, 2 wrong use or missing files.
"""

from __future__ import annotations

import argparse
import glob
import importlib
import json
import os
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import layout
from .plans import handwriting as H
from .raster import kernels as K
from .sources import dump, fonts, geometry, images

DONE, UNREAD, WRONG = 0, 1, 2
TEXTS = "source string, line_index int, text string, confidence double"
SAMPLE = "abcçdefgğhıijklm noöprsştuüvyz ABCÇDEFGĞHIİJKLM NOÖPRSŞTUÜVYZ 0123456789"


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkglyph").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def found(patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Files that the patterns name, each once and in order, and the patterns that name none."""
    hits = {p: sorted(f for f in glob.glob(p) if os.path.isfile(f)) for p in patterns}
    return list(dict.fromkeys(f for files in hits.values() for f in files)), [p for p, files in hits.items() if not files]


def tell_missing(missing: Sequence[str]) -> None:
    """Each path that isn't there, with the files that are beside it."""
    for path in missing:
        beside = sorted(os.path.basename(f) for f in glob.glob(os.path.join(glob.escape(os.path.dirname(path) or "."), "*")) if os.path.isfile(f))
        print(f"not found: {path}" + (f"; there are {', '.join(beside[: dump.WEAK_SHOWN])}" if beside else ""), file=sys.stderr)


def service(name: str):
    """A reader or judge by ``module:name``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def named(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.element_at(F.split("source", "/"), -1).alias("source"))


def finish(out: dict[str, DataFrame], args: argparse.Namespace) -> int:
    unread = out["unreadable"].collect()
    for row in unread:
        print(f"{row.source}: {row.error}", file=sys.stderr)
    if out["sets"].isEmpty():
        print("no line could be read", file=sys.stderr)
        return UNREAD
    dump.save_font(out["font"], args.output)
    for row in dump.summary_lines(out["sets"], out["weak"], out["filled"]).collect():
        print(row.line)
    for row in out["resolution"].where("warning is not null").collect():
        print(row.warning, file=sys.stderr)
    if args.dump:
        dump.write({k: v for k, v in out.items() if k != "font"}, args.dump)
    if args.preview:
        draw(args.output, SAMPLE, 48, os.path.splitext(args.output)[0] + ".png")
    return DONE


def sheets(args: argparse.Namespace) -> int:
    """Lay a text out on worksheets and save their geometry."""
    if not os.path.isfile(args.text):
        tell_missing([args.text])
        return WRONG
    with open(args.text, encoding="utf-8") as file:
        lines = [line.rstrip() for line in file if line.strip()]
    spark = session()
    bands = geometry.lay_out(spark.createDataFrame(list(enumerate(lines)), "n int, text string"), "n", "text", args.dpi)
    os.makedirs(args.output, exist_ok=True)
    path = os.path.join(args.output, "sheets.json")
    with open(path, "w", encoding="utf-8") as file:
        file.write(geometry.to_json(geometry.as_sheets(bands, args.dpi)).first().value)
    print(path)
    return DONE


def build(args: argparse.Namespace) -> int:
    """A font from scans of filled worksheets, in the order of their pages."""
    photos, missing = found(args.photos)
    missing += [] if os.path.isfile(args.sheets) else [args.sheets]
    if missing:
        tell_missing(missing)
        return WRONG
    spark = session()
    pages = images.read_pages(spark, [f"file://{os.path.abspath(p)}" for p in photos])
    order = spark.createDataFrame([(os.path.basename(p), k) for k, p in enumerate(photos)], "source string, page_index int")
    of = named(pages).join(order, "source").select("page_id", "page_index")
    bands = geometry.read_sheets(spark, f"file://{os.path.abspath(args.sheets)}").select("page_index", F.explode("bands").alias("b")).join(of, "page_index")
    bands = bands.select("page_id", F.col("b.index").alias("line_index"), F.col("b.write_rect.y0").alias("y0"), F.col("b.write_rect.y1").alias("y1"), F.col("b.text").alias("text"))
    texts = bands.select("page_id", "line_index", "text", F.lit(1.0).alias("confidence"))
    return finish(H.font(pages, args.family, texts, lines_=H.lines_from_bands(pages, bands.drop("text"))), args)


def read(args: argparse.Namespace) -> int:
    """A font from photos of free pages, with texts of a file or a service that reads them."""
    photos, missing = found(args.photos)
    missing += [args.texts] if args.texts and not os.path.isfile(args.texts) else []
    if missing or not (args.texts or args.reader):
        tell_missing(missing)
        if not missing:
            print("either --texts or --reader", file=sys.stderr)
        return WRONG
    spark = session()
    pages = H.prepared(images.read_pages(spark, [f"file://{os.path.abspath(p)}" for p in photos]), paper=not args.scanned, rules=args.ruled)
    texts = None
    if args.texts:
        texts = spark.read.schema(TEXTS).json(f"file://{os.path.abspath(args.texts)}").join(named(pages), "source")
        texts = texts.select("page_id", "line_index", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
        if args.show_text:
            for row in texts.withColumn("n", F.row_number().over(Window.orderBy("page_id", "line_index"))).orderBy("n").collect():
                print(row.text)
    out = H.font(pages, args.family, texts, service(args.reader) if args.reader else None, service(args.judge) if args.judge else None)
    return finish(out, args)


def draw(font: str, text: str, size: int, path: str, most: int = 1200) -> None:
    """A PNG of the text in the font."""
    with open(font, "rb") as file:
        made = fonts.parse(file.read())
    glyphs = {}
    for code, g in made["codes"].items():
        paths = made["outlines"][g]
        x, y = ([p[i] for path_ in paths for p in path_] for i in (0, 1))
        mask = np.zeros((0, 0), bool)
        if paths:
            mask = K.filled([[(a - min(x), max(y) - b) for a, b in path_] for path_ in paths], max(y) - min(y), max(x) - min(x))
        glyphs[chr(code)] = (mask, max(y, default=0), min(x, default=0), made["advances"][g])
    with open(path, "wb") as file:
        file.write(images.encode(layout.rendered(text, glyphs, size, most)))


def preview(args: argparse.Namespace) -> int:
    if not os.path.isfile(args.font):
        tell_missing([args.font])
        return WRONG
    path = args.output or os.path.splitext(args.font)[0] + ".png"
    draw(args.font, args.text or SAMPLE, args.size, path)
    print(path)
    return DONE


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkglyph", description="Handwritten pages to fonts.")
    sub = top.add_subparsers(required=True)

    def command(run, **words) -> argparse.ArgumentParser:
        p = sub.add_parser(run.__name__, **words)
        p.set_defaults(run=run)
        return p

    p = command(sheets, help="lay out worksheets")
    p.add_argument("text", help="file with a line of text for each band")
    p.add_argument("-o", "--output", default="sheets")
    p.add_argument("--dpi", type=int, default=200)
    fonts_of = [command(build, help="font from filled worksheets"), command(read, help="font from free pages")]
    fonts_of[0].add_argument("sheets", help="the worksheets' geometry (JSON)")
    for p in fonts_of:
        p.add_argument("photos", nargs="+", help="images or patterns")
        p.add_argument("-o", "--output", default="font.ttf")
        p.add_argument("--family", default="Handwriting")
        p.add_argument("--dump", help="folder for the stages' tables")
        p.add_argument("--preview", action="store_true")
    p.add_argument("--texts", help="JSON lines of source, line_index, text, confidence")
    p.add_argument("--reader", help="module:name of a service that reads lines")
    p.add_argument("--judge", help="module:name of a service that judges glyphs")
    p.add_argument("--show-text", action="store_true")
    p.add_argument("--scanned", action="store_true", help="the image is the page, without a desk around it")
    p.add_argument("--ruled", action="store_true", help="the paper has printed lines")
    p = command(preview, help="draw a text in a font")
    p.add_argument("font")
    p.add_argument("--text")
    p.add_argument("--size", type=int, default=48)
    p.add_argument("-o", "--output")
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
