"""The target characters, their vertical classes and width priors, as tables and expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that a font must have, in order.
CHARSET = "abcçdefgğhıijklmnoöprsştuüvyz" "qwx" "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ" "QWX" "0123456789" ".,;:!?'\"()-%"
#: Letters by where they stand on the line.
ASCENDER, DESCENDER, XHEIGHT = "bdfhklt", "gğjpqyçş", "acemnoörsuüvwxzıi"
#: Widths against the mean lower-case letter.
WIDTHS = {
    "i": 0.34, "ı": 0.34, "l": 0.34, "j": 0.40, "t": 0.52, "f": 0.50, "r": 0.56, "İ": 0.40, "I": 0.36, "1": 0.50, "!": 0.30,
    "'": 0.24, '"': 0.40, ".": 0.30, ",": 0.30, ";": 0.30, ":": 0.30, "-": 0.45, "(": 0.38, ")": 0.38, "?": 0.62, "m": 1.55,
    "w": 1.40, "M": 1.60, "W": 1.60, "s": 0.72, "z": 0.76, "c": 0.78, "ç": 0.78, "e": 0.84, "v": 0.82, "x": 0.80, "y": 0.82, "ş": 0.72,
}
UPPER_WIDTH, OTHER_WIDTH = 1.15, 1.0
#: Bounds on height and descent, in x-heights, of a plausible sample of each class.
PLAUSIBLE = {"xheight": (0.55, 1.60, 0.30), "ascender": (1.00, 2.20, 0.30), "descender": (0.60, 2.20, 1.20), "other": (0.10, 2.60, 1.30)}


def charset(spark: SparkSession) -> DataFrame:
    """``char``, ``ord`` (place in the set), ``class`` and ``width`` of every target character."""
    base = spark.createDataFrame([(c, i) for i, c in enumerate(CHARSET)], "char string, ord int")
    return base.withColumns({"class": vertical_class(F.col("char")), "width": width_prior(F.col("char"))})


def _one_of(char: Column, letters: str) -> Column:
    return char.isin(*letters)


def vertical_class(char: Column) -> Column:
    """ascender, descender, xheight or other; the first list that has the character wins."""
    return (
        F.when(_one_of(char, ASCENDER), "ascender")
        .when(_one_of(char, DESCENDER), "descender")
        .when(_one_of(char, XHEIGHT), "xheight")
        .when(char.rlike(r"^[\p{Lu}\p{Nd}]$"), "ascender")
        .otherwise("other")
    )


def width_prior(char: Column) -> Column:
    """Width against the mean lower-case letter: the table, else by case."""
    table = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, char), F.when(char.rlike(r"^\p{Lu}$"), UPPER_WIDTH).otherwise(OTHER_WIDTH))


def measured_width(char: Column, measured: Column) -> Column:
    """A measured width where there is one, else the prior."""
    return F.coalesce(measured, width_prior(char))


def characters(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row for each character of every text."""
    return texts.select(F.explode(F.split(text, "")).alias("char")).where("char <> ''")


def coverage(texts: DataFrame, text: str = "text") -> DataFrame:
    """How often each target character occurs, with zeros for those that don't."""
    dim = charset(texts.sparkSession)
    # counts come out of the map side by character, so only the alphabet is shuffled
    counts = characters(texts, text).groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "char", "left").select("char", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def missing(texts: DataFrame, least: int, text: str = "text") -> DataFrame:
    """Target characters that occur fewer than ``least`` times."""
    return coverage(texts, text).where(F.col("n") < least)


#: Names of accents, of other letters, of digits and of signs in the public list of glyph names.
ACCENTS = {
    "ACUTE": "acute", "BREVE": "breve", "CARON": "caron", "CEDILLA": "cedilla", "CIRCUMFLEX": "circumflex", "DIAERESIS": "dieresis", "DOT ABOVE": "dotaccent",
    "DOUBLE ACUTE": "hungarumlaut", "GRAVE": "grave", "MACRON": "macron", "OGONEK": "ogonek", "RING ABOVE": "ring", "TILDE": "tilde",
}
OTHER_NAMES = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine",
    " ": "space", "!": "exclam", '"': "quotedbl", "%": "percent", "'": "quotesingle", "(": "parenleft", ")": "parenright", ",": "comma", "-": "hyphen",
    ".": "period", ":": "colon", ";": "semicolon", "?": "question", "ı": "dotlessi", "ß": "germandbls", "æ": "ae", "Æ": "AE", "ø": "oslash", "Ø": "Oslash",
}
#: Letters whose cedilla is named as a comma instead.
COMMAS = "GKLNRT"


def _glyph_names() -> dict[str, str]:
    found = dict(OTHER_NAMES)
    for code in range(0xC0, 0x180):
        m = re.match(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (.+)$", unicodedata.name(chr(code), ""))
        if m and m[3] in ACCENTS and not (m[3] == "CEDILLA" and m[2] in COMMAS):
            found[chr(code)] = (m[2] if m[1] == "CAPITAL" else m[2].lower()) + ACCENTS[m[3]]
    return found


#: Names of characters other than plain letters.
GLYPH_NAMES = _glyph_names()


def name_of(char: str) -> str:
    """A letter's own name, the public name of accented letters, digits and signs, else ``uniXXXX``."""
    return char if char.isascii() and char.isalpha() else GLYPH_NAMES.get(char, f"uni{ord(char):04X}")


def glyph_name(char: Column) -> Column:
    """:func:`name_of` as an expression."""
    code = F.hex(F.ascii(char))
    padded = F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code)
    table = F.create_map(*[F.lit(x) for kv in GLYPH_NAMES.items() for x in kv])
    return F.when(char.rlike("^[A-Za-z]$"), char).otherwise(F.coalesce(F.try_element_at(table, char), F.concat(F.lit("uni"), padded)))


def variant_name(name: Column, index: Column) -> Column:
    return F.when(index == 0, name).otherwise(F.concat(name, F.lit(".alt"), index.cast("string")))
