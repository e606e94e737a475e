"""How characters that no page has are made from those that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match
from .charset import charset

#: Fixed values: (character, base, donor of the mark); a character that would be made of itself is no recipe.
COMPOSITION = (
    ("Ç", "C", "ç"), ("Ğ", "G", "ğ"), ("İ", "I", "i"), ("Ö", "O", "ö"), ("Ü", "U", "ü"), ("Ş", "S", "ş"),
    ("ç", "c", "ş"), ("ş", "s", "ç"), ("ö", "o", "ü"), ("ü", "u", "ö"), ("ğ", "g", "ö"),
)
#: Capitals that are their small letter made larger.
CASE_COMPATIBLE = (("C", "c"), ("O", "o"), ("S", "s"), ("U", "u"), ("V", "v"), ("W", "w"), ("X", "x"), ("Z", "z"), ("K", "k"), ("P", "p"), ("Y", "y"), ("I", "ı"), ("Ç", "ç"), ("Ö", "ö"), ("Ü", "ü"), ("Ş", "ş"))


def fill_plan(spark: SparkSession, present: DataFrame, char: str = "char", rounds: int = 2) -> DataFrame:
    """Every missing target character with its ``tier`` and parts: composed, transferred, referenced.

    A composed character may be the donor of another, so composing is repeated ``rounds`` times;
    both tables hold one row for each character of the alphabet.
    """
    own = present.select(F.col(char).alias("char")).distinct()
    target = charset(spark)
    recipes = spark.createDataFrame(COMPOSITION, "char string, base string, donor string")
    made = None
    for _ in range(rounds):
        have = own if made is None else own.unionByName(made.select("char"))
        new = match.composable(match.absent(recipes, have, "char"), have, "base", "donor", "char")
        made = new if made is None else made.unionByName(new)
    cases = spark.createDataFrame(CASE_COMPATIBLE, "char string, base string")
    have = own.unionByName(made.select("char"))
    moved = match.absent(cases, have, "char").join(own.withColumnRenamed("char", "base"), "base", "left_semi")
    missing = match.absent(target, own, "char").select("char", "ord")
    rows = missing.join(made.select("char", F.col("base").alias("c_base"), "donor"), "char", "left").join(moved.select("char", F.col("base").alias("t_base")), "char", "left")
    return match.first_tier(rows, composed=F.col("c_base"), transferred=F.col("t_base"), referenced=F.col("char")).select("char", "ord", "tier", F.col("value").alias("base"), F.when(F.col("tier") == "composed", F.col("donor")).alias("donor"))
