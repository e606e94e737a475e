"""Column functions on whole texts, and the hash that sets rows aside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import bytesops as B


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id gives 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores until no column of the table has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _count_words(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), np.int64)
    for a, b in B.slices(texts):
        data, offsets = B.closed(texts.slice(a, b - a))
        separates = B.SEPARATOR[data]
        ends = separates.copy()
        ends[1:] &= ~separates[:-1]
        ends[0] = False
        out[a:b] = B.per_document(ends, offsets)
    return pa.array(out)


def count_words(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; a null has none."""

    @arrow_udf("bigint")
    def words(texts: pa.Array) -> pa.Array:
        return _count_words(texts)

    return words(text)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
