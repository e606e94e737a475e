"""Intermediate tables in the folder that all nodes share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (read from the
session), so a lost executor costs a re-read and never a recomputation.  Only
in a local session without the setting, as in tests, a temporary folder is used; on a
cluster its absence is an error, since no folder of one machine would do.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one of our own if there is none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        path = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="sparkglyph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    _MADE[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path and _MADE.pop(path, None):
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already; the folder's owner cleans up
            break
