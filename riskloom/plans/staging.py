"""Staging of intermediate results and size-checked broadcasts.

Staged data lie in the folder named by ``spark.checkpoint.dir``, which every executor can reach.
Where that is unset on one machine, a folder of the session's own below ``spark.sql.warehouse.dir`` takes its
place and is deleted when the session's JVM ends; on a cluster that is an error. With
``spark.cleaner.referenceTracking.cleanCheckpoints=true`` Spark removes each staged result as soon
as nothing refers to it any more.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: most bytes of one side that is broadcast
BROADCAST_BYTES = 16 << 20
_WIDTH = {"string": 64, "binary": 64, "decimal": 16}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged data; see above."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    _delete_at_end(spark, own)
    return own


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that later uses neither recompute it
    nor see another row order, and lost executors can read it back."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Stage ``df`` and return its row count, observed while it is written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return staged, seen.get["rows"]


def row_width(kind: T.DataType, items: int = 32) -> int:
    """Bytes of a row of this type, roughly; arrays are taken to hold ``items``."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_width(f.dataType, items) for f in kind)
    if isinstance(kind, T.ArrayType):
        return 16 + items * row_width(kind.elementType, items)
    return _WIDTH.get(kind.typeName(), 8)


def fits_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` rows of ``df`` take at most ``most`` bytes."""
    return rows * row_width(df.schema) <= most


def broadcast_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Stage one side of a join and hint its broadcast if it turned out small; a larger one
    is left to the optimizer."""
    staged, count = stage_counted(df)
    return F.broadcast(staged) if fits_broadcast(staged, count, most) else staged


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with all it holds when the session's JVM ends."""
    parent = f"{shared_dir(spark).rstrip('/')}/fresh-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(parent)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    _delete_at_end(spark, parent)  # of what is there already
    return f"{parent}/{name}-{uuid.uuid4().hex}"
