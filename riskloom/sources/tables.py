"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Batch scan of one path; pass ``fmt="delta"`` where the session has that format."""
    return spark.read.format(fmt).options(**options).load(path)


def read_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def local_rows(spark: SparkSession, rows: Iterable, schema: StructType | str) -> DataFrame:
    """A few driver-side rows (parameters, model lists) as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """Distributed CSV export with a header and no index column; one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def preview(df: DataFrame, *order: Column | str, rows: int = 50) -> DataFrame:
    """The first rows in a given order, as a DataFrame rather than as printed text."""
    return df.orderBy(*order).limit(rows) if order else df.limit(rows)
