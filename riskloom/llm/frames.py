"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as strings, a null as an empty one."""
    return ["" if x is None else x for x in rows_of(batch, name)]


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema):
    """A function for ``mapInArrow`` from ``make()``, which is called once in a task and
    returns what turns a batch into the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(columns(batch), schema=schema)

    return run


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(name: str):
    """A column by its plain name, which may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")
