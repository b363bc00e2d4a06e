"""Cumulative sums over very large ordered groups without a one-task window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.plans.staging import stage


def value_cells(
    df: DataFrame, keys: list[str], columns: list[str], sums: dict | None = None,
    variable: str = "variable", value: str = "value",
) -> DataFrame:
    """Distinct values per key and variable with their row count and optional sums; the
    NULLs of a variable form one cell.

    Equal values are merged on the map side, so a value that fills a third of the
    table is one small row per map task by the time it is shuffled.
    """
    sums = sums or {}
    names = ["n", *sums]
    carried = [F.lit(1).cast("long"), *sums.values()]
    flat = df.select(
        *keys,
        *[c.alias(f"__{name}") for name, c in zip(names, carried)],
        *[clean(c, df).alias(c) for c in columns],
    ).unpivot([*keys, *[f"__{name}" for name in names]], columns, variable, value)
    return flat.groupBy(*keys, variable, value).agg(
        *[F.sum(f"__{name}").alias(name) for name in names]
    )


def clean(column: str, df: DataFrame):
    """The column as double with NaN as NULL, so that NaN never counts as a large value."""
    as_double = F.col(column).cast("double")
    if df.schema[column].dataType.typeName() in ("double", "float"):
        return F.when(~F.isnan(as_double), as_double)
    return as_double


def running_totals(
    cells: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str],
    bounded: bool = False,
) -> DataFrame:
    """Add ``<sum>_upto`` (inclusive) and ``<sum>_total`` per key in ascending ``order``,
    and ``<order>_next``, the key's next value or NULL.

    ``(keys, order)`` must be unique; a NULL key is a key like others.  Rows are range-partitioned
    by (keys, order) and written once; each slice is summed on its own and the small
    table of slice totals supplies the offset.  No key is ever gathered in one task.
    ``bounded`` says that every key has few rows by construction, where the plain
    window is the better plan.
    """
    if bounded:
        ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        whole = Window.partitionBy(*keys)
        return cells.withColumns(
            {
                **{f"{s}_upto": F.sum(s).over(ahead) for s in sums},
                **{f"{s}_total": F.sum(s).over(whole) for s in sums},
                f"{order}_next": F.lead(order).over(Window.partitionBy(*keys).orderBy(order)),
            }
        )

    sliced = stage(
        cells.repartitionByRange(*keys, order).withColumn("__slice", F.spark_partition_id())
    )
    slices = sliced.groupBy(*keys, "__slice").agg(
        *[F.sum(s).alias(f"__{s}") for s in sums], F.min(order).alias("__first")
    )
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = slices.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__slice").alias("__of"),
        *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}_before") for s in sums],
        *[F.sum(f"__{s}").over(whole).alias(f"{s}_total") for s in sums],
        F.lead("__first").over(Window.partitionBy(*keys).orderBy("__slice")).alias("__after"),
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    step = Window.partitionBy(*keys, "__slice").orderBy(order)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return (
        sliced.join(offsets, reduce(and_, same, F.col("__slice") == F.col("__of")))
        .withColumns(
            {
                **{f"{s}_upto": F.col(f"__{s}_before") + F.sum(s).over(inside) for s in sums},
                f"{order}_next": F.coalesce(F.lead(order).over(step), F.col("__after")),
            }
        )
        .drop("__slice", "__of", "__after", *[f"__{k}" for k in keys], *[f"__{s}_before" for s in sums])
    )
