"""Quantiles of many columns per key: sketched in one pass, or exact at any size."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import clean, running_totals, value_cells


def _rank(prob: float, total: str) -> Column:
    """ceil(prob * total), at least 1, in whole numbers."""
    share = Fraction(str(prob))
    up = share.denominator - 1
    return F.greatest(
        F.lit(1).cast("long"),
        F.expr(f"(`{total}` * {share.numerator}L + {up}L) div {share.denominator}L"),
    )


def accuracy_of(rel_error: float) -> int:
    return max(1, round(1 / rel_error))


def quantile_rows(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float],
    rel_error: float = 0.001, cells: DataFrame | None = None,
) -> DataFrame:
    """One row per (keys, variable) with an array ``q`` aligned to ``probs``.

    ``rel_error`` > 0 uses the mergeable sketch behind ``percentile_approx``: one scan,
    a few kilobytes shuffled.  ``rel_error`` = 0 is exact: distinct values are counted
    and ranked with range-partitioned running totals.  NULL and NaN are left out; a
    column without any value keeps its row, without numbers.
    """
    if rel_error > 0:
        marks = F.array(*[F.lit(float(p)) for p in probs])
        accuracy = F.lit(accuracy_of(rel_error))
        wide = df.groupBy(*keys).agg(
            *[F.percentile_approx(clean(c, df), marks, accuracy).alias(c) for c in columns]
        )
        return wide.unpivot(list(keys), columns, "variable", "q")

    if cells is None:
        cells = value_cells(df, keys, columns)
    # the NULL cell weighs nothing, but keeps a column that has no other
    seen = cells.withColumn("n", F.when(F.col("value").isNull(), 0).otherwise(F.col("n")))
    ranked = running_totals(seen, [*keys, "variable"], "value", ["n"])
    picks = [
        F.min(F.when(F.col("n_upto") >= _rank(p, "n_total"), F.col("value"))) for p in probs
    ]
    return ranked.groupBy(*keys, "variable").agg(F.array(*picks).alias("q"))


def quantiles(df, keys, columns, probs, rel_error: float = 0.001) -> DataFrame:
    """Long form: keys, variable, prob, value."""
    rows = quantile_rows(df, keys, columns, probs, rel_error)
    marks = F.array(*[F.lit(float(p)) for p in probs])
    return rows.select(
        *keys, "variable", F.explode(F.arrays_zip(marks.alias("prob"), F.col("q").alias("value")))
    ).select(*keys, "variable", "col.prob", "col.value")
