"""Stored mergeable sketches: one row per key, period, variable and class, merged for any window of periods.

A period's sketches are written once, beside those of the periods before, and any window is then profiled or
refitted from a few kilobytes a key: a new month costs a scan of that month alone. Classes have
sketches of their own, so that event counts come from sketches too, not only quantiles.

The sketches are Spark's own KLL sketches. A merged one answers a quantile within ``rank_error`` of the
asked rank, in any order of merging; below ``accuracy`` values it is exact. NULL and NaN are
counted as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import binning
from riskloom.operators.edges import bins_below
from riskloom.operators.prefix import clean
from riskloom.plans.staging import stage

#: a class's share below an edge is read off so many quantiles of its sketch
GRID = 4096


def rank_error(accuracy: int) -> float:
    """The rank error of one quantile at 99 % confidence, as published for this sketch."""
    return 2.296 / accuracy**0.9723  # fixed values


@dataclass(frozen=True)
class SketchTable:
    """``rows``: keys, period, variable, class, sketch, n (values in it) and missing."""

    rows: DataFrame
    keys: tuple
    period: str
    label: str
    accuracy: int = 4096


def sketch_rows(
    df: DataFrame, keys: Sequence[str], period: str, variables: Sequence[str], label: str, accuracy: int = 4096
) -> SketchTable:
    """Sketch every variable in one scan; a few kilobytes per key, period and class are shuffled."""
    by = [*keys, period, label]
    measured = {v: clean(v, df) for v in variables}
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            F.struct(
                F.kll_sketch_agg_double(x, F.lit(accuracy)).alias("sketch"), F.count(x).alias("n"),
            ).alias(v)
            for v, x in measured.items()
        ],
    )
    rows = wide.unpivot([*by, "__rows"], list(variables), "variable", "__one").select(
        *by, "variable", "__one.sketch", "__one.n", (F.col("__rows") - F.col("__one.n")).alias("missing")
    )
    return SketchTable(rows, tuple(keys), period, label, accuracy)


def store(table: SketchTable, path: str) -> str:
    """Write the periods of ``table`` beside others; a period that is there already is replaced."""
    table.rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        table.period
    ).parquet(path)
    return path


def stored(spark: SparkSession, path: str, like: SketchTable) -> SketchTable:
    """The table at ``path`` with the keys of ``like``; only the periods that are asked for are read."""
    rows = spark.read.schema(like.rows.schema).parquet(path)
    return SketchTable(rows, like.keys, like.period, like.label, like.accuracy)


def merged(table: SketchTable, window: Column | None = None, by_class: bool = False) -> DataFrame:
    """One sketch per (keys, variable), and class if asked for, over the periods of ``window``."""
    rows = table.rows if window is None else table.rows.filter(window)
    by = [*table.keys, "variable", *([table.label] if by_class else [])]
    return rows.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(table.accuracy)).alias("sketch"),
        F.sum("n").alias("n"), F.sum("missing").alias("missing"),
    )


def _at(ranks) -> Column:
    """Quantiles of the column ``sketch``; an empty sketch has none."""
    asked = F.lit(np.asarray(ranks, np.float64))
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))


def quantiles(table: SketchTable, probs: Sequence[float], window: Column | None = None) -> DataFrame:
    """keys, variable, prob, value and n, for every key of the window."""
    marks = F.lit(np.asarray(probs, np.float64))
    rows = merged(table, window).select(
        *table.keys, "variable", "n",
        F.explode(F.arrays_zip(marks.alias("prob"), F.coalesce(_at(probs), F.array().cast("array<double>")).alias("value"))),
    )
    return rows.select(*table.keys, "variable", "col.prob", "col.value", "n")


def refit(
    table: SketchTable, variables: Sequence[str], window: Column | None = None,
    limits: binning.BinningLimits = binning.BinningLimits(),
) -> binning.FittedBins:
    """Optimal bins of a window of periods from its sketches alone, without the rows.

    Prebin edges are quantiles of all classes; a class's rows below an edge are read off ``GRID``
    quantiles of its own sketch, which adds 1 / GRID to the rank error and nothing below GRID values."""
    on = [*table.keys, "variable"]
    classes = stage(merged(table, window, by_class=True))
    probs = [i / limits.prebins for i in range(1, limits.prebins)]
    whole = classes.groupBy(*on).agg(
        F.kll_merge_agg_double("sketch", F.lit(table.accuracy)).alias("sketch"), F.sum("n").alias("n")
    )
    found = F.array_sort(F.array_distinct(_at(probs)))
    edges = stage(whole.select(*on, F.coalesce(found, F.array().cast("array<double>")).alias("edges")))

    grid = F.coalesce(_at([j / GRID for j in range(1, GRID + 1)]), F.array().cast("array<double>"))
    met = binning.null_safe_join(classes.withColumn("__grid", grid), edges, on)
    below = F.transform("edges", lambda e: F.ceil(F.col("n") * bins_below(e, F.col("__grid"), F.lit(True)) / GRID))
    cumulative = F.concat(F.array(F.lit(0).cast("long")), below, F.array(F.col("n")))
    bad = (F.col(table.label) == 1).cast("long")
    placed = met.select(*on, "missing", bad.alias("bad"), cumulative.alias("upto")).select(
        *on, "missing", "bad", F.posexplode(F.expr("transform(sequence(1, size(upto) - 1), i -> upto[i] - upto[i - 1])"))
    )
    filled = placed.filter("col > 0").groupBy(*on, F.col("pos").alias("prebin"))
    counts = filled.agg(F.sum("col").alias("n"), F.sum(F.col("col") * F.col("bad")).alias("events"))
    empty = classes.filter("missing > 0").groupBy(*on, F.lit(None).cast("int").alias("prebin")).agg(
        F.sum("missing").alias("n"), F.sum(F.col("missing") * bad).alias("events")
    )
    return binning.fit_from_counts(stage(counts.unionByName(empty)), edges, table.keys, variables, limits)
