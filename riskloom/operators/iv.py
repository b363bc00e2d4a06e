"""Information value of columns that are already binned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.cuts import woe_of
from riskloom.operators.binning import bin_statistics


def category_counts(
    df: DataFrame, variables: list[str], label: str = "y", keys: list[str] = ()
) -> DataFrame:
    """Goods and bads per (keys, variable, bin) from one partial aggregation."""
    flat = df.select(
        *keys, F.col(label).alias("__y"), *[F.col(v).cast("string").alias(v) for v in variables]
    ).unpivot([*keys, "__y"], variables, "variable", "bin")
    return flat.groupBy(*keys, "variable", "bin").agg(
        F.count_if(F.col("__y") == 0).alias("count_0"),
        F.count_if(F.col("__y") == 1).alias("count_1"),
    )


def calc_iv_bins(
    df: DataFrame, variables: list[str], label: str = "y", keys: list[str] = ()
) -> DataFrame:
    """WOE and IV per bin.

    Bins without goods are absent; bins without bads and the NULL bin have no bad count,
    WOE or IV, while all of them count in the totals.
    """
    on = [*keys, "variable"]
    counts = category_counts(df, variables, label, keys)
    totals = counts.groupBy(*on).agg(
        F.sum("count_0").alias("total_0"), F.sum("count_1").alias("total_1")
    )
    matched = F.when((F.col("count_1") > 0) & F.col("bin").isNotNull(), F.col("count_1"))
    good = F.try_divide(F.col("count_0"), F.col("total_0"))
    bad = F.try_divide(F.col("count_1"), F.col("total_1"))
    return (
        counts.join(totals, on)
        .withColumn("count_1", matched)
        .withColumns({"woe": woe_of(good, bad), "iv": (good - bad) * woe_of(good, bad)})
        .filter("count_0 > 0")
        .drop("total_0", "total_1")
    )


def calc_iv(
    df: DataFrame, variables: list[str], label: str = "y", keys: list[str] = ()
) -> DataFrame:
    """Total IV per variable over :func:`calc_iv_bins`."""
    bins = calc_iv_bins(df, variables, label, keys)
    return bins.groupBy(*keys, "variable").agg(F.sum("iv").alias("iv"))


def bin_table(
    df: DataFrame, variables: list[str], label: str = "y", keys: list[str] = ()
) -> DataFrame:
    """Bin table of hand-cut bins: counts, event rate, WOE, IV; a NULL bin is "Missing"."""
    counts = category_counts(df, variables, label, keys)
    bins = counts.select(
        *keys, "variable", F.coalesce("bin", F.lit("Missing")).alias("bin"),
        (F.col("count_0") + F.col("count_1")).alias("n"), F.col("count_1").alias("events"),
    )
    return bin_statistics(bins, [*keys, "variable"])
