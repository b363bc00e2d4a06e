"""Host entry point of the rule profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.profiles import profile_all


def transform(spark: SparkSession, df: DataFrame, params: dict | None = None) -> DataFrame:
    """Add the four profile columns to a frame handed in by a host platform.

    ``params`` may carry ``profile_runs`` to replace the configured columns and rules.
    """
    runs = (params or {}).get("profile_runs")
    return profile_all(df, runs) if runs else profile_all(df)
