"""Profiles and WOE on a stream: both are stateless column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.profiles import profile_all
from riskloom.settings import PROFILE_RUNS


def profile_stream(stream: DataFrame, runs=PROFILE_RUNS) -> DataFrame:
    """The batch profiling, unchanged, on a streaming DataFrame; it keeps no state."""
    return profile_all(stream, runs)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available to parquet, exactly once per ``checkpoint`` folder."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
