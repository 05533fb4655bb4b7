"""The relational aggregates over an unbounded table, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_aggregate(stream: DataFrame, time: str, width: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    """Aggregates per time window; the watermark bounds the state. A time without a zone is read in the session's."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggs)
