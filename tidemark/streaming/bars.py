"""Time bars over a stream of ticks (an extension; the batch operators don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_time_bars(ticks: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Bars labelled by their end, emitted once the watermark passes it; ticks later than `delay` are dropped.

    State is one row for each open bar and symbol.
    """
    at = F.window("ts", f"{minutes} minutes")
    bars = ticks.withWatermark("ts", delay).groupBy(at.alias("w"), "symbol").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume")
    )
    return bars.select("symbol", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume")
