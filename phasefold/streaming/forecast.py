"""An addition: a stream of measurements on a regular grid, forecast against a static library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, moment: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(t, v): sums by tumbling window, final once the watermark has passed."""
    return stream.withWatermark(moment, late).groupBy(F.window(moment, width).alias("w")).agg(F.round(F.sum(value), 4).alias("v")).select(F.col("w.start").alias("t"), "v")


def forecast_each(windows: DataFrame, predict: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch's forecasts to ``sink``."""
    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(predict(df), n)).start()
