"""Streaming forms of the time windows: hop windows and rates with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hop_stream(df: DataFrame, keys: list[str], agg: Callable[[str], Column], size: str, step: str, late: str = "10 minutes", ts: str = "ts", val: str = "val") -> DataFrame:
    """keys, start, end, out; rows later than ``late`` are left out."""
    g = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, step).alias("w")).agg(agg(val).alias("out"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "out")


def rate_stream(df: DataFrame, keys: list[str], size: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Detections per minute between the first and last one of each tumbling window."""
    g = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    seconds = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6
    return g.select(*keys, F.col("w.start").alias("start"), F.try_divide(60.0 * (F.col("n") - 1), seconds).alias("rate"))
