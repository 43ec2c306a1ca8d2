"""Element-wise operators over keyed signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.expr import div0


def normalize(df: DataFrame, keys: list[str], val: str = "val", out: str = "out") -> DataFrame:
    return df.withColumn(out, F.col(val) - F.avg(val).over(W.partitionBy(*keys)))


def scale(df: DataFrame, keys: list[str], val: str = "val", out: str = "out") -> DataFrame:
    """x / std without centring; 0 if std is 0."""
    return df.withColumn(out, div0(F.col(val), F.stddev_pop(val).over(W.partitionBy(*keys)), 0.0))


def standardize(df: DataFrame, keys: list[str], val: str = "val", out: str = "out") -> DataFrame:
    """(x - mean) / std with population deviation; 0 if std is 0."""
    w = W.partitionBy(*keys)
    return df.withColumn(out, div0(F.col(val) - F.avg(val).over(w), F.stddev_pop(val).over(w), 0.0))


def diff(df: DataFrame, keys: list[str], order: str = "i", val: str = "val", out: str = "out") -> DataFrame:
    """First differences; the first sample of each signal goes."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(val) - F.lag(val).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def standardize_images(df: DataFrame, keys: list[str], val: str = "p", out: str = "out") -> DataFrame:
    """(x - mean) / max(std, 1 / sqrt(pixels))."""
    w = W.partitionBy(*keys)
    sd = F.greatest(F.stddev_pop(val).over(w), 1 / F.sqrt(F.count(F.lit(1)).over(w).cast("double")))
    return df.withColumn(out, (F.col(val) - F.avg(val).over(w)) / sd)


def image_diff(df: DataFrame, pixel: list[str], order: str = "frame", val: str = "v", out: str = "out") -> DataFrame:
    """(b - a) / clip(a + b, 1e-7, 2) of adjacent frames."""
    prev = F.lag(val).over(W.partitionBy(*pixel).orderBy(order))
    total = F.least(F.greatest(F.col(val) + prev, F.lit(1e-7)), F.lit(2.0))
    return df.withColumn(out, (F.col(val) - prev) / total).where(F.col(out).isNotNull())


def display_scale(df: DataFrame, keys: list[str], val: str = "p", out: str = "out") -> DataFrame:
    """Range of each image to [0, 1]; NaN on a flat image."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(val).over(w), F.max(val).over(w)
    return df.withColumn(out, div0(F.col(val) - lo, hi - lo))


def linear_combination(x: Column, v1: Column, v2: Column) -> dict[str, Column]:
    """(1 - x) v1 + x v2 with its gradients; the gradient by x is 0 where it isn't finite."""
    return {"out": (1 - x) * v1 + x * v2, "dx": div0(v2 - v1, F.lit(1.0), 0.0), "dv1": 1 - x, "dv2": x}
