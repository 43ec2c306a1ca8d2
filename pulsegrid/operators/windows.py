"""Hop, trailing and time windows over keyed signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators.kernel import per_row


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))


def window_view(df: DataFrame, keys: list[str], size: int, overlap: int, least: int | None = None) -> DataFrame:
    """Rows repeated for each hop window ``win`` that holds them; ``_n`` is the signal's length.

    Windows start at ``least - size`` (as if padded in front) and the last one may
    reach beyond the end. A window that isn't complete has fewer than ``size`` rows.
    """
    step, pad = size - overlap, size - (least or size)
    d = _counted(df, keys)
    windows = F.floor((F.greatest(F.col("_n") + pad - size, F.lit(0)) + step - 1) / step)
    at = F.col("i") + pad
    first = F.greatest(F.floor((at - size) / step) + 1, F.lit(0))
    last = F.least(F.floor(at / step), windows)
    return d.where(first <= last).withColumn("win", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def hop(df: DataFrame, keys: list[str], size: int, overlap: int, agg: Callable[[str], Column], val: str = "val") -> DataFrame:
    """One value per hop window: keys, win, v (NULL if the window isn't complete)."""
    w = window_view(df.select(*keys, "i", val), keys, size, overlap)
    return w.groupBy(*keys, "win").agg(F.when(F.count("*") == size, agg(val)).alias("v"))


def _covering_mean(d: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ``v`` over the windows that cover a sample. Exact zeros don't count; one NULL window makes its samples NULL."""
    mean = F.sum("v") / F.greatest(F.count_if(F.col("v") != 0), F.lit(1))
    return d.groupBy(*keys, "i").agg(F.when(F.count_if(F.col("v").isNull()) == 0, mean).alias("out"))


def resolve_hop(values: DataFrame, samples: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """keys, i, out from a value per window, for windows that were computed elsewhere."""
    return _covering_mean(window_view(samples.select(*keys, "i"), keys, size, overlap).join(values, [*keys, "win"]), keys)


def rolling(df: DataFrame, keys: list[str], size: int, agg: Callable[[str], Column], overlap: int | None = None, fill: str = "pad", least: int | None = None, val: str = "val") -> DataFrame:
    """keys, i, out: a value per sample from windows of ``size``.

    overlap = size - 1 is a trailing frame whose first samples (fewer than
    ``least``) are NULL, or filled with the ``start`` value or the ``mean`` of all
    values; overlap = 0 repeats each window's value; else windows are averaged.
    """
    overlap = size - 1 if overlap is None else overlap
    if overlap == size - 1:
        frame = W.partitionBy(*keys).orderBy("i").rowsBetween(-(size - 1), 0)
        out = F.when(F.count(F.lit(1)).over(frame) >= (least or size), agg(val).over(frame))
        d = df.select(*keys, "i", out.alias("out"))
        if fill == "start":
            d = d.withColumn("out", F.coalesce("out", F.first("out", True).over(W.partitionBy(*keys).orderBy("i").rowsBetween(0, W.unboundedFollowing))))
        elif fill == "mean":
            d = d.withColumn("out", F.coalesce("out", F.avg("out").over(W.partitionBy(*keys))))
        return d
    if overlap == 0:
        w = df.select(*keys, "i", val).withColumn("win", F.expr(f"i div {size}"))
        g = W.partitionBy(*keys, "win")
        return w.select(*keys, "i", F.when(F.count(F.lit(1)).over(g) == size, agg(val).over(g)).alias("out"))
    # each sample is repeated once for the windows that hold it; a window's value stands on all of its rows
    g = W.partitionBy(*keys, "win")
    w = window_view(df.select(*keys, "i", val), keys, size, overlap)
    return _covering_mean(w.withColumn("v", F.when(F.count(F.lit(1)).over(g) == size, agg(val).over(g))), keys)


def moving_average(df: DataFrame, keys: list[str], size: int, center: bool = True, val: str = "val") -> DataFrame:
    """Box mean that skips NaN and NULL, edges mirrored with the edge sample repeated: keys, i, out."""
    if not center and size % 2 == 0:
        raise ValueError("a trailing average needs an odd size")
    d = _counted(df.select(*keys, "i", F.nanvl(F.col(val), F.lit(None).cast("double")).alias("v")), keys)
    at = F.array(F.col("i"), F.when(F.col("i") < size, -1 - F.col("i")), F.when(F.col("i") >= F.col("_n") - size, 2 * F.col("_n") - 1 - F.col("i")))
    m = d.select(*keys, "_n", "v", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("i"))
    lo, hi = (-(size // 2), size - 1 - size // 2) if center else (-(size - 1), 0)
    out = F.avg("v").over(W.partitionBy(*keys).orderBy("i").rangeBetween(lo, hi))
    return m.withColumn("out", out).where("i >= 0 AND i < _n").select(*keys, "i", "out")


def windowed_standardize(df: DataFrame, keys: list[str], size: int, mean: bool = True, std: bool = True, val: str = "val") -> DataFrame:
    """(x - mean) / deviation of x, each moving or over the whole signal: keys, i, out."""
    d = df.select(*keys, "i", F.col(val).alias("val"))
    whole = W.partitionBy(*keys)
    if mean:
        d = d.join(moving_average(d, keys, size).withColumnRenamed("out", "m"), [*keys, "i"])
    else:
        d = d.withColumn("m", F.avg("val").over(whole))
    if std:
        d = d.join(rolling(d, keys, size, F.stddev_pop, fill="mean").withColumnRenamed("out", "s"), [*keys, "i"])
    else:
        d = d.withColumn("s", F.stddev_pop("val").over(whole))
    return d.select(*keys, "i", F.try_divide(F.col("val") - F.col("m"), F.col("s")).alias("out"))


def rolling_seconds(df: DataFrame, keys: list[str], agg: Callable[[str], Column], most: float, least: float = 0.0, origin: int | None = None, val: str = "val") -> DataFrame:
    """Aggregate over (t - most, t], t in microseconds ``us``: keys, us, out.

    NULL where the time since ``origin`` (default: the signal's start) is below ``least``.
    """
    frame = W.partitionBy(*keys).orderBy("us").rangeBetween(-(int(round(most * 1e6)) - 1), 0)
    start = F.lit(origin) if origin is not None else F.min("us").over(W.partitionBy(*keys))
    return df.select(*[c for c in df.columns if c != "out"], F.when(F.col("us") - start >= int(round(least * 1e6)), agg(val).over(frame)).alias("out"))


def rolling_apply(df: DataFrame, keys: list[str], fn: Callable, least: int, most: int, overlap: int | None = None, transform: Callable | None = None, fill: str = "pad", pad: float = float("nan"), val: str = "val") -> DataFrame:
    """keys, i, out: any function of a window's values, for what aggregate expressions can't say.

    ``transform`` changes a window before ``fn`` and must keep its length; ``fill`` is pad, mean or start.
    """

    def checked(w):
        out = transform(w)
        if len(out) != len(w):
            raise ValueError("transform must keep the window's length")
        return out

    d = per_row(df, keys, ["i", val], lambda i, x: kernels.rolling_count(x, fn, least, most, overlap, checked if transform else None, fill, pad))
    return d.select(*keys, F.col("i").cast("long").alias("i"), "out")


def rolling_apply_seconds(df: DataFrame, keys: list[str], fn: Callable, least: float, most: float, time: str = "t", pad: float = float("nan")) -> DataFrame:
    """keys, ``time``, out: any function of the times in (t - most, t]."""
    return per_row(df, keys, [time], lambda t: kernels.rolling_span(t, fn, least, most, pad), time)
