"""Filling, repairing and resampling signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators.kernel import gather, per_signal, spread


def fill(df: DataFrame, keys: list[str], bad: Column | None = None, val: str = "val", out: str = "out", order: str = "i") -> DataFrame:
    """Linear interpolation of flagged (default: NULL or NaN) values by position; edges take the nearest; all flagged stays."""
    bad = F.col(val).isNull() | F.isnan(val) if bad is None else bad
    w = W.partitionBy(*keys).orderBy(order)
    good = F.when(~bad, F.struct(F.col(order).alias("x"), F.col(val).alias("y")))
    d = df.withColumn("_g", good)
    d = d.withColumn("_p", F.last("_g", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    back = W.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_q", F.last("_g", True).over(back))
    p, q = F.col("_p"), F.col("_q")
    line = p["y"] + (q["y"] - p["y"]) * (F.col(order) - p["x"]) / (q["x"] - p["x"])
    return d.withColumn(out, F.when(F.col("_g").isNotNull(), F.col(val)).when(p.isNotNull() & q.isNotNull(), line).otherwise(F.coalesce(p["y"], q["y"], F.col(val)))).drop("_g", "_p", "_q")


def fill_skipped(df: DataFrame, keys: list[str], threshold: float = 0.3, val: str = "val", out: str = "out", order: str = "i") -> DataFrame:
    """Replace intervals that leave the median by more than ``threshold`` of it."""
    med = df.groupBy(*keys).agg(F.percentile(val, 0.5).alias("_med"))
    d = df.join(med, keys).withColumn("_bad", F.abs(F.col(val) - F.col("_med")) > threshold * F.col("_med"))
    return fill(d, keys, F.coalesce(F.col("_bad"), F.lit(False)), val, out, order).drop("_med", "_bad")


def repair_sequence(df: DataFrame, keys: list[str], val: str = "val", max_diff_rel: float = 1.0, max_diff_abs: float | None = None) -> DataFrame:
    return spread(per_signal(df, keys, [val], lambda t: kernels.repair_sequence(t, max_diff_rel, max_diff_abs), "array<double>"), keys)


def repair_outliers(df: DataFrame, keys: list[str], val: str = "val", z: float = 3.0) -> DataFrame:
    return spread(per_signal(df, keys, [val], lambda x: kernels.repair_outliers(x, z), "array<double>"), keys)


def resample_kernel(t: np.ndarray, s: np.ndarray, at: np.ndarray, band: tuple[float, float] | None = None, order: int = 4, extrapolate: bool = False, fill_nan: bool = True) -> np.ndarray:
    """A signal on another grid: band-passed and resampled if a band is given and grids are
    uniform, else monotone cubic; NaN outside the signal unless extrapolated."""
    hole = np.isnan(s)
    if hole.all():
        return np.full(len(at), np.nan)
    full = kernels.fill_missing(s)
    if len(t) == len(at) and np.array_equal(t, at):
        out = full.copy()
    else:
        uniform = all(len(g) > 2 and np.allclose(np.diff(g), np.diff(g)[0], rtol=1e-3) for g in (t, at))
        x = full
        if band is not None and uniform:
            b, a = kernels.butter_bandpass(*band, 1 / np.diff(t)[0], order)
            x = kernels.filtfilt(b, a, full) if len(full) > 3 * len(b) else full
        out = kernels.pchip(t, x, at)
    if extrapolate:
        out = np.where(at < t[0], full[0], np.where(at > t[-1], full[-1], out))
    if not fill_nan and hole.any():
        near = np.interp(at, t, hole.astype(float))
        out = np.where(near > 0, np.nan, out)
    return out


def resample(signal: DataFrame, grid: DataFrame, keys: list[str], **options) -> DataFrame:
    """``signal`` (t, s) on ``grid`` (t_out): keys, i, out."""
    s = gather(signal.withColumn("i", F.col("t")), keys, ["t", "s"])
    g = gather(grid.withColumn("i", F.col("t_out")), keys, ["t_out"])
    j = s.join(g, keys)
    flat = j.select(*keys, F.lit(0).alias("i"), "t", "s", "t_out")
    return _spread_arrays(flat, keys, ["t", "s", "t_out"], lambda a, b, c: resample_kernel(a, b, c, **options))


def _spread_arrays(df: DataFrame, keys: list[str], cols: list[str], fn) -> DataFrame:
    import pyarrow as pa

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys) + ", out array<double>"

    def run(batches):
        for b in batches:
            arrays = [b.column(b.schema.get_field_index(c)) for c in cols]
            res = [fn(*(np.array([np.nan if v is None else v for v in a[k].as_py()], float) for a in arrays)).tolist() for k in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keys] + [pa.array(res, pa.list_(pa.float64()))], [*keys, "out"])

    return spread(df.select(*keys, *cols).mapInArrow(run, schema), keys)
