"""Error metrics, losses and reductions as aggregate expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.functions.expr import finite, is_finite
from pulsegrid.operators.asof import shifted


def _both(t: Column, p: Column, ignore_nan: bool) -> tuple[Column, Column]:
    ok = is_finite(t) & is_finite(p)
    return (F.when(ok, t), F.when(ok, p)) if ignore_nan else (t, p)


def mae(t: Column, p: Column, ignore_nan: bool = False) -> Column:
    t, p = _both(t, p, ignore_nan)
    return F.avg(F.abs(t - p))


def mse(t: Column, p: Column, ignore_nan: bool = False) -> Column:
    t, p = _both(t, p, ignore_nan)
    return F.avg((t - p) * (t - p))


def rmse(t: Column, p: Column, ignore_nan: bool = False) -> Column:
    return F.sqrt(mse(t, p, ignore_nan))


def cor(t: Column, p: Column, ignore_nan: bool = False) -> Column:
    """Pearson correlation; NaN if either side is constant."""
    return F.coalesce(F.corr(*_both(t, p, ignore_nan)), F.lit(float("nan")))


METRICS = {"mae": (mae, False), "mse": (mse, False), "rmse": (rmse, False), "cor": (cor, True)}


def shift_pooled(df: DataFrame, keys: list[str], metric: str, f_s: float, max_shift_t: float = 0.3, max_shift: int = 30) -> DataFrame:
    """Best metric over shifts: keys, out (float). Empty shifts don't take part."""
    fn, high = METRICS[metric]
    s = min(int(max_shift_t * f_s), max_shift)
    per = shifted(df, keys, s).groupBy(*keys, "s").agg(fn(F.col("y_true"), F.col("y_pred")).alias("m"))
    return per.groupBy(*keys).agg((F.max if high else F.min)("m").cast("float").alias("out"))


def nan_mean(x: Column) -> Column:
    """Mean over finite values, NaN if there are none."""
    return F.coalesce(F.avg(finite(x)), F.lit(float("nan")))


def nan_sum(x: Column, weight=1.0, default: float = float("nan")) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.coalesce(F.sum(finite(x) * w), F.lit(default))


def nan_mean_gradient(df: DataFrame, keys: list[str], val: str, out: str = "grad") -> DataFrame:
    """1 / number of finite values on finite values, 0 elsewhere."""
    n = F.count(finite(F.col(val))).over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(is_finite(F.col(val)), F.try_divide(F.lit(1.0), n)).otherwise(0.0))


def nan_sum_gradient(x: Column, upstream=1.0) -> Column:
    return F.when(is_finite(x), F.lit(upstream)).otherwise(0.0)


def smooth_l1(t: Column, p: Column) -> Column:
    """Per element; average it for the loss."""
    d = F.abs(t - p)
    return F.when(d < 1, d * d / 2).otherwise(d - 0.5)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """(N / count of the class) / number of classes present; counted per class first."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    w = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / F.col("_c") / F.col("_k")).alias(out))  # one row
    return df.join(w, label)


def snr_kernel(y: np.ndarray, f_true: float, f_s: float, f_res: float, tol: float = 0.1, lo: float = 0.5, hi: float = 4.0) -> float:
    """Power near a frequency and its double against the rest of the band, in dB."""
    if not np.isfinite(y).all() or not np.isfinite(f_true):
        return float("nan")
    f, p = kernels.periodogram(y, f_s, f_res)
    signal = p[(np.abs(f - f_true) <= tol) | (np.abs(f - 2 * f_true) <= tol)].sum()
    noise = p[(f >= lo) & (f <= hi)].sum() - signal
    return float(10 * np.log10(signal / noise)) if signal > 0 and noise > 0 else float("nan")
