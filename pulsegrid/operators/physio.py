"""Heart rate, respiratory rate and heart-rate variability."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.functions.expr import HR_RANGE, HRV_LIMITS, RR_RANGE, clip
from pulsegrid.operators import asof, interp, spectral, windows
from pulsegrid.operators.kernel import per_row, per_signal

NAN = float("nan")


def intervals(dets: DataFrame, keys: list[str], time: str = "t", out: str = "d") -> DataFrame:
    """Time between a detection and the one before (NULL for the first)."""
    return dets.withColumn(out, F.col(time) - F.lag(time).over(W.partitionBy(*keys).orderBy(time)))


def median_rate(d: Column) -> Column:
    """60 / median interval; NaN without intervals or with one of zero."""
    zero = F.count_if(d == 0) > 0
    return F.when((F.count(d) < 1) | zero, F.lit(NAN)).otherwise(F.try_divide(F.lit(60.0), F.percentile(d, F.lit(0.5))))


def rate_from_detections(dets: DataFrame, keys: list[str], time: str = "t", interp_skipped: bool = False) -> DataFrame:
    """keys, rate (per minute) over all detections of a signal, ``time`` in seconds."""
    d = intervals(dets, keys, time)
    if interp_skipped:
        good = interp.fill_skipped(d.where("d IS NOT NULL"), keys, 0.3, "d", "_d", time)
        d = dets.select(*keys).distinct().join(good.select(*keys, F.col("_d").alias("d")), keys, "left")
    return d.groupBy(*keys).agg(median_rate(F.col("d")).alias("rate"))


def rate_from_sequences(dets: DataFrame, keys: list[str], seq: str = "seq_id", time: str = "t", weighted: bool = False) -> DataFrame:
    """keys, rate over runs of detections: intervals pooled, or run rates weighted by duration."""
    d = intervals(dets, [*keys, seq], time)
    if not weighted:
        return d.groupBy(*keys).agg(median_rate(F.col("d")).alias("rate"))
    return weighted_mean(d.groupBy(*keys, seq).agg(median_rate(F.col("d")).alias("v"), (F.max(time) - F.min(time)).alias("w")), keys).withColumnRenamed("out", "rate")


def weighted_mean(df: DataFrame, keys: list[str], val: str = "v", weight: str = "w") -> DataFrame:
    """Duration-weighted mean of the runs that have a value; NaN if none has."""
    ok = ~F.isnan(val) & F.col(val).isNotNull()
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.when(ok, F.col(val) * F.col(weight))), F.sum(F.when(ok, F.col(weight)))), F.lit(NAN)).alias("out"))


def rolling_rate_by_detections(dets: DataFrame, keys: list[str], size: int, time: str = "t") -> DataFrame:
    """Detections with the rate over the last ``size`` of them (NULL before); NaN with an interval of zero."""
    w = W.partitionBy(*keys).orderBy(time)
    d = intervals(dets, keys, time)
    frame = w.rowsBetween(-(size - 2), 0)
    rate = F.when(F.count_if(F.col("d") == 0).over(frame) > 0, F.lit(NAN)).otherwise(F.try_divide(F.lit(60.0), F.percentile("d", F.lit(0.5)).over(frame)))
    return d.withColumn("rate", F.when(F.row_number().over(w) >= size, rate)).drop("d")


def rolling(dets: DataFrame, keys: list[str], fn: Callable, least: float, most: float, overlap: int | None = None, unit: str = "detections", time: str = "t", pad: float = NAN) -> DataFrame:
    """keys, ``time``, out: ``fn`` of the times in each window, a value per detection.

    ``unit`` is "detections" (windows of ``least`` to ``most`` of them, every ``most - overlap``;
    ``overlap`` is ``least - 1`` by default) or "seconds" (windows that end at each detection).
    """
    if unit == "seconds":
        return per_row(dets, keys, [time], lambda t: kernels.rolling_span(t, fn, least, most, pad), time)
    if unit != "detections":
        raise ValueError(f"unknown unit {unit!r}")
    overlap = int(least) - 1 if overlap is None else overlap
    if overlap > least:
        raise ValueError("overlap must not exceed the least window")
    return per_row(dets, keys, [time], lambda t: kernels.rolling_count(t, fn, int(least), int(most), overlap, pad=pad), time)


def rolling_rate(dets: DataFrame, keys: list[str], least: float, most: float, overlap: int | None = None, unit: str = "detections", interp_skipped: bool = False, time: str = "t", pad: float = NAN) -> DataFrame:
    """keys, ``time``, rate over rolling windows of detections or seconds."""
    return rolling(dets, keys, lambda t: kernels.rate_of_times(t, interp_skipped), least, most, overlap, unit, time, pad).withColumnRenamed("out", "rate")


def rolling_hrv(dets: DataFrame, keys: list[str], metric: str, least: float, most: float, f_s: float | None = None, overlap: int | None = None, unit: str = "detections", interp_skipped: bool = False, min_dets: int = 8, min_t: float = 10.0, correct: bool = True, time: str = "t", pad: float = NAN) -> DataFrame:
    """keys, ``time``, value: variability over rolling windows; runs of detections are keys too."""
    _known(metric)
    err = 1 / (12 * f_s * f_s) if f_s and correct else 0.0
    return rolling(dets, keys, lambda t: kernels.variability_of_times(t, metric, HRV_LIMITS, err, min_dets, min_t, interp_skipped), least, most, overlap, unit, time, pad).withColumnRenamed("out", "value")


def _known(metric: str) -> None:
    if metric not in HRV_LIMITS:
        raise ValueError(f"unknown metric {metric!r}")


def upsample(rates: DataFrame, samples: DataFrame, keys: list[str], time: str = "us", val: str = "rate") -> DataFrame:
    """Per-detection results held until the next, on all samples."""
    return asof.asof(samples, rates, keys, time, val, cutoff=True)


def sdnn(d: Column, var_e=0.0) -> Column:
    """Deviation of intervals in ms, less the quantisation error, clipped."""
    return clip(F.sqrt(F.var_pop(d) - F.lit(var_e)) * 1000, *HRV_LIMITS["sdnn"])


def rmssd(dd: Column, var_e=0.0) -> Column:
    return clip(F.sqrt(F.avg(dd * dd) - 2 * F.lit(var_e)) * 1000, *HRV_LIMITS["rmssd"])


def _moment(metric: str, d: Column, dd: Column, err: float, enough: Column) -> Column:
    """SDNN or RMSSD of a group of intervals; NaN where there isn't enough, or with an interval of zero."""
    value = sdnn(d, err) if metric == "sdnn" else rmssd(dd, err)
    return F.when(enough & (F.count_if(d == 0) == 0), F.coalesce(F.nanvl(value, F.lit(NAN)), F.lit(NAN))).otherwise(F.lit(NAN))


def hrv_from_detections(dets: DataFrame, keys: list[str], metric: str, f_s: float | None = None, time: str = "t", min_dets: int = 8, min_t: float = 10.0, correct: bool = True, interp_skipped: bool = False) -> DataFrame:
    """keys, value over all detections of a signal; NaN below ``min_dets`` + 2 of them or ``min_t`` seconds."""
    _known(metric)
    err = 1 / (12 * f_s * f_s) if f_s and correct else 0.0
    if metric not in ("sdnn", "rmssd") or interp_skipped:
        k = per_signal(dets, keys, [time], lambda t: kernels.variability_of_times(t, metric, HRV_LIMITS, err, min_dets + 2, min_t, interp_skipped), order=time)
        return k.withColumnRenamed("out", "value")
    d = intervals(dets, keys, time)
    d = d.withColumn("dd", F.col("d") - F.lag("d").over(W.partitionBy(*keys).orderBy(time)))
    enough = (F.count("d") - 1 >= min_dets) & (F.max(time) - F.min(time) >= min_t)
    return d.groupBy(*keys).agg(_moment(metric, F.col("d"), F.col("dd"), err, enough).alias("value"))


def hrv_from_sequences(dets: DataFrame, keys: list[str], metric: str, f_s: float | None = None, seq: str = "seq_id", time: str = "t", min_dets: int = 8, min_t: float = 10.0, correct: bool = True, weighted: bool = True, interp_skipped: bool = False) -> DataFrame:
    """keys, value over runs of detections: weighted by duration, or of the intervals of all runs one after the other."""
    _known(metric)
    err = 1 / (12 * f_s * f_s) if f_s and correct else 0.0
    part = [*keys, seq]
    d = intervals(dets, part, time)
    if not weighted:
        before = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
        d = d.withColumn("dd", F.col("d") - F.last("d", True).over(before))
        if metric in ("sdnn", "rmssd") and not interp_skipped:
            enough = (F.count("d") + 1 >= min_dets) & (F.sum("d") >= min_t)
            return d.groupBy(*keys).agg(_moment(metric, F.col("d"), F.col("dd"), err, enough).alias("value"))

        def joined(x: np.ndarray) -> float:
            return kernels.variability_of_times(np.r_[0.0, np.cumsum(x[~np.isnan(x)])], metric, HRV_LIMITS, err, min_dets, min_t, interp_skipped)

        return per_signal(d.withColumn("d", F.coalesce("d", F.lit(NAN))), keys, ["d"], joined, order=time).withColumnRenamed("out", "value")
    if metric in ("sdnn", "rmssd") and not interp_skipped:
        d = d.withColumn("dd", F.col("d") - F.lag("d").over(W.partitionBy(*part).orderBy(time)))
        enough = (F.count("d") + 1 >= min_dets) & (F.max(time) - F.min(time) >= min_t)
        runs = d.groupBy(*part).agg(_moment(metric, F.col("d"), F.col("dd"), err, enough).alias("v"), (F.max(time) - F.min(time)).alias("w"))
    else:
        v = per_signal(dets, part, [time], lambda t: kernels.variability_of_times(t, metric, HRV_LIMITS, err, min_dets, min_t, interp_skipped), order=time).withColumnRenamed("out", "v")
        runs = v.join(dets.groupBy(*part).agg((F.max(time) - F.min(time)).alias("w")), part)
    return weighted_mean(runs, keys).withColumnRenamed("out", "value")


def split_by_confidence(dets: DataFrame, keys: list[str], conf: str = "conf", threshold: float = 0.6, order: str = "det_idx") -> DataFrame:
    """Detections of enough confidence, in runs of adjacent ones: adds seq_id."""
    return asof.runs(dets, keys, order, F.col(conf) >= threshold)


def rate_from_signal(df: DataFrame, keys: list[str], f_s: float, limits: tuple[float, float] = HR_RANGE, method: str = "periodogram", window: int | None = None, overlap: int | None = None, val: str = "val") -> DataFrame:
    """keys, rate of the whole signal; with ``window``: keys, i, out by hop windows."""
    band = (limits[0] / 60, limits[1] / 60)
    res = None if method == "peak" else 0.5 / 60
    if window is None:
        return spectral.estimate_freq(df, keys, f_s, band, res, method, val).select(*keys, (60 * F.col("out")).alias("rate"))
    overlap = window // 2 if overlap is None else overlap
    w = windows.window_view(df.select(*keys, "i", val), keys, window, overlap)
    w = w.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*keys, "win"))).where(F.col("_c") == window)
    v = spectral.estimate_freq(w, [*keys, "win"], f_s, band, res, method, val).select(*keys, "win", (60 * F.col("out")).alias("v"))
    return windows.resolve_hop(v, df, keys, window, overlap)


def hr_from_signal(df: DataFrame, keys: list[str], f_s: float, **options) -> DataFrame:
    return rate_from_signal(df, keys, f_s, HR_RANGE, **options)


def rr_from_signal(df: DataFrame, keys: list[str], f_s: float, **options) -> DataFrame:
    return rate_from_signal(df, keys, f_s, RR_RANGE, **options)


def hrv_from_signal(df: DataFrame, keys: list[str], metric: str, f_s: float, detect_window: int, threshold: float = 0.6, conf: str | None = None, val: str = "val", **options) -> DataFrame:
    """keys, value, confidence (the lowest kept; NULL without ``conf``): peaks, confidence runs, variability."""
    from pulsegrid.operators.detect import valid_peaks

    dets = valid_peaks(df, keys, f_s, detect_window, (HR_RANGE[0] / 60, HR_RANGE[1] / 60), val)
    cols = [*keys, F.col("i").alias("det_idx")] + ([F.col(conf).alias("conf")] if conf else [F.lit(None).cast("double").alias("conf")])
    dets = dets.join(df.select(*cols), [*keys, "det_idx"]).withColumn("t", F.col("det_idx") / F.lit(float(f_s)))
    if conf:
        dets = split_by_confidence(dets.withColumnRenamed("seq_id", "_seq"), [*keys, "_seq"], "conf", threshold)
        dets = dets.withColumn("seq_id", F.col("_seq") * 1_000_000 + F.col("seq_id"))
    value = hrv_from_sequences(dets, keys, metric, f_s, **options)
    return value.join(dets.groupBy(*keys).agg(F.min("conf").alias("confidence")), keys, "left")


