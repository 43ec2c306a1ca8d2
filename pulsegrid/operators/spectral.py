"""Spectra and dominant frequencies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators.kernel import per_signal, spread
from pulsegrid.operators.metrics import snr_kernel


def dft(df: DataFrame, keys: list[str], n: int, val: str = "val") -> DataFrame:
    """Power of every non-negative frequency of signals of length ``n``: keys, k, power (one FFT a signal)."""
    p = per_signal(df, keys, [val], lambda x: np.abs(np.fft.rfft(x, n)) ** 2, "array<double>")
    return spread(p, keys).select(*keys, F.col("i").alias("k"), F.col("out").alias("power"))


def dft_peak(df: DataFrame, keys: list[str], n: int, f_s: float, f_range=None, val: str = "val") -> DataFrame:
    """keys, freq: the frequency of most power (least frequency on ties)."""
    p = dft(df, keys, n, val).withColumn("f", F.col("k") * (f_s / n))
    if f_range:
        p = p.withColumn("power", F.when(F.col("f").between(*f_range), F.col("power")).otherwise(0.0))
    return p.groupBy(*keys).agg(F.max_by("f", F.struct("power", -F.col("k"))).alias("freq"))


def periodicity(df: DataFrame, keys: list[str], n: int, val: str = "val") -> DataFrame:
    """keys, out: largest share of power in one frequency."""
    return dft(df, keys, n, val).groupBy(*keys).agg(F.coalesce(F.try_divide(F.max("power"), F.sum("power")), F.lit(0.0)).alias("out"))


def most_periodic(df: DataFrame, group: list[str], member: str, n: int, val: str = "val") -> DataFrame:
    """group, member: the most periodic signal of each group (the first on ties)."""
    return periodicity(df, [*group, member], n, val).groupBy(*group).agg(F.max_by(member, F.struct(F.round("out", 9), -F.col(member))).alias(member))


def estimate_freq(df: DataFrame, keys: list[str], f_s: float, f_range=None, f_res: float | None = None, method: str = "periodogram", val: str = "val", **peaks) -> DataFrame:
    """keys, out: dominant frequency by ``fft``, ``periodogram`` or ``peak``."""
    if method == "peak":
        return per_signal(df, keys, [val], lambda x: peak_rate(x, f_s, f_range, **peaks))
    if method not in ("fft", "periodogram"):
        raise ValueError(f"unknown method {method!r}")
    return per_signal(df, keys, [val], lambda x: kernels.peak_frequency(x, f_s, f_range, f_res, method))


def peak_rate(x: np.ndarray, f_s: float, f_range, window: int | None = None, interp_skipped: bool = False, **options) -> float:
    """f_s / median interval of the valid peaks; NaN without any."""
    runs, _ = kernels.valid_peaks(x, f_s, window or len(x), f_range, **options)
    d = np.concatenate([np.diff(r) for r in runs]) if runs else np.empty(0)
    d = kernels.fill_skipped(d) if interp_skipped else d
    return float(f_s / np.median(d)) if len(d) else float("nan")


def detrend(df: DataFrame, keys: list[str], lam: float, val: str = "val") -> DataFrame:
    return spread(per_signal(df, keys, [val], lambda x: kernels.detrend(x, lam), "array<double>"), keys)


def bandpass(df: DataFrame, keys: list[str], low: float, high: float, f_s: float, order: int = 5, val: str = "val") -> DataFrame:
    b, a = kernels.butter_bandpass(low, high, f_s, order)
    return spread(per_signal(df, keys, [val], lambda x: kernels.filtfilt(b, a, x), "array<double>"), keys)


def snr(df: DataFrame, keys: list[str], f_s: float, f_res: float, f_true: str = "f_true", val: str = "val", **options) -> DataFrame:
    """keys, out: dB of the power near ``f_true`` (a column constant in a signal) against the band."""
    return per_signal(df, keys, [val, f_true], lambda x, f: snr_kernel(x, f[0], f_s, f_res, **options))
