"""Scalar expressions shared by the operators. Missing values are NULL inside the
engine; NaN is turned into NULL on entry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and physiological limits (per minute, ms, ms^2).
NANOS, MICROS, MILLIS, SECONDS_PER_MINUTE = 1e9, 1e6, 1e3, 60.0
HR_RANGE, RR_RANGE = (40.0, 240.0), (1.0, 60.0)
# further limits: mmHg, ms, cm/ms, percent; seconds of signal that an estimate needs at least and at most
LIMITS = {"bp_sys": (40.0, 240.0), "bp_dia": (20.0, 160.0), "ptt": (100.0, 400.0), "pwv": (0.2, 0.6), "spo2": (70.0, 100.0), "idx": (0.0, 1.0)}
CALC_SECONDS = {"hr": (5.0, 10.0), "rr": (10.0, 30.0), "sdnn": (20.0, 60.0), "rmssd": (20.0, 60.0), "lfhf": (55.0, 60.0)}
HRV_LIMITS = {"sdnn": (1.0, 200.0), "rmssd": (1.0, 200.0), "lf": (0.0, 5000.0), "hf": (0.0, 5000.0), "lfhf": (0.0, 10.0)}


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column) -> Column:
    """The value, or NULL if it isn't finite."""
    return F.when(is_finite(x), x)


def div0(a: Column, b: Column, fill: float = math.nan) -> Column:
    """``a / b``; any quotient that isn't finite gives ``fill``."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(is_finite(q), q).otherwise(F.lit(fill))


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def mag2db(x: Column) -> Column:
    """20 log10; -inf at zero, NaN below."""
    return F.when(x > 0, 20 * F.log10(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def str2bool(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(x, F.lit("NULL")))).cast("boolean"))


def moving_average_size(f_s: Column, cutoff) -> Column:
    """Box size whose response falls to one half at ``cutoff`` Hz."""
    ratio = F.lit(cutoff).cast("double") / f_s
    return F.greatest(F.floor(F.sqrt(0.196202 + ratio * ratio) / ratio), F.lit(1)).cast("int")


def detrend_lambda(f_s: Column, kind: str = "hr") -> Column:
    # fixed values: fitted factor and exponent of each band
    a, b = {"hr": (0.1614, 1.9804), "rr": (4.4248, 2.1253)}[kind]
    return F.floor(a * F.pow(f_s, F.lit(b))).cast("int")


def image_bytes(shape: list[int], itemsize: int) -> int:
    """Memory of a dense array; partition sizing takes the place of a memory guard."""
    return math.prod(shape) * itemsize


def lr_schedule(step: Column, boundaries: list[int], values: list[float], init: float, warmup: int) -> Column:
    """Linear warm-up to ``values[0]``, then piecewise constant."""
    if len(values) != len(boundaries) + 1 or warmup < 1 or warmup > boundaries[0]:
        raise ValueError("needs one value more than boundaries and 1 <= warmup <= boundaries[0]")
    out = F.when(step <= warmup, init + (values[0] - init) * step / F.lit(float(warmup)))
    for b, v in zip(boundaries, values, strict=False):
        out = out.when(step <= b, F.lit(v))
    return out.otherwise(F.lit(values[-1]))
