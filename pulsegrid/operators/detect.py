"""Detection of periodic peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators.asof import runs
from pulsegrid.operators.kernel import per_signal


def valid_peaks(df: DataFrame, keys: list[str], f_s: float, window: int, f_range, val: str = "val", **options) -> DataFrame:
    """keys, seq_id, det_idx: runs of peaks that fit the rolling reference frequency."""
    r = per_signal(df, keys, [val], lambda x: [list(map(int, q)) for q in kernels.valid_peaks(x, f_s, window, f_range, **options)[0]], "array<array<bigint>>")
    return r.select(*keys, F.posexplode("out").alias("seq_id", "d")).select(*keys, "seq_id", F.explode("d").alias("det_idx"))


def refine(signal: DataFrame, dets: DataFrame, keys: list[str], window: int, foot: bool = False, val: str = "val") -> DataFrame:
    """The highest (or lowest) sample at offsets [-w // 2, w // 2) of each detection, the first on ties: keys, det_idx, refined."""
    offsets = dets.withColumn("i", F.explode(F.sequence(F.col("det_idx") - window // 2, F.col("det_idx") + window // 2 - 1)))
    j = offsets.join(signal.select(*keys, "i", val), [*keys, "i"])
    pick = F.min_by("i", F.struct(val, "i")) if foot else F.max_by("i", F.struct(val, -F.col("i")))
    return j.groupBy(*keys, "det_idx").agg(pick.alias("refined"))


def interval_validity(gap: Column, reference: Column, short: float = 0.4, long: float = 0.8) -> Column:
    return ((1 - short) * reference < gap) & (gap < (1 + long) * reference)


def valid_runs(df: DataFrame, keys: list[str], time: str, reference: Column, least: int = 1, short: float = 0.4, long: float = 0.8) -> DataFrame:
    """Detections whose interval fits the reference, in runs of more than ``least``: adds seq_id.

    The first detection of a signal takes the interval that follows it.
    """
    w = W.partitionBy(*keys).orderBy(time)
    gap = F.coalesce(F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time))
    d = df.withColumn("_gap", gap.cast("double")).withColumn("_fit", interval_validity(F.col("_gap"), reference, short, long))
    r = runs(d, keys, time, F.col("_fit")).drop("_gap", "_fit")
    return r.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*keys, "seq_id"))).where(F.col("_c") > least).drop("_c")
