"""As-of, gather and shift joins, and runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(samples: DataFrame, marks: DataFrame, keys: list[str], time: str = "us", val: str = "v", cutoff: bool = False) -> DataFrame:
    """Each sample with the value of the last mark at or before it (NULL before the first).

    ``cutoff`` ends the last value after one more interval between marks.
    One sort per key over the union of both; no pairs are made.
    """
    s = samples.select(*keys, time, F.lit(None).cast(marks.schema[val].dataType).alias("_v"), F.lit(None).cast("long").alias("_m"), F.lit(1).alias("_s"))
    m = marks.select(*keys, time, F.col(val).alias("_v"), F.col(time).alias("_m"), F.lit(0).alias("_s"))
    u = s.unionByName(m)
    before = W.partitionBy(*keys).orderBy(time, "_s").rowsBetween(W.unboundedPreceding, 0)
    out = u.withColumn(val, F.last("_v", True).over(before))
    if cutoff:
        last = marks.withColumn("_prev", F.lag(time).over(W.partitionBy(*keys).orderBy(time))).groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("a"), F.col("_prev").alias("b"))).alias("_e"))
        end = F.col("_e.a") + (F.col("_e.a") - F.col("_e.b"))
        out = out.join(last, keys, "left").withColumn(val, F.when(F.coalesce(F.col(time) < end, F.lit(True)), F.col(val)))
    return out.where("_s = 1").select(*keys, time, val)


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, out: str = "seq_id") -> DataFrame:
    """Rows where ``flag`` holds, numbered by run of adjacent ones."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_ok", F.coalesce(flag, F.lit(False))).withColumn("_new", (F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False))).cast("int"))
    return d.withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_ok").drop("_ok", "_new")


def overlay(df: DataFrame, keys: list[str], val: str, order: str) -> DataFrame:
    """The last value that isn't missing, by ``order``."""
    return df.where(F.col(val).isNotNull() & ~F.isnan(val)).groupBy(*keys).agg(F.max_by(val, order).alias(val))


def shifted(df: DataFrame, keys: list[str], shifts: int, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """y_true[i] against y_pred[i - s] for every |s| <= shifts, truncated at the ends: keys, s, i, y_true, y_pred."""
    p = df.select(*keys, F.explode(F.sequence(F.lit(-shifts), F.lit(shifts))).alias("s"), F.col("i").alias("_j"), F.col(pred).alias("y_pred"))
    return df.select(*keys, "i", F.col(true).alias("y_true")).join(p.withColumn("i", F.col("_j") + F.col("s")), [*keys, "i"]).drop("_j")
