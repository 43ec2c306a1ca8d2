"""Retention of scored checkpoints over their full history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(history: DataFrame, keys: list[str], k: int, higher: bool = False) -> DataFrame:
    """The k best scores; of equal scores the earlier step stays. Kept rows get a file name."""
    score = F.col("score").desc() if higher else F.col("score").asc()
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(score, "step"))
    return history.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn").withColumn("file", _name("best"))


def keep_latest(history: DataFrame, keys: list[str], k: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("step").desc()))
    return history.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn").withColumn("file", _name("latest"))


def keep_all(history: DataFrame) -> DataFrame:
    return history.withColumn("file", _name("keep"))


def best_score(history: DataFrame, keys: list[str], higher: bool = False) -> DataFrame:
    return history.groupBy(*keys).agg((F.max if higher else F.min)("score").alias("score"))


def _name(kind: str):
    return F.concat_ws("_", F.col("name"), F.lit(kind), F.col("step").cast("string"))
