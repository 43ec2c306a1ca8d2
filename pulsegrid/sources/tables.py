"""Signals, frames and detections out of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One irregular signal per user: signal_id, i, us, val."""
    w = W.partitionBy("signal_id").orderBy("us", "event_id")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), "event_id", micros(F.col("ts")).alias("us"), F.col("value").cast("double").alias("val"))
    return e.withColumn("i", (F.row_number().over(w) - 1).cast("long")).select("signal_id", "i", "us", "val")


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uniform signal per embedding: signal_id, i, val."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), F.posexplode("embedding").alias("i", "v"))
    return v.select("signal_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("val"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y_true of a vector and y_pred of the next: signal_id, i, y_true, y_pred."""
    v = vector_signals(spark, sf_dir)
    nxt = v.select((F.col("signal_id") - 1).alias("signal_id"), "i", F.col("val").alias("y_pred"))
    return v.withColumnRenamed("val", "y_true").join(nxt, ["signal_id", "i"])


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 8 x 8 frames: frame, y, x, p (0 to 255)."""
    v = vector_signals(spark, sf_dir)
    p = F.pmod(F.floor(F.abs("val") * 1000), F.lit(256)).cast("int")
    return v.select(F.col("signal_id").alias("frame"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), p.alias("p"))
