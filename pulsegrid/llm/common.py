"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits: ASCII alphanumerics and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same, faster, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the session's Arrow batches by bytes, so that long texts don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one temporary folder per session where none is set, in local mode only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("pulsegrid.tmp.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("pulsegrid.tmp.dir", base := f"file://{own}")
    return base.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back (survives lost executors)."""
    path = f"{shared_dir(spark)}/pulsegrid-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
