"""Running a NumPy kernel once per signal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, keys: list[str], cols: list[str], order: str = "i") -> DataFrame:
    """keys and one array per column, in order; a signal is one row and must fit a task."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).cast("double").alias(c) for c in cols]))).alias("_s"))
    return g.select(*keys, *[F.transform("_s", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda s: s[name]


def per_signal(df: DataFrame, keys: list[str], cols: list[str], fn: Callable, out: str = "double", order: str = "i") -> DataFrame:
    """keys, out: ``fn`` of the arrays in ``cols``; ``out`` is double, array<double> or array<array<bigint>>."""
    g = gather(df, keys, cols, order)
    kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64()))}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema.fields if f.name in keys) + f", out {out}"

    def run(batches):
        for b in batches:
            arrays = [b.column(b.schema.get_field_index(c)) for c in cols]
            res = [fn(*(np.array(a[k].as_py(), float) for a in arrays)) for k in range(len(b))]
            res = [r if np.isscalar(r) else [x.tolist() if isinstance(x, np.ndarray) else x for x in r] for r in res]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keys] + [pa.array(res, kinds[out])], [*keys, "out"])

    return g.mapInArrow(run, schema)


def per_row(df: DataFrame, keys: list[str], cols: list[str], fn: Callable, order: str = "i") -> DataFrame:
    """keys, the columns (as double) and out: ``fn`` of a signal's arrays gives a value for each of its rows."""
    g = gather(df, keys, cols, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema.fields) + ", out array<double>"

    def run(batches):
        for b in batches:
            arrays = [b.column(b.schema.get_field_index(c)) for c in cols]
            res = [np.asarray(fn(*(np.array(a[k].as_py(), float) for a in arrays)), float).tolist() for k in range(len(b))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(res, pa.list_(pa.float64()))], [*b.schema.names, "out"])

    zipped = g.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip(*cols, "out")).alias("_z"))
    return zipped.select(*keys, *[F.col("_z")[c].alias(c) for c in [*cols, "out"]])


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, out from an array per signal."""
    return df.select(*keys, F.posexplode("out").alias("i", "out")).withColumn("i", F.col("i").cast("long"))
