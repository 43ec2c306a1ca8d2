"""Frame and pixel tables: crop, resample, ROI means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import kernels
from pulsegrid.operators import roi as regions


def _axis(spark: SparkSession, src: int, dst: int, name: str) -> DataFrame:
    """Which source positions fall into each destination position of a box resize; src rows."""
    k = spark.range(dst)
    lo, hi = F.expr(f"(id * {src} + {dst // 2}) div {dst}"), F.expr(f"((id + 1) * {src} + {dst // 2}) div {dst}")
    return k.select(F.col("id").cast("int").alias(f"{name}d"), F.explode(F.sequence(lo.cast("int"), (hi - 1).cast("int"))).alias(name))


def box_resample(pixels: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int], val: str = "p") -> DataFrame:
    """Truncated integer mean of each box: keys, y, x, p. Joins with two tables of a side's length each."""
    if src[0] < 2 * dst[0] or src[1] < 2 * dst[1]:
        raise ValueError("box resampling needs a ratio of at least 2")
    s = pixels.sparkSession
    j = pixels.join(F.broadcast(_axis(s, src[0], dst[0], "y")), "y").join(F.broadcast(_axis(s, src[1], dst[1], "x")), "x")
    return j.groupBy(*keys, "yd", "xd").agg(F.expr(f"cast(sum({val}) div count(*) as int)").alias(val)).select(*keys, F.col("yd").alias("y"), F.col("xd").alias("x"), val)


def _weights(spark: SparkSession, src: int, dst: int, name: str) -> DataFrame:
    d = spark.range(dst)
    at = F.least(F.greatest((F.col("id") + 0.5) * (src / dst) - 0.5, F.lit(0.0)), F.lit(float(src - 1)))
    lo, part = F.floor(at), at - F.floor(at)
    two = F.array(F.struct(lo.alias("s"), (1 - part).alias("w")), F.struct(F.least(lo + 1, F.lit(src - 1)).alias("s"), part.alias("w")))
    return d.select(F.col("id").cast("int").alias(f"{name}d"), F.explode(two).alias("e")).select(f"{name}d", F.col("e.s").cast("int").alias(name), F.col("e.w").alias(f"{name}w"))


def bilinear_resample(pixels: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int], val: str = "p") -> DataFrame:
    """Half-pixel bilinear resize in 8-bit fixed point: keys, y, x, p."""
    s = pixels.sparkSession
    j = pixels.join(F.broadcast(_weights(s, src[0], dst[0], "y")), "y").join(F.broadcast(_weights(s, src[1], dst[1], "x")), "x")
    w = F.floor(F.col("yw") * F.col("xw") * 256).cast("long")
    return j.groupBy(*keys, "yd", "xd").agg(F.floor(F.sum(F.col(val) * w) / 256).cast("int").alias(val)).select(*keys, F.col("yd").alias("y"), F.col("xd").alias("x"), val)


def roi_mean(pixels: DataFrame, rois: DataFrame, keys: list[str], val: str | list[str] = "p", out: str = "out", size: tuple[int, int] | None = None) -> DataFrame:
    """Mean of the pixels in each frame's box (x0 <= x < x1, y0 <= y < y1), one column per channel in ``val``.

    Boxes must have an area and, if the frame's ``size`` (h, w) is given, lie inside it.
    """
    fits = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    if size:
        fits = fits & (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= size[1]) & (F.col("y1") <= size[0])
    area = F.when(fits, True).otherwise(F.raise_error(F.lit("a region needs an area inside the frame")).cast("boolean"))
    j = pixels.join(rois.where(area), keys).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    named = [(val, out)] if isinstance(val, str) else [(v, v) for v in val]
    return j.groupBy(*keys).agg(*[F.avg(v).cast("float").alias(o) for v, o in named])


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Half-open crop; positions start at 0 again."""
    return pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def target_shape(h: int, w: int, size: tuple[int, int], keep_ratio: bool, by_longest: bool = False) -> tuple[int, int]:
    """Output height and width: truncated to fit inside, or rounded by the longest side."""
    if not keep_ratio:
        return size
    if by_longest:
        r = max(size) / max(h, w)
        return round(h * r), round(w * r)
    r = min(size[0] / h, size[1] / w)
    return int(h * r), int(w * r)


def crop_slice_resize(frames: DataFrame, size: tuple[int, int] | None = None, roi: tuple[int, int, int, int] | Column | None = None, idxs: list[int] | None = None, keep_ratio: bool = False, algorithm: str | Column = "auto") -> DataFrame:
    """Frame table (…, frame, h, w, c, data) cropped (box clipped to the frame), picked and resized.

    Picked frames keep the order and repetitions of ``idxs`` in the column ``pos``;
    ``roi`` and ``algorithm`` are the same for all frames, or columns (a struct x0, y0, x1, y1; a name).
    """
    if idxs is not None:
        pick = frames.sparkSession.createDataFrame(list(enumerate(idxs)), "pos long, frame int")
        frames = frames.join(F.broadcast(pick), "frame")  # a list given in the call

    columns = frames.columns
    boxes = F.array(*[roi[n] if isinstance(roi, Column) else F.lit(int(roi[k])) for k, n in enumerate(("x0", "y0", "x1", "y1"))]) if roi is not None else F.lit(None)
    frames = frames.withColumn("_algorithm", algorithm if isinstance(algorithm, Column) else F.lit(algorithm)).withColumn("_roi", boxes.cast("array<bigint>"))

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            hs, ws, ds = [], [], []
            for h, w, c, d, how, box in zip(*(cols[n].to_pylist() for n in ("h", "w", "c", "data", "_algorithm", "_roi")), strict=True):
                im = np.frombuffer(d, np.uint8).reshape(h, w, c)
                if box:
                    x0, x1 = (min(max(v, 0), w) for v in (box[0], box[2]))
                    y0, y1 = (min(max(v, 0), h) for v in (box[1], box[3]))
                    im = im[y0:y1, x0:x1]
                if size:
                    im = kernels.resize(im, *target_shape(*im.shape[:2], size, keep_ratio), how)
                hs.append(im.shape[0])
                ws.append(im.shape[1])
                ds.append(im.tobytes())
            cols |= {"h": pa.array(hs, pa.int32()), "w": pa.array(ws, pa.int32()), "data": pa.array(ds, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return frames.mapInArrow(run, frames.schema).select(*columns)


def crop_resize_from_det(frames: DataFrame, det: Column, size: tuple[int, int] | None, method: str | None, algorithm: str = "auto", even: bool = False, detector: str = "retinaface") -> DataFrame:
    """Frame table cut to the region that ``method`` makes of each frame's detection, and resized."""
    box = regions.roi_from_det(det, method, (F.col("w"), F.col("h")), even, detector=detector)
    return crop_slice_resize(frames, size, box, algorithm=algorithm)


def frames_of(pixels: DataFrame, keys: list[str], h: int, w: int, val: str = "p") -> DataFrame:
    """Pixel rows of one channel -> frame rows with packed bytes."""
    data = F.array_sort(F.collect_list(F.struct("y", "x", val)))
    joined = F.unhex(F.array_join(F.transform(data, lambda s: F.lpad(F.hex(s[val]), 2, "0")), ""))
    return pixels.groupBy(*keys).agg(joined.alias("data")).select(*keys, F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(1).alias("c"), "data")
