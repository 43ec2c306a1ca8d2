"""Seeded random augmentation of images.

Draws depend on the image's key and a seed alone, so that reruns and lost
executors give the same images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import image

METHODS = ("bicubic", "area", "nearest", "lanczos3", "bilinear_wide")


def draw(keys: list[str], seed: str) -> Column:
    """A number in [0, 1) by the digest of seed and keys (32 bits)."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def random_resize(frames: DataFrame, keys: list[str], size: tuple[int, int], seed: str = "resize") -> DataFrame:
    """Frame table resized to ``size``, each image by a method of its own draw (column ``method``)."""
    at = F.floor(draw(keys, seed) * len(METHODS)).cast("int")
    named = frames.withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), at + 1))
    return image.crop_slice_resize(named, size, algorithm=F.col("method"))


def random_distortion(pixels: DataFrame, keys: list[str], seed: str = "distort", brightness: float = 0.4, contrast: float = 0.5, saturation: float = 0.5, hue: float = 0.1) -> DataFrame:
    """Pixels (keys, y, x, r, g, b in [0, 1]) with random brightness, contrast, saturation and hue, in this order.

    Brightness adds up to ``brightness``; contrast scales about the image's mean
    by 1 - ``contrast`` to 1 + ``contrast``; saturation scales likewise; hue
    turns by up to ``hue`` of a full circle. Values aren't clipped. Pixels
    without a positive greatest channel have no saturation and keep their colour.
    """
    plus = lambda kind, most: (2 * draw(keys, f"{seed}-{kind}") - 1) * most
    w = W.partitionBy(*keys)
    d = pixels.withColumns({"_b": plus("brightness", brightness), "_c": 1 + plus("contrast", contrast), "_s": 1 + plus("saturation", saturation), "_h": plus("hue", hue)})
    # adding brightness moves the mean with the values, so that one pass finds both
    d = d.withColumns({c: (F.col(c) - F.avg(c).over(w)) * F.col("_c") + F.avg(c).over(w) + F.col("_b") for c in "rgb"})
    d = d.withColumns({"_v": F.greatest("r", "g", "b"), "_chroma": F.greatest("r", "g", "b") - F.least("r", "g", "b")})
    coloured = (F.col("_v") > 0) & (F.col("_chroma") > 0)
    sixth = F.when(F.col("r") == F.col("_v"), (F.col("g") - F.col("b")) / F.col("_chroma")).when(F.col("g") == F.col("_v"), 2 + (F.col("b") - F.col("r")) / F.col("_chroma")).otherwise(4 + (F.col("r") - F.col("g")) / F.col("_chroma"))
    d = d.withColumns({"_turn": F.when(coloured, sixth + 6 * F.col("_h")), "_span": F.when(coloured, F.least(F.col("_chroma") * F.col("_s"), F.col("_v")))})

    def channel(n: int, old: str) -> Column:
        k = F.pmod(F.col("_turn") + n, F.lit(6.0))
        return F.coalesce(F.col("_v") - F.col("_span") * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))), F.col(old))

    d = d.withColumns({"r": channel(5, "r"), "g": channel(3, "g"), "b": channel(1, "b")})
    return d.drop("_b", "_c", "_s", "_h", "_v", "_chroma", "_turn", "_span")
