"""Regions of interest out of detection boxes (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative change of the left, top, right and bottom side.
CHANGES = {
    "det": (0.0, 0.0, 0.0, 0.0),
    "face": (-0.2, -0.1, -0.2, -0.1),
    "forehead": (-0.35, -0.15, -0.35, -0.75),
    "meta": (0.2, 0.2, 0.2, 0.2),
}
UPPER_BODY = [(0.25, 0.3, 0.25, 0.5), (0.25, 0.2, 0.25, 0.4), (0.25, 0.1, 0.25, 0.5), (0.2, 0.3, 0.2, 0.45)]
UPPER_BODY_CROPPED = [(0.175, 0.27, 0.175, 0.45), (0.175, 0.15, 0.175, 0.3), (0.175, 0.075, 0.175, 0.375), (0.15, 0.25, 0.15, 0.35)]
ULTRALIGHT_V1_CROPPED = (0.19, 0.1455, 0.19, 0.2769)
SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("bigint").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES, strict=True)])


def clip_roi(b: Column, w: int | Column, h: int | Column) -> Column:
    most = dict(zip(SIDES, (w, h, w, h), strict=True))
    return F.struct(*[F.least(F.greatest(b[n], F.lit(0)), F.lit(most[n])).cast("bigint").alias(n) for n in SIDES])


def even_dims(b: Column) -> Column:
    """Odd sides lose their last column or row."""
    return F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), (b["x1"] - F.pmod(b["x1"] - b["x0"], F.lit(2))).alias("x1"), (b["y1"] - F.pmod(b["y1"] - b["y0"], F.lit(2))).alias("y1"))


def grow(b: Column, change: tuple[float, float, float, float], clip: tuple[int, int] | None = None, even: bool = False) -> Column:
    """Move each side outwards by a share of the box's size, truncated toward zero."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    by = [(F.lit(c) * s).cast("bigint") for c, s in zip(change, (w, h, w, h), strict=True)]
    out = box(b["x0"] - by[0], b["y0"] - by[1], b["x1"] + by[2], b["y1"] + by[3])
    out = clip_roi(out, *clip) if clip else out
    return even_dims(out) if even else out


def roi_from_det(b: Column, method: str | None, clip: tuple | None = None, even: bool = False, version: int = 1, detector: str = "retinaface") -> Column:
    """face, forehead, upper_body, upper_body_cropped, meta, or det (also None): the box itself.

    Regions that can leave the frame need its size (width, height) in ``clip``.
    """
    if method is None or method in ("face", "forehead", "det"):
        return grow(b, CHANGES[method or "det"], None, even)
    if clip is None and method in ("meta", "upper_body", "upper_body_cropped"):
        raise ValueError(f"{method} needs the size of the frame")
    if method == "meta":
        return grow(b, CHANGES["meta"], clip, even)
    if method == "upper_body":
        return grow(b, UPPER_BODY[version], clip, even)
    if method == "upper_body_cropped":
        ultra = detector == "ultralight-rfb" and version == 1
        return grow(b, ULTRALIGHT_V1_CROPPED if ultra else UPPER_BODY_CROPPED[version], clip, even)
    raise ValueError(f"unknown method {method!r}")
