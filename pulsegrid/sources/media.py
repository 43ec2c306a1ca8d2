"""Media sources as DataFrames: probe results, frame plans, frame tables.

Codecs are outside: a decoder, if there is one, is given as a function from the
bytes of a file to frames. Everything around it (probing, trimming, dropping
frames, cropping, scaling, padding) works on frame tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "path string, frame int, h int, w int, c int, data binary"
_PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,nb_frames:string,nb_read_frames:string,duration:string,bit_rate:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>>>, format struct<duration:string,bit_rate:string>"


def parse_probe(js: Column) -> Column:
    """Probe JSON -> struct(fps, total_frames, width, height, codec, bitrate, rotation, issues)."""
    j = F.from_json(js, _PROBE)
    s = F.element_at(F.filter(j["streams"], lambda x: x["codec_type"] == "video"), 1)
    part = F.split(s["avg_frame_rate"], "/")
    fps = F.try_divide(F.element_at(part, 1).cast("double"), F.coalesce(F.get(part, F.lit(1)).cast("double"), F.lit(1.0)))
    duration = F.coalesce(s["duration"], j["format"]["duration"]).try_cast("double")
    exact = F.coalesce(s["nb_frames"].try_cast("int"), s["nb_read_frames"].try_cast("int"))
    guess = F.floor(duration * fps).cast("int")
    total = F.coalesce(exact, guess)
    rate = F.coalesce(s["bit_rate"].try_cast("double"), j["format"]["bit_rate"].try_cast("double")) / 1000
    turn = F.coalesce(s["tags"]["rotate"].try_cast("int"), F.element_at(F.filter(s["side_data_list"]["rotation"], lambda r: r.isNotNull()), 1).try_cast("int"), F.lit(0))
    issues = exact.isNull() | F.coalesce(F.abs(total - guess) > 1, F.lit(False))
    return F.struct(fps.alias("fps"), total.alias("total_frames"), s["width"].alias("width"), s["height"].alias("height"), s["codec_name"].alias("codec"), rate.alias("bitrate"), turn.alias("rotation"), issues.alias("issues"))


def parse_frame_times(csv: Column) -> Column:
    """Lines of timestamps with trailing commas -> array of seconds."""
    return F.filter(F.transform(F.split(csv, "\n"), lambda x: F.rtrim(x, F.lit(",")).try_cast("double")), lambda x: x.isNotNull())


def rectify(w: Column, h: Column, r: Column) -> Column:
    """A quarter turn swaps width and height."""
    swap = F.abs(r) == 90
    return F.struct(F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"), F.when(swap, 0).otherwise(r).alias("r"))


def stream_properties(log: Column) -> Column:
    """Width, height and rotation of the output stream in an encoder's log; 0 where absent."""
    size = r"Stream.*Video:.* (\d+)x(\d+)"
    num = lambda g: F.coalesce(F.regexp_extract(log, size, g).try_cast("int"), F.lit(0))
    turn = F.coalesce(F.bround(F.regexp_extract(log, r"rotation of (-?[\d.]+) degrees", 1).try_cast("double")).cast("int"), F.lit(0))
    return F.struct(num(1).alias("w"), num(2).alias("h"), turn.alias("r"))


def encoder_options(codec: str, crf: int = 12, preset: str = "medium") -> dict:
    # fixed values: encoder names and their quality switches
    table = {"h264": {"c:v": "libx264", "crf": crf, "preset": preset}, "h265": {"c:v": "libx265", "crf": crf, "preset": preset}, "mjpeg": {"c:v": "mjpeg", "q:v": 2}, "ffv1": {"c:v": "ffv1", "level": 3}}
    if codec not in table:
        raise ValueError(f"unknown codec {codec!r}")
    return table[codec]


def factors_near(spark: SparkSession, i: int, f: tuple[int, int, int], d: tuple[int, int, int]) -> DataFrame:
    """The triple nearest to ``f`` (within ``d``) whose product is ``i``: least total change, then least values."""
    axes = [spark.range(max(1, a - b), a + b + 1).select(F.col("id").alias(f"t{k}")) for k, (a, b) in enumerate(zip(f, d, strict=True), 1)]
    # the third factor follows from the first two, so that no triple product is made
    pairs = axes[0].join(F.broadcast(axes[1]), F.lit(i) % (F.col("t1") * F.col("t2")) == 0)
    t = pairs.withColumn("t3", F.expr(f"{i} div (t1 * t2)")).where(F.abs(F.col("t3") - f[2]) <= d[2])
    change = sum((F.abs(F.col(f"t{k}") - f[k - 1]) for k in (1, 2, 3)), F.lit(0))
    return t.groupBy().agg(F.min(F.struct(change.alias("delta"), "t1", "t2", "t3")).alias("s")).where("s IS NOT NULL").select("s.*")


def frame_step(fps: float, target_fps: float | None) -> int:
    """Keep every n-th frame (half rounds to even, at least 1)."""
    return 1 if not target_fps else max(1, round(fps / target_fps))


def select_frames(frames: DataFrame, start: int = 0, end: int | None = None, step: int = 1, col: str = "frame") -> DataFrame:
    """Trim [start, end) and keep every ``step``-th frame from the start; both reach the scan as filters."""
    f = frames.where(F.col(col) >= start)
    f = f if end is None else f.where(F.col(col) < end)
    return f if step == 1 else f.where(F.pmod(F.col(col) - start, F.lit(step)) == 0)


def probe_frames(frames: DataFrame, fps: float | None = None, by: str = "path") -> DataFrame:
    """Per source: fps, n_frames, h, w, c, and ``issues`` (sizes differ, or frames are missing)."""
    g = frames.groupBy(by).agg(F.count("*").alias("n_frames"), F.max("frame").alias("_last"), *[F.max(c).alias(c) for c in "hwc"], *[F.min(c).alias("_" + c) for c in "hwc"])
    odd = (F.col("h") != F.col("_h")) | (F.col("w") != F.col("_w")) | (F.col("c") != F.col("_c")) | (F.col("_last") + 1 != F.col("n_frames"))
    return g.select(by, F.lit(fps).cast("double").alias("fps"), "n_frames", "h", "w", "c", odd.alias("issues"))


def parse_frames(frames: DataFrame, fps: float | None = None, target_fps: float | None = None, ds_factor: int | None = None, trim: tuple[int, int] | None = None, idxs: list[int] | None = None, roi=None, size: tuple[int, int] | None = None, keep_ratio: bool = False, algorithm: str = "auto") -> DataFrame:
    """One front door for frame tables: trim, then every n-th frame (by ``target_fps`` or ``ds_factor``), or
    the frames ``idxs``; then crop and resize. Frames keep their numbers."""
    from pulsegrid.operators.image import crop_slice_resize

    if target_fps is not None and ds_factor is not None:
        raise ValueError("give target_fps or ds_factor, not both")
    if target_fps is not None and fps is None:
        raise ValueError("target_fps needs fps")
    if idxs is not None and (trim or target_fps or ds_factor):
        raise ValueError("idxs goes with neither trim nor downsampling")
    step = frame_step(fps, target_fps) if target_fps is not None else (ds_factor or 1)
    start, end = trim or (0, None)
    picked = select_frames(frames, start, end, step)
    if idxs is None and roi is None and size is None:
        return picked
    return crop_slice_resize(picked, size, roi, idxs, keep_ratio, algorithm)


def pad_frames(frames: DataFrame, want: int, by: str = "path") -> DataFrame:
    """Too few frames: repeat the first in front; too many: drop the last. Frames count from 0."""
    n = frames.groupBy(by).agg(F.count("*").alias("_n"))
    f = frames.join(n, by).withColumn("_miss", F.greatest(F.lit(want) - F.col("_n"), F.lit(0)))
    moved = f.withColumn("frame", (F.col("frame") + F.col("_miss")).cast(frames.schema["frame"].dataType))
    extra = f.where("frame = 0 AND _miss > 0").withColumn("_k", F.explode(F.expr("sequence(0, cast(_miss as int) - 1)")))
    extra = extra.withColumn("frame", F.col("_k").cast(frames.schema["frame"].dataType)).drop("_k")
    return moved.unionByName(extra).where(F.col("frame") < want).select(*frames.columns)


def test_frames(spark: SparkSession, frames: int, h: int = 240, w: int = 320) -> DataFrame:
    """A synthetic moving gradient: frame, y, x, p."""
    p = spark.range(frames * h * w).select((F.col("id") / (h * w)).cast("int").alias("frame"), F.pmod((F.col("id") / w).cast("long"), F.lit(h)).cast("int").alias("y"), F.pmod("id", F.lit(w)).cast("int").alias("x"))
    return p.withColumn("p", F.pmod(F.col("x") + F.col("y") + 3 * F.col("frame"), F.lit(256)))


def read_video(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator] | None = None) -> DataFrame:
    """Frame table of media files; ``decode`` yields one (h, w, c) byte array per frame."""
    if decode is None:
        raise NotImplementedError("no codec here: give decode, or read a frame table from parquet")

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, im in enumerate(decode(content)):
                    yield pa.RecordBatch.from_pylist([{"path": p, "frame": k, "h": im.shape[0], "w": im.shape[1], "c": im.shape[2], "data": im.tobytes()}], pa.schema([("path", pa.string()), ("frame", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FRAMES)


def write_video(frames: DataFrame, path: str, codec: str | None = None) -> None:
    """Frame table to parquet; sizes must be even for codecs that need it."""
    if codec in ("h264", "h265"):
        frames = frames.where(F.when((F.col("h") % 2 == 0) & (F.col("w") % 2 == 0), True).otherwise(F.raise_error(F.lit("height and width must be even")).cast("boolean")))
    frames.write.mode("overwrite").parquet(path)
