"""Operators on small tables: golden values and defined edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import expr
from pulsegrid.operators import augment, detect, elementwise, image, metrics, physio, roi, topk, windows
from pulsegrid.sources import media


def signal(spark, values, sid=1):
    return spark.createDataFrame([(sid, i, float(v)) for i, v in enumerate(values)], "signal_id long, i long, val double")


def ordered(df, col="out"):
    return [r[col] for r in df.orderBy("i").collect()]


def test_div0(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (2.0, 2.0), (5.0, 2.0), (float("inf"), 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(expr.div0(F.col("a"), F.col("b"), -1.0)).collect()] == [0, -1, 1, 2.5, -1, -1]


def test_standardize_family(spark):
    s = signal(spark, [0, 1, -3, 2, -1])
    np.testing.assert_allclose(ordered(elementwise.standardize(s, ["signal_id"])), [0.116247639, 0.697485834, -1.627466946, 1.278724029, -0.464990556])
    np.testing.assert_allclose(ordered(elementwise.normalize(s, ["signal_id"])), [0.2, 1.2, -2.8, 2.2, -0.8])
    np.testing.assert_allclose(ordered(elementwise.scale(s, ["signal_id"])), [0, 0.5812382, -1.7437146, 1.1624764, -0.5812382], rtol=1e-6)
    assert ordered(elementwise.diff(s, ["signal_id"])) == [1, -4, 5, -3]
    assert ordered(elementwise.standardize(signal(spark, [2, 2]), ["signal_id"])) == [0, 0]


def test_moving_average(spark):
    s = signal(spark, [0, 0.4, 1.2, 2, 0.2])
    np.testing.assert_allclose(ordered(windows.moving_average(s, ["signal_id"], 3)), [0.4 / 3, 1.6 / 3, 1.2, 3.4 / 3, 0.8])
    np.testing.assert_allclose(ordered(windows.moving_average(s, ["signal_id"], 3, center=False)), [0.4 / 3, 0.4 / 3, 1.6 / 3, 1.2, 3.4 / 3])
    with pytest.raises(ValueError):
        windows.moving_average(s, ["signal_id"], 4, center=False)


def test_moving_std_hop_golden(spark):
    s = signal(spark, [0, 0.4, 1.2, 2, 2.1, 1.7, 11.4, 4.5, 1.9, 7.6, 6.3, 6.5])
    got = ordered(windows.rolling(s, ["signal_id"], 5, F.stddev_pop, overlap=3))
    np.testing.assert_allclose(got[:8], [0.83809307, 0.83809307, 2.35538328, 2.35538328, 2.79779145, 3.77764063, 3.57559311, 3.42705292])
    assert got[8:] == [None] * 4


def test_ragged_count(spark):
    t = [0.3, 0.7, 1.2, 1.7, 2.1, 2.6]
    df = spark.createDataFrame([(1, int(x * 1e6), x) for x in t], "signal_id long, us long, val double")
    got = windows.rolling_seconds(df, ["signal_id"], F.count, 1.0, 0.5, origin=0).orderBy("us")
    assert [r["out"] for r in got.collect()] == [None, 2, 3, 2, 3, 3]


def test_refine_foot(spark):
    s = signal(spark, [10, 8, 2, 0, 5, 6, 7])
    dets = spark.createDataFrame([(1, 1)], "signal_id long, det_idx long")
    assert detect.refine(s, dets, ["signal_id"], 6, foot=True).first()["refined"] == 3


def test_weighted_mean_skips_nan(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0), (1, float("nan"), 9.0)], "k long, v double, w double")
    assert physio.weighted_mean(df, ["k"]).first()["out"] == 3.5


def test_sequences_sdnn_golden(spark):
    t = np.linspace(0, 8, 2000)
    seqs = [[0, 250, 500, 770], [1000, 1240, 1500, 1740]]
    rows = [(1, k, float(t[i])) for k, s in enumerate(seqs) for i in s]
    df = spark.createDataFrame(rows, "signal_id long, seq_id int, t double")
    d = [np.diff(t[s]) for s in seqs]
    want = sum(np.sqrt(x.var()) * 1000 * x.sum() for x in d) / sum(x.sum() for x in d)
    got = physio.hrv_from_sequences(df, ["signal_id"], "sdnn", min_dets=2, min_t=0.5).first()["value"]
    assert abs(got - want) < 1e-6


def test_rate_needs_two_detections(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (2, 5.0)], "signal_id long, t double")
    got = {r["signal_id"]: r["rate"] for r in physio.rate_from_detections(df, ["signal_id"]).collect()}
    assert got[1] == 60 and math.isnan(got[2])


def test_static_rate_from_signal(spark):
    t = np.arange(2000) / 50
    s = signal(spark, np.sin(2 * np.pi * t))
    assert abs(physio.hr_from_signal(s, ["signal_id"], 50.0).first()["rate"] - 60) < 1
    roll = ordered(physio.hr_from_signal(s, ["signal_id"], 50.0, window=500, overlap=250))
    assert len(roll) == 2000 and abs(np.nanmean([x for x in roll if x is not None]) - 60) < 1.5


def test_losses_and_weights(spark):
    df = spark.createDataFrame(list(zip([0.1, 0.5, 1.8, 3.2], [1.1, -2.5, 1.7, 3.2], strict=True)), "t double, p double")
    r = df.agg(F.avg(metrics.smooth_l1(F.col("t"), F.col("p"))).alias("a"), metrics.mae(F.col("t"), F.col("p")).alias("b")).first()
    assert abs(r["a"] - 0.75125) < 1e-9 and abs(r["b"] - 1.025) < 1e-9
    lab = spark.createDataFrame([(i, x) for i, x in enumerate([1, 1, 2, 4, 1, 2])], "row int, label int")
    got = [r["weight"] for r in metrics.balanced_weights(lab, "label").orderBy("row").collect()]
    np.testing.assert_allclose(got, [2 / 3, 2 / 3, 1, 2, 2 / 3, 1])


def test_rois(spark):
    one = spark.range(1).select(roi.box(*[F.lit(v) for v in (100, 100, 180, 220)]).alias("b"))
    pick = lambda m, **k: tuple(one.select(roi.roi_from_det(F.col("b"), m, **k).alias("r")).first()["r"])
    assert pick("face") == (116, 112, 164, 208)
    assert pick("forehead") == (128, 118, 152, 130)
    assert pick("meta", clip=(220, 300)) == (84, 76, 196, 244)


def test_box_resample_matches_kernel(spark):
    from pulsegrid.functions import kernels

    im = np.random.default_rng(1).integers(0, 256, (11, 9)).astype(np.uint8)
    px = spark.createDataFrame([(0, y, x, int(im[y, x])) for y in range(11) for x in range(9)], "frame int, y int, x int, p int")
    for fn, kernel, dst in ((image.box_resample, kernels.box, (4, 3)), (image.bilinear_resample, kernels.bilinear, (7, 5))):
        got = np.zeros(dst, int)
        for r in fn(px, ["frame"], (11, 9), dst).collect():
            got[r["y"], r["x"]] = r["p"]
        assert np.abs(got - kernel(im[..., None], *dst)[..., 0]).max() <= 1


def test_topk(spark):
    h = spark.createDataFrame([("m", 10, 0.1), ("m", 30, 0.2), ("m", 50, 0.3)], "name string, step long, score double")
    assert sorted(r["step"] for r in topk.keep_best(h, ["name"], 2, higher=True).collect()) == [30, 50]


def test_frames(spark):
    assert [media.frame_step(30, x) for x in (30, 12, 20, 100, None)] == [1, 2, 2, 1, 1]
    f = spark.createDataFrame([("v", i, i * 10) for i in range(3)], "path string, frame int, p int")
    got = [(r["frame"], r["p"]) for r in media.pad_frames(f, 5).orderBy("frame").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 10), (4, 20)]
    assert media.factors_near(spark, 12 * 13 * 3, (12, 12, 3), (2, 2, 1)).first().asDict() == {"delta": 1, "t1": 12, "t2": 13, "t3": 3}


def test_empty_tables(spark):
    s = spark.createDataFrame([], "signal_id long, i long, val double")
    assert windows.moving_average(s, ["signal_id"], 3).count() == 0
    assert physio.hr_from_signal(s, ["signal_id"], 30.0).count() == 0


def test_streaming_hop(spark, tmp_path):
    from pulsegrid.streaming.rolling import hop_stream

    spark.sql("SELECT 1L AS k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, cast(id AS double) AS val FROM range(120)").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k long, ts timestamp, val double").parquet(str(tmp_path / "in"))
    q = hop_stream(src, ["k"], F.count, "60 seconds", "60 seconds").writeStream.format("memory").queryName("hop_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["out"] for r in spark.table("hop_out").collect()) == [60, 60]


def test_random_resize_is_seeded_and_uses_every_method(spark):
    rows = [(k, 4, 4, 1, bytes(range(16))) for k in range(60)]
    df = spark.createDataFrame(rows, "frame int, h int, w int, c int, data binary")
    one = augment.random_resize(df, ["frame"], (3, 2)).orderBy("frame").collect()
    again = augment.random_resize(df.repartition(3), ["frame"], (3, 2)).orderBy("frame").collect()
    assert one == again and {r["method"] for r in one} == set(augment.METHODS)
    assert all((r["h"], r["w"], len(r["data"])) == (3, 2, 6) for r in one)


def test_random_distortion(spark):
    rng = np.random.default_rng(1)
    rows = [(k, y, x, *map(float, rng.random(3))) for k in range(3) for y in range(4) for x in range(4)] + [(9, 0, 0, 0.0, 0.0, 0.0), (9, 0, 1, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, r double, g double, b double")
    still = augment.random_distortion(df, ["frame"], brightness=0, contrast=0, saturation=0, hue=0)
    np.testing.assert_allclose(still.orderBy("frame", "y", "x").select("r", "g", "b").collect(), [r[3:] for r in rows], atol=1e-12)
    # hue and saturation keep the greatest channel; grey stays grey
    turned = augment.random_distortion(df, ["frame"], brightness=0, contrast=0).orderBy("frame", "y", "x").select("r", "g", "b").collect()
    np.testing.assert_allclose(np.max(turned, 1), [max(r[3:]) for r in rows], atol=1e-12)
    assert tuple(turned[-1]) == (0.5, 0.5, 0.5)
    assert not np.allclose(turned[:48], [r[3:] for r in rows[:48]])


def test_rolling_sdnn_golden(spark):
    t = np.linspace(0, 8, 2000)
    rows = [(1, k, float(t[i])) for k, q in enumerate([[202, 392, 612, 799], [1201, 1403, 1610, 1839]]) for i in q]
    df = spark.createDataFrame(rows, "signal_id long, seq_id int, t double")
    f_s = 2000 / 8
    for correct, want in ((True, (59.6173, 46.9229)), (False, (59.6284, 46.9371))):
        r = physio.rolling_hrv(df, ["signal_id", "seq_id"], "sdnn", 2, 4, f_s, overlap=2, min_dets=3, min_t=0.5, correct=correct).orderBy("t").collect()
        for k in (0, 1):
            own = [x["value"] for x in r if x["seq_id"] == k]
            assert math.isnan(own[0]) and math.isnan(own[1])
            np.testing.assert_allclose(own[2:], [want[k]] * 2, atol=1e-3)
        total = physio.hrv_from_sequences(df, ["signal_id"], "sdnn", f_s, min_dets=2, min_t=0.5, correct=correct).first()["value"]
        assert abs(total - (53.0593762 if correct else 53.0721198)) < 1e-5


def test_variability_metrics_differ_over_runs(spark):
    rng = np.random.default_rng(0)
    t = np.cumsum(0.8 + 0.05 * np.sin(np.arange(120) / 3) + 0.02 * rng.normal(size=120))
    df = spark.createDataFrame([(1, int(k >= 60), float(x)) for k, x in enumerate(t)], "signal_id long, seq_id int, t double")
    got = {m: physio.hrv_from_sequences(df, ["signal_id"], m, correct=False).first()["value"] for m in ("sdnn", "rmssd", "lf", "hf", "lfhf")}
    assert len(set(got.values())) == 5 and all(math.isfinite(v) for v in got.values())
    pooled = physio.hrv_from_sequences(df, ["signal_id"], "lf", correct=False, weighted=False).first()["value"]
    assert math.isfinite(pooled)
    with pytest.raises(ValueError):
        physio.hrv_from_sequences(df, ["signal_id"], "nonsense")


def test_detection_golden_with_skipped_beats(spark):
    idx = [202, 392, 601, 799, 1201, 1403, 1610, 1839]
    df = spark.createDataFrame([(1, i / 30) for i in idx], "signal_id long, t double")
    got = physio.hrv_from_detections(df, ["signal_id"], "sdnn", 30, min_dets=5, min_t=1.0, interp_skipped=True).first()["value"]
    assert abs(got - 200) < 0.1


def test_rolling_rates(spark):
    times = lambda t: spark.createDataFrame([(1, float(x)) for x in t], "signal_id long, t double")
    by = lambda df: [r["rate"] for r in df.orderBy("t").collect()]
    assert by(physio.rolling_rate(times([0, 1, 2, 3, 7]), ["signal_id"], 0, 100, unit="seconds"))[-1] == 60
    assert math.isnan(by(physio.rolling_rate(times([0, 1, 1, 2]), ["signal_id"], 4, 4))[-1])
    assert math.isnan(by(physio.rolling_rate_by_detections(times([0, 1, 1, 2]), ["signal_id"], 4))[-1])
    ramp = np.cumsum(np.r_[0, 60 / np.linspace(60, 90, 30)])
    for kw in ({"least": 6, "most": 6, "overlap": 5}, {"least": 3.0, "most": 3.0, "unit": "seconds"}):
        r = [x for x in by(physio.rolling_rate(times(ramp), ["signal_id"], interp_skipped=True, **kw)) if math.isfinite(x)]
        assert r and all(b >= a - 1e-6 for a, b in zip(r, r[1:], strict=False)) and r[-1] - r[0] > 20
    with pytest.raises(ValueError):
        physio.rolling_rate(times([0, 1]), ["signal_id"], 2, 4, overlap=3)


def test_region_without_method_is_the_box(spark):
    b = roi.box(*map(F.lit, (100, 100, 181, 220)))
    row = lambda c: tuple(spark.range(1).select(c.alias("r")).first()["r"])
    assert row(roi.roi_from_det(b, None)) == (100, 100, 181, 220)
    assert row(roi.roi_from_det(b, None, even=True)) == (100, 100, 180, 220)
    with pytest.raises(ValueError):
        roi.roi_from_det(b, "meta")


def test_front_door_of_frames(spark):
    f = spark.createDataFrame([("a", k, 4, 6, 3, bytes(range(72))) for k in range(10)], "path string, frame int, h int, w int, c int, data binary")
    assert [r.frame for r in media.parse_frames(f, ds_factor=3, trim=(1, 9)).orderBy("frame").collect()] == [1, 4, 7]
    out = media.parse_frames(f, fps=30.0, target_fps=15.0, roi=(0, 0, 4, 4), size=(2, 2)).first()
    assert (out.h, out.w, len(out.data)) == (2, 2, 12)
    for bad in ({"target_fps": 5.0, "ds_factor": 2, "fps": 30.0}, {"target_fps": 5.0}, {"idxs": [0], "trim": (0, 2)}):
        with pytest.raises(ValueError):
            media.parse_frames(f, **bad)
    det = image.crop_resize_from_det(f, roi.box(*map(F.lit, (1, 1, 4, 3))), (36, 36), "face", "bicubic").first()
    assert (det.h, det.w, det.c) == (36, 36, 3)
    assert media.probe_frames(f, 30.0).first()["issues"] is False


def test_a_region_outside_the_frame_is_an_error(spark):
    px = media.test_frames(spark, 1, 4, 4)
    rois = spark.createDataFrame([(0, 0, 0, 5, 2)], "frame int, x0 int, y0 int, x1 int, y1 int")
    with pytest.raises(Exception, match="inside the frame"):
        image.roi_mean(px, rois, ["frame"], size=(4, 4)).collect()
