"""Golden values and closed forms of the NumPy kernels."""

import numpy as np
import pytest

from pulsegrid.functions import kernels as K


def test_detrend_golden():
    got = K.detrend(np.array([0, 0.4, 1.2, 2, 0.2]), 3)
    np.testing.assert_allclose(got, [-0.29326743, -0.18156859, 0.36271552, 0.99234445, -0.88022395], rtol=1e-6)


@pytest.mark.parametrize("n", [3, 4, 5, 9, 40])
def test_detrend_solves_the_dense_system(n):
    z, lam = np.random.default_rng(n).normal(size=n), 4.0
    d = np.diff(np.eye(n), 2, axis=0)
    np.testing.assert_allclose(K.detrend(z, lam), z - np.linalg.solve(np.eye(n) + lam**2 * d.T @ d, z), atol=1e-9)


def test_detrend_response():
    assert abs(K.detrend_response(800, 300, 4) - 0.043) < 0.01


def test_periodogram_finds_sines():
    t = np.arange(500) / 30
    for f in (0.7, 1.3, 2.9):
        assert abs(K.peak_frequency(np.sin(2 * np.pi * f * t), 30.0, (0.5, 4), 0.05) - f) <= 0.06


def test_fill_missing():
    x = np.array([np.nan, 0, 0.2, np.nan, np.nan, 0.4, 1.2, 3.1])
    np.testing.assert_allclose(K.fill_missing(x), [0, 0, 0.2, 0.266667, 0.333333, 0.4, 1.2, 3.1], atol=1e-6)


def test_repair_sequence():
    np.testing.assert_allclose(K.repair_sequence(np.array([1, 4, 14, 12, 16.0])), [1, 4, 8, 12, 16])


def test_repair_outliers():
    x = np.r_[np.ones(10) + 0.01 * np.arange(10), 1000, np.ones(10)]
    got = K.repair_outliers(x, 3)
    assert got.max() < 1.2 and np.allclose(got[:10], x[:10])


def test_bandpass_is_zero_phase():
    t = np.arange(400) / 32
    x = np.sin(2 * np.pi * 3 * t) + 2
    b, a = K.butter_bandpass(1, 8, 32, 2)
    np.testing.assert_allclose(K.filtfilt(b, a, x)[80:-80], (x - 2)[80:-80], atol=0.03)


def test_butterworth_half_power():
    b, a = K.butter_bandpass(1, 8, 32, 3)
    z = np.exp(2j * np.pi * np.array([1, 8]) / 32)
    np.testing.assert_allclose(np.abs(np.polyval(b, z) / np.polyval(a, z)), np.sqrt(0.5), rtol=1e-6)


def test_pchip_is_monotone_and_exact():
    x, y = np.array([0, 1, 2, 4.0]), np.array([0, 1, 1, 5.0])
    got = K.pchip(x, y, np.linspace(0, 4, 41))
    assert (np.diff(got) >= -1e-12).all() and np.allclose(K.pchip(x, y, x), y) and np.isnan(K.pchip(x, y, np.array([5.0]))).all()


def test_lf_hf_of_a_modulated_series():
    t, beats = 0.0, []
    while t < 300:
        beats.append(1 + 0.05 * np.sin(2 * np.pi * 0.1 * t))
        t += beats[-1]
    lf, hf = K.lf_hf(np.array(beats))
    assert lf > 20 * hf and abs(lf - 0.05**2 / 2 * 1e6) < 400


def test_find_peaks():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0, 5, 0.0])
    assert K.find_peaks(x).tolist() == [1, 3, 6, 8]
    assert K.find_peaks(x, height=2).tolist() == [1, 3, 8]
    assert K.find_peaks(x, distance=4).tolist() == [3, 8]
    assert K.find_peaks(x, prominence=2.5).tolist() == [3, 8]


def test_valid_peaks_split_by_a_missing_beat():
    t = np.arange(250 * 20) / 250
    beats = np.arange(0.5, 20, 60 / 72)
    pulse = lambda bs: sum(np.exp(-(((t - b) / 0.03) ** 2)) for b in bs)
    assert len(K.valid_peaks(pulse(beats), 250, 2500, (0.67, 4))[0]) == 1
    assert len(K.valid_peaks(pulse(np.delete(beats, 10)), 250, 2500, (0.67, 4))[0]) == 2
    assert K.valid_peaks(np.zeros(2500), 250, 2500, (0.67, 4))[0] == []


def test_bilinear_golden():
    im = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 0]]], np.uint8)
    out = K.bilinear(im, 3, 3)
    assert np.abs(out[0, 1].astype(int) - [127, 127, 0]).max() <= 1 and np.abs(out[1, 1].astype(int) - [127, 127, 63]).max() <= 1
    assert K.bilinear(np.array([[[0]], [[85]], [[170]], [[255]]], np.uint8), 2, 1).ravel().tolist() == [42, 212]


def test_box():
    im = np.kron(np.array([[1, 2], [3, 4]]), np.ones((2, 2)))[..., None].astype(np.uint8)
    assert K.box(im, 2, 2)[..., 0].tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        K.box(im, 3, 3)


def test_resize_shapes():
    im = np.random.default_rng(0).integers(0, 256, (10, 20, 3)).astype(np.uint8)
    for how in ("auto", "bilinear", "box", "bicubic", "nearest"):
        assert K.resize(im, 4, 8, how).shape == (4, 8, 3)
    assert K.resize(im, 10, 20) is im


@pytest.mark.parametrize("algorithm", ["bicubic", "lanczos3", "bilinear_wide", "area", "nearest"])
def test_resize_keeps_a_flat_image(algorithm):
    im = np.full((7, 9, 3), 131, np.uint8)
    for h, w in ((3, 4), (14, 20), (1, 1)):
        out = K.resize(im, h, w, algorithm)
        assert out.shape == (h, w, 3) and (out == 131).all()


def test_area_is_the_mean_of_whole_boxes():
    im = np.random.default_rng(0).integers(0, 256, (6, 8, 1), np.uint8)
    want = im.reshape(3, 2, 4, 2, 1).mean((1, 3))
    assert np.abs(K.resize(im, 3, 4, "area") - want).max() <= 0.5


def test_filters_interpolate_at_whole_positions():
    im = np.arange(0, 250, 10, dtype=np.uint8).reshape(5, 5, 1)
    for algorithm in ("bicubic", "lanczos3"):
        out = K.separable(im, 15, 15, algorithm)
        assert (out[1::3, 1::3] == im).all()
