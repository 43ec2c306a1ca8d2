"""NumPy kernels for the maths that is sequential or spectral."""

from __future__ import annotations

import numpy as np


def periodogram(x: np.ndarray, f_s: float, f_res: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power of the last axis; a wanted resolution pads or truncates the input."""
    n = x.shape[-1] if f_res is None else int(f_s // f_res)
    p = np.abs(np.fft.rfft(x[..., : min(n, x.shape[-1])], n=n, axis=-1)) ** 2
    p[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / f_s), p / (f_s * min(n, x.shape[-1]))


def band_mask(freqs: np.ndarray, f_range) -> np.ndarray:
    if f_range is None:
        return np.ones(len(freqs), bool)
    lo, hi = min(f_range[0], freqs[-1]), max(f_range[1], freqs[0])
    return (freqs >= lo) & (freqs <= hi)


def peak_frequency(x: np.ndarray, f_s: float, f_range=None, f_res: float | None = None, method: str = "periodogram") -> float:
    """Frequency of most power in the band."""
    if method == "periodogram":
        f, p = periodogram(x, f_s, f_res)
    elif method == "fft":
        f, p = np.fft.rfftfreq(len(x), 1 / f_s), np.abs(np.fft.rfft(x))
    else:
        raise ValueError(f"unknown method {method!r}")
    return float(f[np.argmax(np.where(band_mask(f, f_range), p, 0))])


def detrend(z: np.ndarray, lam: float) -> np.ndarray:
    """Smoothness-priors detrending: z - (I + lam^2 D'D)^-1 z, solved in its five diagonals."""
    z = np.nan_to_num(np.asarray(z, float))
    n = len(z)
    if n < 3:
        return z
    return z - _solve_penta(n, lam * lam, z)


def _solve_penta(n: int, w: float, z: np.ndarray) -> np.ndarray:
    main, one, two = np.full(n, 6.0), np.full(n - 1, -4.0), np.full(n - 2, 1.0)
    main[[0, -1]], main[[1, -2]] = 1, 5
    if n == 3:
        main[1] = 4
    one[[0, -1]] = -2
    main, one, two = 1 + w * main, w * one, w * two
    # symmetric L D L' with two subdiagonals
    d, l1, l2, y = main.copy(), np.zeros(n), np.zeros(n), z.astype(float).copy()
    for i in range(n):
        if i >= 1:
            l1[i] = one[i - 1] / d[i - 1]
        if i >= 2:
            l2[i] = two[i - 2] / d[i - 2]
            l1[i] = (one[i - 1] - l2[i] * d[i - 2] * l1[i - 1]) / d[i - 1]
            d[i] -= l2[i] ** 2 * d[i - 2]
            y[i] -= l2[i] * y[i - 2]
        if i >= 1:
            d[i] -= l1[i] ** 2 * d[i - 1]
            y[i] -= l1[i] * y[i - 1]
    x = y / d
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i + 1] * x[i + 1] + (l2[i + 2] * x[i + 2] if i + 2 < n else 0)
    return x


def detrend_response(size: int, lam: float, f_s: float) -> float:
    """First frequency at which the detrending filter passes more than 0.64."""
    unit = np.zeros(size)
    unit[size // 2] = 1
    h = np.abs(np.fft.rfft(unit - _solve_penta(size, lam * lam, unit)))
    return float(np.fft.rfftfreq(size, 1 / f_s)[np.argmax(h > 0.64)])


def butter_bandpass(low: float, high: float, f_s: float, order: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth band-pass coefficients: prototype poles, band transform, bilinear map."""
    w1, w2 = (2 * f_s * np.tan(np.pi * f / f_s) for f in (low, high))
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    half = bw / 2 * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    root = np.sqrt(half**2 - w0**2)
    poles = np.r_[half + root, half - root]
    z = np.r_[np.ones(order), -np.ones(order)]
    p = (2 * f_s + poles) / (2 * f_s - poles)
    gain = np.real(bw**order * (2 * f_s) ** order / np.prod(2 * f_s - poles))
    return gain * np.real(np.poly(z)), np.real(np.poly(p))


def _filter(b, a, x, zi):
    y, z = np.empty(len(x)), np.r_[zi, 0.0]
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:] * v - a[1:] * y[i]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter with odd padding of three times the filter length."""
    n = max(len(a), len(b))
    pad = 3 * n
    if len(x) <= pad:
        raise ValueError("the signal is shorter than the padding of the filter")
    companion = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 1)[:-1]]).T if n > 2 else np.array([[1 + a[1]]])
    zi = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    y = _filter(b, a, ext, zi * ext[0])[::-1]
    return _filter(b, a, y, zi * y[0])[::-1][pad:-pad]


def fill_missing(x: np.ndarray) -> np.ndarray:
    """Linear interpolation of NaN by index; edges take the nearest value; all NaN stays."""
    ok = ~np.isnan(x)
    return x if ok.all() or not ok.any() else np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok])


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (harmonic-mean slopes); NaN outside."""
    if len(x) == 1:
        return np.where(at == x[0], y[0], np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.empty(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
        m[1:-1] = np.where(d[:-1] * d[1:] > 0, inner, 0)
        for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[k] = 0 if np.sign(e) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0) else e
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[i]) / h[i]
    out = (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Median slope and intercept: a robust line, the same on every run (8 bytes a pair of samples)."""
    n, at = len(x), 0
    slopes = np.empty(n * (n - 1) // 2)
    for k in range(1, n):
        slopes[at : at + n - k] = (y[k:] - y[:-k]) / (x[k:] - x[:-k])
        at += n - k
    slope = float(np.median(slopes, overwrite_input=True))
    return slope, float(np.median(y - slope * x))


def _lin(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation that extrapolates."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    return y[i] + (at - x[i]) * (y[i + 1] - y[i]) / (x[i + 1] - x[i])


def repair_sequence(t: np.ndarray, max_diff_rel: float = 1.0, max_diff_abs: float | None = None) -> np.ndarray:
    """Replace outliers of a nearly linear increasing sequence, until it strictly increases."""
    i, t = np.arange(len(t), dtype=float), np.asarray(t, float)
    if len(t) < 3:
        return t
    slope, base = theil_sen(i, t)
    most = max_diff_abs if max_diff_abs is not None else abs(max_diff_rel * slope)
    ok = np.abs(t - (base + slope * i)) < most
    if ok.sum() < 2:
        return base + slope * i
    t = np.where(ok, t, _lin(i[ok], t[ok], i))
    for _ in range(len(t)):
        rise = np.diff(t) > 0
        if rise.all():
            break
        ok = np.r_[True, rise]
        t = np.where(ok, t, _lin(i[ok], t[ok], i)) if ok.sum() > 1 else base + slope * i
    return t


def repair_outliers(x: np.ndarray, z: float = 3.0) -> np.ndarray:
    """Repeatedly replace values beyond ``z`` deviations by linear interpolation."""
    x = np.asarray(x, float).copy()
    for _ in range(len(x) + 1):
        sd = x.std()
        bad = np.abs(x - x.mean()) > z * sd if sd > 0 else np.zeros(len(x), bool)
        if not bad.any() or bad.all():
            break
        i, ok = np.arange(len(x), dtype=float), ~bad
        new = np.where(ok, x, _lin(i[ok], x[ok], i))
        for k in (0, -1):
            if bad[k] and abs(new[k] - x[ok].mean()) > z * max(x[ok].std(), 1e-300):
                new[k] = x[ok].mean()
        x = new
    return x


def welch(x: np.ndarray, f_s: float, seg: int, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean power density of half-overlapping, linearly detrended Hann segments."""
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    k, total, count = np.arange(seg), 0, 0
    for s in range(0, len(x) - seg + 1, max(1, seg - seg // 2)):
        part = x[s : s + seg]
        part = (part - np.polyval(np.polyfit(k, part, 1), k)) * win if seg > 1 else part * 0
        total, count = total + np.abs(np.fft.rfft(part, nfft)) ** 2, count + 1
    p = total / count / (f_s * (win**2).sum())
    p[1 : -1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / f_s), p


def lf_hf(diffs: np.ndarray) -> tuple[float, float]:
    """Low- and high-frequency power (ms^2) of beat intervals in seconds."""
    t = np.cumsum(diffs)
    at = np.arange(0, t[-1], 0.25)
    if len(at) < 2:
        return np.nan, np.nan
    seg = min(len(at), 256)
    f, p = welch(np.interp(at, t, diffs), 4.0, seg, 2 ** int(np.ceil(np.log2(max(seg, 400)))))
    lo, hi = (f >= 0.04) & (f < 0.15), (f >= 0.15) & (f <= 0.40)
    return tuple(float(np.trapezoid(p[m], f[m]) * 1e6) for m in (lo, hi))


def fill_skipped(d: np.ndarray, threshold: float = 0.3) -> np.ndarray:
    """Intervals that leave the median by more than a share of it give way to their neighbours' line."""
    if not len(d):
        return d
    ok = np.abs(d - np.median(d)) <= threshold * np.median(d)
    return np.interp(np.arange(len(d)), np.flatnonzero(ok), d[ok]) if ok.any() else d


def rate_of_times(t: np.ndarray, skipped: bool = False) -> float:
    """60 / median interval; NaN below two times or with an interval of zero."""
    d = np.diff(t)
    d = fill_skipped(d) if skipped else d
    return float(60 / np.median(d)) if len(d) and (d != 0).all() else np.nan


def variability(d: np.ndarray, metric: str, err: float, limits: dict) -> float:
    """Of intervals in seconds, less the quantisation error ``err``, clipped to ``limits[metric]``."""
    if metric == "sdnn":
        v = np.sqrt(max(np.var(d) - err, 0.0)) * 1000 if np.var(d) >= err else np.nan
    elif metric == "rmssd":
        m = np.mean(np.diff(d) ** 2) - 2 * err if len(d) > 1 else np.nan
        v = np.sqrt(m) * 1000 if m >= 0 else np.nan
    elif metric in ("lf", "hf", "lfhf"):
        lf, hf = (np.clip(p, *limits[k]) for p, k in zip(lf_hf(d), ("lf", "hf"), strict=True))
        v = {"lf": lf, "hf": hf, "lfhf": lf / hf if hf > 0 else np.nan}[metric]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return float(np.clip(v, *limits[metric]))


def variability_of_times(t: np.ndarray, metric: str, limits: dict, err: float = 0.0, least: int = 8, min_t: float = 10.0, skipped: bool = False) -> float:
    """NaN below ``least`` times or ``min_t`` seconds, or with an interval of zero."""
    d = np.diff(t)
    d = fill_skipped(d) if skipped else d
    if len(d) < 1 or len(t) < least or t[-1] - t[0] < min_t or (d == 0).any():
        return np.nan
    return variability(d, metric, err, limits)


def rolling_count(x: np.ndarray, fn, least: int, most: int, overlap: int | None = None, transform=None, fill: str = "pad", pad: float = np.nan) -> np.ndarray:
    """``fn`` of windows of ``most`` values, a value per sample; the first windows may hold only ``least``.

    Windows start every ``most - overlap`` values. overlap = most - 1 gives each sample the
    window that ends there; 0 repeats a window's value; else the windows that cover a sample are
    averaged (exact zeros don't count). Fewer values than ``least`` give ``pad``.
    """
    n, overlap = len(x), most - 1 if overlap is None else overlap
    if not 0 <= overlap < most or least > most:
        raise ValueError("needs 0 <= overlap < most and least <= most")
    if n < least:
        return np.full(n, pad)
    step, front = most - overlap, most - least
    count = -(-(n - least) // step) + 1
    cut = [x[max(0, k * step - front) : max(0, k * step - front + most)] for k in range(count)]
    values = np.array([fn(transform(w) if transform else w) for w in cut], float)
    if overlap == most - 1:
        start = {"pad": pad, "mean": values.mean(), "start": values[0]}[fill]
        return np.r_[np.full(least - 1, start), values]
    first = np.arange(count) * step - front
    if overlap == 0:
        return np.repeat(values, most)[front : front + n]
    total, used = np.zeros(n), np.zeros(n)
    for a, v in zip(first, values, strict=True):
        total[max(0, a) : max(0, a + most)] += v
        used[max(0, a) : max(0, a + most)] += v != 0
    return total / np.maximum(used, 1)


def rolling_span(t: np.ndarray, fn, least: float, most: float, pad: float = np.nan) -> np.ndarray:
    """``fn`` of the times in (t - most, t], a value per time; times below ``least`` give ``pad``."""
    if least < 0 or most < least:
        raise ValueError("needs 0 <= least <= most")
    left = np.searchsorted(t, t - most, side="right")
    return np.array([fn(t[a : k + 1]) if t[k] >= least else pad for k, a in enumerate(left)], float)


def find_peaks(x: np.ndarray, height=None, distance: float | None = None, prominence=None) -> np.ndarray:
    """Strict local maxima (middle of plateaus), by height, then distance (highest first), then prominence."""
    i, peaks = 1, []
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    p = np.array(peaks, int)
    if height is not None:
        p = p[x[p] >= height]
    if distance is not None and len(p):
        least, keep = int(np.ceil(distance)), np.ones(len(p), bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(p - p[k]) < least
                near[k] = False
                keep &= ~near
        p = p[keep]
    if prominence is not None and len(p):
        p = p[np.array([_prominence(x, k) for k in p]) >= prominence]
    return p


def _prominence(x: np.ndarray, k: int) -> float:
    higher = np.flatnonzero(x > x[k])
    left, right = higher[higher < k], higher[higher > k]
    lo = x[(left[-1] if len(left) else 0) : k + 1].min()
    hi = x[k : (right[0] if len(right) else len(x) - 1) + 1].min()
    return x[k] - max(lo, hi)


def rolling_frequency(x: np.ndarray, f_s: float, window: int, f_range=None, f_res: float | None = None) -> np.ndarray:
    """Peak frequency of the trailing half-overlapping windows that cover each sample, averaged."""
    if len(x) < window:
        return np.full(len(x), peak_frequency(x, f_s, f_range, f_res))
    step, total, count = max(1, window - window // 2), np.zeros(len(x)), np.zeros(len(x))
    for s in [*range(0, len(x) - window, step), len(x) - window]:
        total[s : s + window] += peak_frequency(x[s : s + window] - x[s : s + window].mean(), f_s, f_range, f_res)
        count[s : s + window] += 1
    return total / count


def valid_peaks(x: np.ndarray, f_s: float, window: int, f_range, tol=(0.4, 0.8), min_det: int = 1, refine: float | None = None, height: float | None = 0.0, prominence: float | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of peaks whose intervals fit the rolling reference frequency, and the validity of samples.

    Peaks can be asked for by height and prominence, and moved to the highest sample within ``refine`` seconds.
    """
    none = [], np.zeros(len(x))
    freq = rolling_frequency(x, f_s, window, f_range)
    top = np.quantile(freq, 0.9)
    if top <= 0:
        return none
    p = find_peaks(x, height, max(1.0, f_s / top * (1 - tol[0])), prominence)
    if not len(p):
        return none
    w = int((refine or 0) * f_s)
    if w > 1:
        p = np.unique([int(np.argmax(x[max(0, k - w // 2) : k + w // 2])) + max(0, k - w // 2) for k in p])
    if len(p) == 1:
        return [p], np.ones(len(x))
    gap = np.diff(p) / f_s
    gap, ref = np.r_[gap[0], gap], 1 / np.maximum(freq[p], 1e-12)
    ok = ((1 - tol[0]) * ref < gap) & (gap < (1 + tol[1]) * ref)
    edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(int)))
    runs, valid = [], np.zeros(len(x))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        valid[p[a] : p[b - 1]] = 1
        if b - 1 - a >= min_det:
            runs.append(p[a:b])
    return runs, valid


def bilinear(im: np.ndarray, h: int, w: int) -> np.ndarray:
    """Half-pixel bilinear resize of (h, w, c) bytes in 8-bit fixed point."""
    if 0 in (*im.shape, h, w):
        return np.zeros((h, w, im.shape[2]), np.uint8)

    def axis(src: int, dst: int):
        at = np.clip((np.arange(dst, dtype=np.float32) + np.float32(0.5)) * np.float32(src / dst) - np.float32(0.5), 0, src - 1)
        lo = at.astype(int)
        return lo, np.minimum(lo + 1, src - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(im.shape[0], h), axis(im.shape[1], w)
    total = 0
    for ys, wy in ((y0, 1 - fy), (y1, fy)):
        for xs, wx in ((x0, 1 - fx), (x1, fx)):
            total = total + im[ys[:, None], xs[None, :]].astype(np.int64) * (wy[:, None] * wx[None, :] * 256).astype(np.int64)[..., None]
    return (total >> 8).astype(np.uint8)


def box(im: np.ndarray, h: int, w: int) -> np.ndarray:
    """Truncated mean of source boxes; both sides must shrink at least twofold."""
    if im.shape[0] < 2 * h or im.shape[1] < 2 * w:
        raise ValueError("box resampling needs a ratio of at least 2")
    ys, xs = ((np.arange(d + 1) * s + d // 2) // d for s, d in ((im.shape[0], h), (im.shape[1], w)))
    total = np.add.reduceat(np.add.reduceat(im.astype(np.int64), ys[:-1], 0), xs[:-1], 1)
    return (total // (np.diff(ys)[:, None] * np.diff(xs)[None, :])[..., None]).astype(np.uint8)


def _cubic(d: np.ndarray) -> np.ndarray:
    return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))


#: Weight of a source pixel by its distance from the place of the new one.
FILTERS = {
    "bicubic": _cubic,
    "lanczos3": lambda d: np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0),
    "bilinear_wide": lambda d: np.maximum(1 - d, 0),
}


def _filter_axis(src: int, dst: int, weight) -> np.ndarray:
    """Weights (dst, src) of a filter, widened when shrinking."""
    s = max(1.0, src / dst)
    k = weight(np.abs((np.arange(src)[None, :] + 0.5 - (np.arange(dst)[:, None] + 0.5) * src / dst) / s))
    return k / k.sum(1, keepdims=True)


def _area_axis(src: int, dst: int) -> np.ndarray:
    """Weights (dst, src) by the share of each new pixel that a source pixel covers."""
    edge = np.arange(dst + 1)[:, None] * src / dst
    at = np.arange(src)[None, :]
    cover = np.clip(np.minimum(edge[1:], at + 1) - np.maximum(edge[:-1], at), 0, None)
    return cover * dst / src


def separable(im: np.ndarray, h: int, w: int, algorithm: str) -> np.ndarray:
    """Resize by weights along either axis: a filter of ``FILTERS``, or area."""
    if 0 in (*im.shape, h, w):
        return np.zeros((h, w, im.shape[2]), np.uint8)
    axes = [_area_axis(s, d) if algorithm == "area" else _filter_axis(s, d, FILTERS[algorithm]) for s, d in ((im.shape[0], h), (im.shape[1], w))]
    out = np.einsum("xt,ytc->yxc", axes[1], np.einsum("ys,stc->ytc", axes[0], im.astype(float)))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def nearest(im: np.ndarray, h: int, w: int) -> np.ndarray:
    return im[((np.arange(h) + 0.5) * im.shape[0] / h).astype(int)[:, None], ((np.arange(w) + 0.5) * im.shape[1] / w).astype(int)[None, :]]


def resize(im: np.ndarray, h: int, w: int, algorithm: str = "auto") -> np.ndarray:
    """``auto`` takes box if both sides shrink more than twofold, else bilinear; nothing if the size fits."""
    if im.shape[:2] == (h, w):
        return im
    if algorithm == "auto":
        algorithm = "box" if im.shape[0] > 2 * h and im.shape[1] > 2 * w else "bilinear"
    if algorithm == "area" or algorithm in FILTERS:
        return separable(im, h, w, algorithm)
    return {"box": box, "bilinear": bilinear, "nearest": nearest}[algorithm](im, h, w)
