"""Numpy signal functions used inside Arrow batches: spectra, filters, levels, edges, eye, jitter."""

from __future__ import annotations

import math

import numpy as np

# ---- windows and spectra ---------------------------------------------------------------------

#: Cosine-sum window coefficients.
COSINE_SUMS = {
    "rectangular": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def window(name: str, n: int, beta: float = 8.6, periodic: bool = False) -> np.ndarray:
    if name == "bartlett":
        return np.bartlett(n)
    if name == "kaiser":
        return np.kaiser(n, beta)
    t = 2 * np.pi * np.arange(n) / max(n if periodic else n - 1, 1)
    return sum(((-1) ** k) * a * np.cos(k * t) for k, a in enumerate(COSINE_SUMS[name])) * np.ones(n)


def spectrum(x: np.ndarray, fs: float, name: str = "hann", nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and single-sided amplitudes (a sine of amplitude A peaks at A), mean removed."""
    n = len(x)
    w = window(name, n)
    nfft = nfft or n
    mag = np.abs(np.fft.rfft((x - x.mean()) * w, nfft)) / (n * w.mean())
    mag[1 : None if nfft % 2 else -1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), mag


def welch(x: np.ndarray, fs: float, nperseg: int | None = None, overlap: float = 0.5, name: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density averaged over overlapping, mean-removed segments."""
    n = min(len(x), nperseg or max(256, len(x) // 8))
    step = max(1, int(n * (1 - overlap)))
    w = window(name, n, periodic=True)
    segs = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    p = (np.abs(np.fft.rfft((segs - segs.mean(1, keepdims=True)) * w, axis=1)) ** 2).mean(0) / (fs * (w**2).sum())
    p[1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def spectrogram(x: np.ndarray, fs: float, nperseg: int = 256, overlap: float = 7 / 8, name: str = "hann"):
    n = min(len(x), nperseg)
    step = max(1, n - int(n * overlap))
    segs = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    return np.fft.rfftfreq(n, 1 / fs), (np.arange(len(segs)) * step + n / 2) / fs, np.abs(np.fft.rfft(segs * window(name, n, periodic=True), axis=1)) ** 2


def harmonics(x: np.ndarray, fs: float, count: int = 10) -> dict[str, float]:
    """Fundamental, THD (% of the fundamental), SNR, SINAD (dB), ENOB and SFDR (dB) from one spectrum."""
    f, mag = spectrum(x, fs)
    p = mag**2
    p[:2] = 0
    k = int(p.argmax())
    if p[k] <= 0:
        return {"fundamental": 0.0, "thd": math.nan, "snr": math.nan, "sinad": math.nan, "enob": math.nan, "sfdr": math.nan}
    band = lambda c: slice(max(c - 1, 0), min(c + 2, len(p)))
    signal = p[band(k)].sum()
    at = [h * k for h in range(2, count + 1) if h * k < len(p)]
    harm = sum(p[band(h)].max() for h in at)
    used = np.zeros(len(p), bool)
    for h in [k, *at]:
        used[band(h)] = True
    noise, rest = p[~used].sum(), p.sum() - signal
    spur = p.copy()
    spur[max(0, k - 5) : k + 6] = 0
    db = lambda a, b: 10 * math.log10(a / b) if b > 0 else math.inf
    sinad = db(signal, rest)
    return {"fundamental": float(f[k]), "thd": 100 * math.sqrt(harm / p[k]), "snr": db(signal, noise), "sinad": sinad, "enob": (sinad - 1.76) / 6.02, "sfdr": db(p[k], spur.max())}


def analytic(x: np.ndarray) -> np.ndarray:
    """Signal + i Hilbert transform; abs is the envelope, angle the phase."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def haar(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """Haar wavelet: approximation, then details from coarse to fine; odd tails repeat their last sample."""
    out, a = [], x.astype(float)
    for _ in range(levels):
        if len(a) < 2:
            break
        a = np.append(a, a[-1]) if len(a) % 2 else a
        out.append((a[0::2] - a[1::2]) / math.sqrt(2))
        a = (a[0::2] + a[1::2]) / math.sqrt(2)
    return [a, *out[::-1]]


def inverse_haar(parts: list[np.ndarray]) -> np.ndarray:
    a = parts[0]
    for d in parts[1:]:
        a = a[: len(d)]
        up = np.empty(2 * len(d))
        up[0::2], up[1::2] = (a + d) / math.sqrt(2), (a - d) / math.sqrt(2)
        a = up
    return a


def morlet(x: np.ndarray, scales: np.ndarray, w0: float = 6.0) -> np.ndarray:
    """Continuous wavelet transform with the Morlet wavelet, by FFT."""
    n = len(x)
    omega = 2 * np.pi * np.fft.fftfreq(n)
    spec = np.fft.fft(x - x.mean())
    return np.array([np.fft.ifft(spec * np.pi**-0.25 * np.sqrt(s) * np.exp(-0.5 * (s * omega - w0) ** 2) * (omega > 0)) for s in scales])


def mel_cepstrum(x: np.ndarray, fs: float, coefficients: int = 13, filters: int = 26, nfft: int = 512, hop: int = 160) -> np.ndarray:
    """MFCC: power spectra of Hamming frames, triangular mel filters, log, orthonormal DCT-II."""
    size = min(nfft, len(x))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    power = np.abs(np.fft.rfft(frames * window("hamming", size), nfft, axis=1)) ** 2 / nfft
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(fs / 2), filters + 2) / 2595) - 1)
    f = np.fft.rfftfreq(nfft, 1 / fs)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)
    logs = np.log(np.maximum(power @ bank.T, 1e-20))
    k = np.arange(coefficients)[:, None]
    dct = np.sqrt(2 / filters) * np.cos(np.pi * k * (np.arange(filters) + 0.5) / filters)
    dct[0] /= math.sqrt(2)
    return logs @ dct.T


# ---- filters ---------------------------------------------------------------------------------


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str = "low") -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a digital Butterworth filter (bilinear transform, prewarped)."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind in ("low", "high"):
        w = warp(cutoff)
        p = w * poles if kind == "low" else w / poles
        z = np.zeros(0 if kind == "low" else order)
        gain = w**order if kind == "low" else 1.0
    else:
        a, b = warp(cutoff[0]), warp(cutoff[1])
        bw, w0 = b - a, math.sqrt(a * b)
        half = poles * bw / 2 if kind == "band" else bw / 2 / poles
        root = np.sqrt(half**2 - w0**2 + 0j)
        p = np.concatenate((half + root, half - root))
        z = np.zeros(order) if kind == "band" else np.concatenate((np.full(order, 1j * w0), np.full(order, -1j * w0)))
        gain = bw**order if kind == "band" else 1.0
    k = 2 * fs
    pz, zz = (k + p) / (k - p), (k + z) / (k - z)
    gain = gain * np.prod(k - z) / np.prod(k - p)
    zz = np.concatenate((zz, -np.ones(len(p) - len(z))))

    def grouped(roots: np.ndarray) -> list[list[complex]]:
        """Conjugate pairs, then real roots two by two."""
        upper = sorted((r for r in roots if r.imag > 1e-9), key=lambda r: (r.real, r.imag))
        real = sorted(r.real for r in roots if abs(r.imag) <= 1e-9)
        return [[r, r.conjugate()] for r in upper] + [real[k : k + 2] for k in range(0, len(real), 2)]

    out = [(np.real(np.poly(b)), np.real(np.poly(a))) for b, a in zip(grouped(zz.astype(complex)), grouped(pz.astype(complex)), strict=True)]
    b0, a0 = out[0]
    out[0] = (b0 * np.real(gain), a0)
    return out


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed recurrence, started in the steady state of the first sample."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    gain = b.sum() / a.sum() if abs(a.sum()) > 1e-300 else 0.0
    z = [0.0] * n
    for i in range(n - 1, 0, -1):
        z[i - 1] = (b[i] - a[i] * gain) * float(x[0]) + z[i]
    out, bl, al = np.empty(len(x)), b.tolist(), a.tolist()
    for t, v in enumerate(x.tolist()):
        y = bl[0] * v + z[0]
        for i in range(1, n):
            z[i - 1] = bl[i] * v - al[i] * y + z[i]
        out[t] = y
    return out


def zero_phase(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Filter forward and backward with odd reflections at the ends."""
    pad = min(len(x) - 1, 3 * 3 * len(sections))
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad > 0 else x
    for _ in range(2):
        for b, a in sections:
            y = iir(b, a, y)
        y = y[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def notch(f0: float, q: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    w = 2 * np.pi * f0 / fs
    g = 1 / (1 + math.tan(w / q / 2))
    return [(g * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * g * math.cos(w), 2 * g - 1]))]


def savgol(x: np.ndarray, size: int, degree: int) -> np.ndarray:
    """Least-squares smoothing; the ends are read off the polynomial of the first and last window."""
    h = size // 2
    design = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    fit = np.linalg.pinv(design)
    mid = np.convolve(x, fit[0][::-1], "valid")
    return np.concatenate((design[:h] @ (fit @ x[:size]), mid, design[h + 1 :] @ (fit @ x[-size:])))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, "symmetric"), k / k.sum(), "valid")


def matched(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    t = template - template.mean()
    return np.correlate(x, t / max(np.sqrt((t * t).sum()), 1e-30), "same")


def median_filter(x: np.ndarray, size: int) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2, "edge"), size), axis=1)


def resample(x: np.ndarray, n: int, method: str = "linear") -> np.ndarray:
    """n samples over the same span, by interpolation or by FFT."""
    if method == "fft":
        spec = np.fft.rfft(x)
        return np.fft.irfft(np.resize(np.pad(spec, (0, max(0, n // 2 + 1 - len(spec)))), n // 2 + 1), n) * n / len(x)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


# ---- levels, edges, timing -------------------------------------------------------------------


def levels(x: np.ndarray) -> tuple[float, float]:
    """Low and high level: the fullest of 50 histogram bins in the lower and upper half; else percentiles 1 and 99."""
    p01, p50, p99 = np.percentile(x, (1, 50, 99))
    if p99 - p01 < 1e-10:
        return float(p50), float(p50)
    count, edge = np.histogram(x, 50)
    mid = (edge[:-1] + edge[1:]) / 2
    low, high = mid[:25][count[:25].argmax()], mid[25:][count[25:].argmax()]
    return (float(low), float(high)) if high > low else (float(p01), float(p99))


def crossings(x: np.ndarray, level: float, fs: float, rising: bool = True) -> np.ndarray:
    """Interpolated times at which x passes ``level`` (from below to at or above; the reverse for falling)."""
    a, b = x[:-1], x[1:]
    at = np.flatnonzero((a < level) & (b >= level) if rising else (a >= level) & (b < level))
    step = b[at] - a[at]
    part = np.where(step != 0, (level - a[at]) / np.where(step == 0, 1, step), 0)
    return (at + np.clip(part, 0, 1)) / fs


def transition_time(x: np.ndarray, fs: float, rising: bool = True, lo: float = 0.1, hi: float = 0.9) -> float:
    """Shortest time between the 10 % and 90 % crossings of one edge."""
    a, b = levels(x)
    if b - a <= 0:
        return math.nan
    first, last = (lo, hi) if rising else (hi, lo)
    p, q = crossings(x, a + first * (b - a), fs, rising), crossings(x, a + last * (b - a), fs, rising)
    if not len(p) or not len(q):
        return math.nan
    at = np.searchsorted(p, q, "right") - 1
    d = q[at >= 0] - p[at[at >= 0]]
    return float(d.min()) if len(d) else math.nan


def measure(x: np.ndarray, fs: float) -> dict[str, float]:
    """Amplitude, timing and shape measurements of one trace; NaN where they do not apply."""
    x = x[np.isfinite(x)]
    if len(x) < 3:
        return {}
    low, high = levels(x)
    amp, mid = high - low, (high + low) / 2
    up, down = crossings(x, mid, fs), crossings(x, mid, fs, False)
    period = float(np.diff(up).mean()) if len(up) > 1 else math.nan
    nxt = np.searchsorted(down, up)
    pos = down[nxt[nxt < len(down)]] - up[nxt < len(down)]
    nxt = np.searchsorted(up, down)
    neg = up[nxt[nxt < len(up)]] - down[nxt < len(up)]
    f = 1 / period if period > 0 else float(np.fft.rfftfreq(len(x), 1 / fs)[np.abs(np.fft.rfft(x - x.mean())).argmax()])
    duty = float(pos.mean() / period) if len(pos) and period > 0 else float((x >= mid).mean())
    return {
        "mean": float(x.mean()), "rms": float(np.sqrt((x * x).mean())), "amplitude": amp, "low": low, "high": high, "period": period, "frequency": f,
        "duty_cycle": duty, "pulse_width": float(pos.mean()) if len(pos) else math.nan, "pulse_width_negative": float(neg.mean()) if len(neg) else math.nan,
        "rise_time": transition_time(x, fs), "fall_time": transition_time(x, fs, False),
        "overshoot": max(0.0, (x.max() - high) / amp * 100) if amp > 0 else math.nan, "undershoot": max(0.0, (low - x.min()) / amp * 100) if amp > 0 else math.nan,
    }


def schmitt(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Hysteresis: true from reaching ``high`` until falling below ``low``."""
    mark = np.where(x >= high, 1, np.where(x < low, 0, -1))
    at = np.where(mark >= 0, np.arange(len(x)), -1)
    at = np.maximum.accumulate(at)
    return np.where(at >= 0, mark[np.maximum(at, 0)], 0).astype(bool)


def runts(x: np.ndarray, low: float, high: float) -> list[tuple[int, int, float, int]]:
    """Pulses that leave one zone and return without reaching the other: start, stop, extreme, polarity."""
    zone = np.where(x < low, 0, np.where(x > high, 2, 1))
    edge = np.flatnonzero(np.diff(zone)) + 1
    run = np.split(np.arange(len(x)), edge)
    out = []
    for a, b, c in zip(run[:-2], run[1:-1], run[2:], strict=True):
        if zone[b[0]] == 1 and zone[a[0]] == zone[c[0]] != 1:
            positive = zone[a[0]] == 0
            out.append((int(b[0]), int(b[-1]), float(x[b].max() if positive else x[b].min()), 1 if positive else -1))
    return out


# ---- jitter and eye --------------------------------------------------------------------------


def erfc_inverse(p: float) -> float:
    """Inverse complementary error function by bisection."""
    a, b = -6.0, 27.0
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if math.erfc(m) > p else (a, m)
    return (a + b) / 2


def q_factor(ber: float) -> float:
    return math.sqrt(2) * erfc_inverse(2 * ber) if 0 < ber < 0.5 else math.nan


def total_jitter(rj: float, dj: float, ber: float) -> float:
    return dj + 2 * q_factor(ber) * rj


def decompose_jitter(tie: np.ndarray, ber: float = 1e-12) -> dict[str, float]:
    """Random jitter from the slopes of the tails on the Q scale, deterministic from where they meet."""
    x = np.sort(tie)
    n = len(x)
    p = (np.arange(n) + 0.5) / n
    q = np.array([-math.sqrt(2) * erfc_inverse(2 * v) if v < 0.5 else math.sqrt(2) * erfc_inverse(2 * (1 - v)) for v in p])
    left, right = p < 0.1, p > 0.9
    (sl, ml), (sr, mr) = (np.polyfit(q[s], x[s], 1) for s in (left, right))
    rj, dj = float((sl + sr) / 2), float(max(0.0, mr - ml))
    return {"rj": rj, "dj": dj, "tj": total_jitter(rj, dj, ber)}


def bathtub(rj: float, dj: float, ui: float, points: int = 101) -> tuple[np.ndarray, np.ndarray]:
    """Bit error rate over the sampling position of one unit interval (dual Dirac)."""
    t = np.linspace(0, ui, points)
    tail = lambda d: 0.25 * np.array([math.erfc(v) for v in (d - dj / 2) / (math.sqrt(2) * max(rj, 1e-30))])
    return t, np.minimum(tail(t) + tail(ui - t), 0.5)


def eye(x: np.ndarray, fs: float, ui: float, center: float = 0.5, width: float = 0.1) -> dict[str, float]:
    """Height, Q and levels at the middle of the eye folded at the unit interval; crossing spread gives the width."""
    phase = (np.arange(len(x)) / fs / ui) % 1
    at = x[np.abs(phase - center) <= width / 2]
    p10, p90 = np.percentile(x, (10, 90))
    mid = (p10 + p90) / 2
    one, zero = at[at >= mid], at[at < mid]
    if not len(one) or not len(zero):
        return {"height": math.nan, "q": math.nan, "width": math.nan}
    spread = one.std() + zero.std()
    cross = np.concatenate((crossings(x, mid, fs), crossings(x, mid, fs, False))) / ui % 1
    cross = np.where(cross > center, cross - 1, cross)
    open_ = (cross.min() + 1 - cross.max()) * ui if len(cross) else math.nan
    return {"height": float(one.min() - zero.max()), "q": float((one.mean() - zero.mean()) / spread) if spread > 0 else math.inf, "width": float(max(0.0, open_))}


def ffe(x: np.ndarray, taps: list[float]) -> np.ndarray:
    return np.convolve(x, taps)[: len(x)]


def dfe(x: np.ndarray, taps: list[float], threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Decision feedback: earlier decisions (-1, 1) times the taps are taken off each sample."""
    out, bits, past = np.empty(len(x)), np.empty(len(x)), [0.0] * len(taps)
    for i, v in enumerate(x.tolist()):
        y = v - sum(t * d for t, d in zip(taps, past, strict=True))
        d = 1.0 if y >= threshold else -1.0
        out[i], bits[i] = y, d
        past = [d, *past[:-1]]
    return out, bits


def change_points(x: np.ndarray, penalty: float | None = None, least: int = 5) -> list[int]:
    """Binary segmentation on the mean: cut while it saves more squared error than the penalty."""
    penalty = penalty if penalty is not None else 3 * np.log(max(len(x), 2)) * (np.median(np.abs(np.diff(x))) / 0.954) ** 2
    s, s2 = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    cost = lambda a, b: s2[b] - s2[a] - (s[b] - s[a]) ** 2 / (b - a)
    todo, out = [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a < 2 * least:
            continue
        at = np.arange(a + least, b - least + 1)
        gain = cost(a, b) - (cost(a, at) + cost(at, b))
        k = int(gain.argmax())
        if gain[k] > penalty:
            out.append(int(at[k]))
            todo += [(a, int(at[k])), (int(at[k]), b)]
    return sorted(out)


def seasonal(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Additive trend (centred moving average), seasonal means and remainder."""
    k = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.convolve(np.pad(x, len(k) // 2, "edge"), k, "valid")[: len(x)]
    d = x - trend
    # The trend is biased within half a period of the ends; seasons are averaged inside.
    at = np.arange(len(x))
    inside = (at >= period // 2) & (at < len(x) - period // 2)
    means = np.array([d[inside & (at % period == i)].mean() for i in range(period)])
    s = np.resize(means - means.mean(), len(x))
    return trend, s, x - trend - s


def nearest_rows(x: np.ndarray, k: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row of a finite matrix (ties: the first) and their distances, ascending.

    Products give each squared distance up to rounding, for ``cells`` pairs at a time; all rows that may be
    among the k are then measured by their differences."""
    n, dim = x.shape
    y = x / (np.abs(x).max() or 1.0)
    y -= y.mean(0)
    sq = (y * y).sum(1)
    slack = 64 * np.finfo(float).eps * dim * max(1.0, sq.max())
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    step, part = max(1, cells // n), max(1, cells // max(dim, 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        d = sq[a:b, None] + sq - 2 * (y[a:b] @ y.T)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
        away = np.concatenate([np.sqrt(((x[a + row[i : i + part]] - x[col[i : i + part]]) ** 2).sum(1)) for i in range(0, len(row), part)])
        order = np.lexsort((col, away, row))
        at = order[np.searchsorted(row, np.arange(b - a))[:, None] + np.arange(k)]
        near[a:b], dist[a:b] = col[at], away[at]
    return near, dist


def local_outlier_factor(x: np.ndarray, k: int = 20) -> np.ndarray:
    """LOF of the rows of a matrix; rows that are not finite have none (NaN) and are no one's neighbours."""
    fine = np.isfinite(x).all(1)
    out = np.where(fine, 1.0, np.nan)
    x = x[fine]
    k = min(k, len(x) - 1)
    if k < 1:
        return out
    near, dist = nearest_rows(x, k)
    reach = np.maximum(dist, dist.max(1)[near])
    density = 1 / np.maximum(reach.mean(1), 1e-12)
    out[fine] = density[near].mean(1) / density
    return out


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Isolation forest anomaly scores in (0, 1) of the rows of a matrix."""
    rng = np.random.default_rng(seed)
    norm = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    sample = min(sample, len(x))
    total = np.zeros(len(x))
    for _ in range(trees):
        todo = [(rng.choice(len(x), sample, replace=False), np.arange(len(x)), 0)]
        while todo:
            own, rows, depth = todo.pop()
            lo, hi = (x[own].min(0), x[own].max(0)) if len(own) else (None, None)
            split = np.flatnonzero(hi > lo) if len(own) > 1 else []
            if depth >= np.ceil(np.log2(max(sample, 2))) or not len(split):
                total[rows] += depth + (norm(len(own)) if len(own) > 1 else 0)
                continue
            f = rng.choice(split)
            cut = rng.uniform(lo[f], hi[f])
            left = x[rows, f] < cut
            todo += [(own[x[own, f] < cut], rows[left], depth + 1), (own[x[own, f] >= cut], rows[~left], depth + 1)]
    return 2 ** (-total / trees / max(norm(sample), 1e-9))


# ---- further spectra and comparisons ---------------------------------------------------------


def periodogram(x: np.ndarray, fs: float, name: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of the whole, mean-removed trace."""
    return welch(x, fs, len(x), 0.0, name)


def bartlett(x: np.ndarray, fs: float, segments: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean periodogram of equal segments that do not overlap, rectangular window."""
    return welch(x[: len(x) // segments * segments], fs, len(x) // segments, 0.0, "rectangular")


def spectral_peaks(x: np.ndarray, fs: float, threshold_db: float = -60.0, distance: int = 5, most: int | None = None) -> list[dict[str, float]]:
    """Local maxima of the amplitude spectrum above ``threshold_db`` of the largest, strongest first, ``distance`` bins apart."""
    f, mag = spectrum(x, fs)
    db = 20 * np.log10(np.maximum(mag, 1e-20))
    top = db.max() if len(db) else 0.0
    at = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] >= mag[2:]) & (db[1:-1] > top + threshold_db)) + 1
    kept: list[int] = []
    for k in at[np.argsort(-mag[at], kind="stable")]:
        if all(abs(k - j) >= distance for j in kept):
            kept.append(int(k))
    return [{"frequency": float(f[k]), "magnitude": float(mag[k]), "db": float(db[k])} for k in kept[:most]]


def coherence(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude-squared coherence over half-overlapping, mean-removed Hann segments."""
    n = min(len(x), len(y))
    size = min(nperseg, n)
    w = window("hann", size, periodic=True)
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(v[:n], size)[:: max(1, size // 2)]
    a, b = (np.fft.rfft((s - s.mean(1, keepdims=True)) * w, axis=1) for s in (cut(x), cut(y)))
    cross = (np.conj(a) * b).mean(0)
    power = (np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0)
    return np.fft.rfftfreq(size, 1 / fs), np.where(power > 0, np.abs(cross) ** 2 / np.where(power > 0, power, 1), 0.0)


def phase_locking(x: np.ndarray, y: np.ndarray) -> float:
    """Length of the mean phase difference vector: 1 for a constant difference."""
    n = min(len(x), len(y))
    a, b = analytic(x[:n] - x[:n].mean()), analytic(y[:n] - y[:n].mean())
    return float(abs(np.exp(1j * (np.angle(a) - np.angle(b))).mean()))


def preshoot(x: np.ndarray) -> float:
    """Largest dip below the low level within ten samples before a rising passage of the middle, in percent of the amplitude."""
    low, high = levels(x)
    amp, mid = high - low, (high + low) / 2
    at = np.flatnonzero((x[:-1] < mid) & (x[1:] >= mid)) + 1
    if amp <= 0 or not len(at):
        return math.nan
    return float(max(max(0.0, low - x[max(0, k - 10) : k].min()) for k in at) / amp * 100)


def recovered_clock(x: np.ndarray, fs: float, nominal: float, bandwidth: float = 0.01, damping: float = 0.707) -> tuple[float, np.ndarray]:
    """Frequency and phase error per edge of a second-order loop that follows both edges of a signal."""
    mid = (x.max() + x.min()) / 2
    edges = np.sort(np.concatenate((crossings(x, mid, fs), crossings(x, mid, fs, False))))
    period, kp, ki = 1 / nominal, 2 * damping * bandwidth * 2 * np.pi, (bandwidth * 2 * np.pi) ** 2
    at, errors = edges[0] if len(edges) else 0.0, []
    for e in edges.tolist():
        n = max(0, round((e - at) / period))
        err = e - (at + n * period)
        at += n * period + kp * err
        period += ki * err / max(n, 1)
        errors.append(err)
    return 1 / period, np.array(errors)


def quality(x: np.ndarray) -> dict[str, float]:
    """Share of clipped samples, of repeated samples, level of noise (from second differences) and signal-to-noise ratio."""
    span = float(x.max() - x.min())
    flat = float((np.abs(np.diff(x)) <= 1e-12).mean()) if len(x) > 1 else 0.0
    clipped = float(((x >= x.max() - 1e-3 * span) | (x <= x.min() + 1e-3 * span)).mean()) if span > 0 else 1.0
    noise = float(np.sqrt((np.diff(x, 2) ** 2).mean() / 6)) if len(x) > 2 else 0.0
    return {"clipped": clipped, "flat": flat, "noise": noise, "snr": 10 * math.log10(x.var() / noise**2) if noise > 0 and x.var() > 0 else math.inf}


def character(x: np.ndarray) -> dict[str, object]:
    """Digital, periodic, constant or noise, with the features that decide."""
    span = float(x.max() - x.min())
    if span < 1e-12:
        return {"kind": "constant", "two_level": 1.0, "periodicity": 0.0, "confidence": 1.0}
    two = float(((x < x.min() + 0.2 * span) | (x > x.max() - 0.2 * span)).mean())
    y = x - x.mean()
    f = np.fft.rfft(y, 2 * len(y))
    acf = np.fft.irfft(np.abs(f) ** 2)[: len(y) // 2]
    acf = acf / acf[0]
    drop = np.flatnonzero(acf < 0)
    periodic = float(acf[drop[0] :].max()) if len(drop) and drop[0] < len(acf) else 0.0
    kind = "digital" if two > 0.9 else "periodic" if periodic > 0.5 else "noise"
    return {"kind": kind, "two_level": two, "periodicity": periodic, "confidence": max(two if kind == "digital" else periodic, 1 - periodic if kind == "noise" else 0.0)}


def glitches_and_dropouts(x: np.ndarray, threshold: float = 6.0, flat: int = 10) -> list[dict[str, object]]:
    """Steps beyond ``threshold`` robust deviations, and runs of ``flat`` equal samples or more."""
    d = np.diff(x)
    scale = np.median(np.abs(d - np.median(d))) / 0.6745 if len(d) else 0.0
    out = [{"kind": "glitch", "start": int(k), "stop": int(k + 1), "size": float(d[k])} for k in np.flatnonzero(np.abs(d - np.median(d)) > threshold * scale)] if scale > 0 else []
    same = np.concatenate(([0], (np.abs(d) <= 1e-12).astype(int), [0]))
    for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
        if b - a + 1 >= flat:
            out.append({"kind": "dropout", "start": int(a), "stop": int(b), "size": float(b - a + 1)})
    return out
