"""Numeric kernels over rolling windows: numpy over window views, one pass per series.

Each kernel takes an array of windows (rows x n) and the same windows of other
columns where it needs them, and returns one value per row. Window rows are
worked on in blocks, so memory does not grow with the series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 8192
EPS = 1e-10


def _design(*cols: np.ndarray) -> np.ndarray:
    return np.stack(np.broadcast_arrays(*cols), axis=-1)


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and the inverse of the normal matrix, by row."""
    xt = np.swapaxes(x, 1, 2)
    inv = np.linalg.pinv(xt @ x)
    beta = (inv @ (xt @ y[..., None]))[..., 0]
    return beta, y - (x @ beta[..., None])[..., 0], inv


def adf(x: np.ndarray) -> np.ndarray:
    """t statistic of the lagged level with a constant and one lagged difference."""
    d = np.diff(x, axis=1)
    one = np.ones_like(d[:, 1:])
    b, e, inv = _ols(_design(one, x[:, 1:-1], d[:, :-1]), d[:, 1:])
    s2 = (e * e).sum(1) / max(1, d.shape[1] - 1 - 3)
    return b[:, 1] / (np.sqrt(s2 * inv[:, 1, 1]) + EPS)


def pp(x: np.ndarray) -> np.ndarray:
    """The same without the lag, the variance by Newey-West."""
    d, level = np.diff(x, axis=1), x[:, :-1]
    n = d.shape[1]
    b, e, inv = _ols(_design(np.ones_like(level), level), d)
    s2 = (e * e).sum(1) / (n - 2)
    long = (e * e).mean(1)
    lags = int(4 * (n / 100) ** (2 / 9))
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * (e[:, k:] * e[:, :-k]).sum(1) / n
    long = np.maximum(long, EPS)
    se = np.sqrt(s2 * inv[:, 1, 1]) + EPS
    t = b[:, 1] / se
    return np.sqrt(np.maximum(s2, EPS) / long) * t - 0.5 * (long - s2) / np.sqrt(long) * n * se / np.sqrt(np.maximum(s2, EPS))


def kpss(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    t = np.arange(n, dtype=float)
    _, e, _ = _ols(_design(np.ones_like(x), np.broadcast_to(t, x.shape)), x)
    s = np.cumsum(e, 1)
    lags = int(4 * (n / 100) ** 0.25)
    long = (e * e).mean(1)
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * (e[:, k:] * e[:, :-k]).sum(1) / n
    return (s * s).sum(1) / (n * n) / (long + EPS)


def holt_level(x: np.ndarray, a: float = 0.3) -> np.ndarray:
    y = x[:, 0]
    for k in range(1, x.shape[1]):
        y = a * x[:, k] + (1 - a) * y
    return y


def holt_trend(x: np.ndarray, a: float = 0.3, b: float = 0.1) -> np.ndarray:
    y, t = x[:, 0], x[:, 1] - x[:, 0]
    for k in range(1, x.shape[1]):
        before = y
        y = a * x[:, k] + (1 - a) * (y + t)
        t = b * (y - before) + (1 - b) * t
    return t


def ar1_variance(x: np.ndarray) -> np.ndarray:
    d = np.diff(x, axis=1)
    a, b = d[:, :-1], d[:, 1:]
    ac, bc = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    phi = (ac * bc).sum(1) / ((ac * ac).sum(1) + EPS)
    e = bc - phi[:, None] * ac
    return (e * e).sum(1) / max(1, a.shape[1] - 2)


def kalman(x: np.ndarray) -> np.ndarray:
    """State of a level with noise: step variance from the differences, a tenth of the variance as noise, both unbiased; starts at variance 1."""
    var = x.var(1, ddof=1)
    q, r = np.maximum(np.diff(x, axis=1).var(1, ddof=1), 0.01 * var), 0.1 * var
    s, p = x[:, 0].copy(), np.ones(len(x))
    for k in range(1, x.shape[1]):
        p = p + q
        g = np.divide(p, p + r, out=np.ones_like(p), where=p + r > 0)
        s, p = s + g * (x[:, k] - s), (1 - g) * p
    return s


def lowess(x: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Local line at the right edge, tricube weights."""
    k = max(3, int(share * x.shape[1]))
    y, t = x[:, -k:], np.arange(k, dtype=float)
    w = (1 - (np.abs(t - (k - 1)) / k) ** 3) ** 3
    sw, st = w.sum(), (w * t).sum()
    mt, my = st / sw, (y * w).sum(1) / sw
    slope = ((y - my[:, None]) * w * (t - mt)).sum(1) / ((w * (t - mt) ** 2).sum() + EPS)
    return my + slope * (k - 1 - mt)


def theil_sen(x: np.ndarray, most: int = 1000) -> np.ndarray:
    i, j = np.triu_indices(x.shape[1], 1)
    stride = max(1, len(i) // most)
    i, j = i[::stride], j[::stride]
    return np.median((x[:, j] - x[:, i]) / (j - i), axis=1)


def gev_shape(x: np.ndarray) -> np.ndarray:
    """Shape from the ratio of the third to the second linear moment, within +-0.5."""
    s, n = np.sort(x, 1), x.shape[1]
    i = np.arange(n, dtype=float)
    second = (s * (2 * i - n + 1)).sum(1) / n / 2
    third = (s * (i * (i - 1) - 2 * i * (n - 1) + (n - 1) * (n - 2))).sum(1) / (n * (n - 1)) / 3
    flat = np.abs(second) <= 1e-8
    ratio = third / np.where(flat, 1, second)
    return np.where(flat, 0, np.clip(7.859 * ratio + 2.9554 * ratio**2, -0.5, 0.5))


def _spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << (x.shape[1] - 1).bit_length()
    mag = np.abs(np.fft.rfft(x, n, axis=1))[:, 1 : n // 2]
    return np.arange(1, n // 2) / n, mag


def _bins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes of the lower half of the spectrum, the constant included, on frequencies spread evenly from 0 to 0.5."""
    half = x.shape[1] // 2
    mag = np.abs(np.fft.rfft(x, 1 << (x.shape[1] - 1).bit_length(), axis=1))[:, :half]
    return np.linspace(0, 0.5, half), mag


def centroid(x: np.ndarray) -> np.ndarray:
    f, m = _bins(x)
    total = m.sum(1)
    return np.divide((f * m).sum(1), total, out=np.zeros(len(x)), where=total > 0)


def bandwidth(x: np.ndarray) -> np.ndarray:
    f, m = _bins(x)
    total = m.sum(1)
    spread = (((f - centroid(x)[:, None]) ** 2) * m).sum(1)
    return np.sqrt(np.divide(spread, total, out=np.zeros(len(x)), where=total > 0))


def rolloff(x: np.ndarray, share: float = 0.85) -> np.ndarray:
    """The first bin that reaches the share of the power, as a fraction of twice the bins."""
    _, m = _bins(x)
    c = np.cumsum(m * m, 1)
    return (c >= share * c[:, -1:]).argmax(1) / (2 * m.shape[1])


def flatness(x: np.ndarray) -> np.ndarray:
    _, m = _spectrum(x)
    p = m * m + EPS
    return np.exp(np.log(p).mean(1)) / p.mean(1)


def entropy(x: np.ndarray) -> np.ndarray:
    _, m = _spectrum(x)
    p = m * m / ((m * m).sum(1, keepdims=True) + EPS)
    return -(p * np.log2(p + EPS)).sum(1)


def flux(x: np.ndarray) -> np.ndarray:
    """Distance of the normalised spectra of the window's halves."""
    h = x.shape[1] // 2
    (_, a), (_, b) = _spectrum(x[:, :h]), _spectrum(x[:, h : 2 * h])
    a, b = a / (np.linalg.norm(a, axis=1, keepdims=True) + EPS), b / (np.linalg.norm(b, axis=1, keepdims=True) + EPS)
    return np.sqrt(((b - a) ** 2).sum(1))


def wavelet_energy(x: np.ndarray) -> np.ndarray:
    """Energy of the finest Haar details."""
    n = x.shape[1] // 2 * 2
    d = (x[:, 1:n:2] - x[:, 0:n:2]) / np.sqrt(2)
    return (d * d).sum(1)


def _phase(x: np.ndarray) -> np.ndarray:
    return np.angle(x + 1j * np.roll(x, 1, axis=1))


def phase_variance(x: np.ndarray) -> np.ndarray:
    return _phase(x).var(1)


def phase_stability(x: np.ndarray) -> np.ndarray:
    return np.where(x.std(1) < EPS, 1.0, 1 / (1 + np.diff(_phase(x), axis=1).std(1) + EPS))


def hilbert_amplitude(x: np.ndarray) -> np.ndarray:
    """Mean length of each value with the real part of the quarter-turned spectrum at its place."""
    n = x.shape[1]
    turn = np.ones(n, complex)
    turn[1 : n // 2] = -1j
    turn[n - np.arange(1, n // 2)] = 1j
    return np.sqrt(x**2 + np.real(np.fft.fft(x, axis=1) * turn) ** 2).mean(1)


def frequency_mean(x: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(_phase(x), axis=1)).mean(1)


def frequency_std(x: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(_phase(x), axis=1)).std(1)


def density(x: np.ndarray) -> np.ndarray:
    """Share of pairs closer than half a deviation."""
    n, close = x.shape[1], 0.5 * x.std(1, keepdims=True)
    total = sum((np.abs(x[:, k:] - x[:, :-k]) <= close).sum(1) for k in range(1, n))
    return total / (n * (n - 1) / 2)


def clustering(x: np.ndarray) -> np.ndarray:
    near = np.abs(x[:, :, None] - x[:, None, :]) <= 0.5 * x.std(1)[:, None, None]
    a = near.astype(np.float32)
    a[:, np.arange(x.shape[1]), np.arange(x.shape[1])] = 0
    deg = a.sum(2)
    tri = np.einsum("rij,rji->ri", a @ a, a)
    return np.where(deg > 1, tri / np.maximum(deg * (deg - 1), 1), 0).mean(1)


def vocabulary(x: np.ndarray, bins: int = 10) -> np.ndarray:
    mu, sd = x.mean(1, keepdims=True), x.std(1, keepdims=True)
    b = np.clip(((x - (mu - 2 * sd)) / (4 * sd + EPS) * bins).astype(int), 0, bins - 1)
    seen = np.zeros((len(x), bins), bool)
    np.put_along_axis(seen, b, True, 1)
    return seen.sum(1) / x.shape[1]


def complexity(x: np.ndarray) -> np.ndarray:
    """Distinct pairs and triples of falling, level and rising steps (a tenth of their deviation apart), over what is possible."""
    d = np.diff(x, axis=1)
    least = 0.1 * d.std(1, keepdims=True)
    s = np.where(d > least, 2, np.where(d < -least, 0, 1))

    def share(code: np.ndarray, kinds: int) -> np.ndarray:
        seen = np.zeros((len(x), kinds), bool)
        np.put_along_axis(seen, code, True, 1)
        return seen.sum(1) / min(kinds, code.shape[1])

    return (share(s[:, :-1] * 3 + s[:, 1:], 9) + share(s[:, :-2] * 9 + s[:, 1:-1] * 3 + s[:, 2:], 27)) / 2


def _local(x: np.ndarray, reach: int) -> np.ndarray:
    """The windows of `reach` values to either side, without the last one that would fit."""
    return np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1, axis=1)[:, : x.shape[1] - 2 * reach]


def semantic_flow(x: np.ndarray) -> np.ndarray:
    """Mean cosine of successive neighbourhoods' (mean offset, deviation), taken from -1..1 to 0..1."""
    reach = min(5, x.shape[1] // 3)
    near = _local(x, reach)
    v = np.stack([near.mean(2) - x[:, reach : reach + near.shape[1]], near.std(2)], axis=2)
    norm = np.sqrt((v * v).sum(2))
    fine = (norm[:, 1:] > EPS) & (norm[:, :-1] > EPS)
    cos = (v[:, 1:] * v[:, :-1]).sum(2) / np.where(fine, norm[:, 1:] * norm[:, :-1], 1)
    count = fine.sum(1)
    return np.where(count > 0, ((cos * fine).sum(1) / np.maximum(count, 1) + 1) / 2, 0)


def golden_ratio(x: np.ndarray) -> np.ndarray:
    """Mean nearness of high over low to the golden ratio over local windows; NaN where no low is above 0."""
    phi = (1 + 5**0.5) / 2
    near = _local(x, min(8, x.shape[1] // 2))
    high, low = near.max(2), near.min(2)
    fine = low > 0
    each = 1 / (1 + np.abs(high / np.where(fine, low, 1) - phi) / phi)
    count = fine.sum(1)
    return np.where(count > 0, (each * fine).sum(1) / np.maximum(count, 1), np.nan)


def symmetry(x: np.ndarray) -> np.ndarray:
    h = x.shape[1] // 2
    a, b = x[:, :h], x[:, -h:][:, ::-1]
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    return ((a * b).sum(1) / (np.sqrt((a * a).sum(1) * (b * b).sum(1)) + EPS) + 1) / 2


def rhythm(x: np.ndarray) -> np.ndarray:
    """The best agreement of beats (steps above the mean step) with those 2 to 7 steps earlier."""
    step = np.abs(np.diff(x, axis=1))
    beat = step > step.mean(1, keepdims=True)
    periods = range(2, min(8, beat.shape[1] // 3))
    return np.max([(beat[:, k:] == beat[:, :-k]).mean(1) for k in periods], axis=0) if periods else np.zeros(len(x))


def aesthetic_balance(x: np.ndarray) -> np.ndarray:
    """How near the mix of gentle, moderate and intense steps is to 0.6, 0.3 and 0.1; steps beyond are left out."""
    step = np.abs(np.diff(x, axis=1))
    mean, dev = step.mean(1, keepdims=True), step.std(1, keepdims=True)
    up_to = [(step <= mean + k * dev).sum(1) for k in (-0.5, 0.5, 1.5)]
    total = np.maximum(up_to[2], 1)
    parts = [up_to[0], up_to[1] - up_to[0], up_to[2] - up_to[1]]
    off = sum(np.abs(p / total - want) for p, want in zip(parts, (0.6, 0.3, 0.1))) / 2
    return np.where(dev[:, 0] <= EPS, 1.0, np.where(up_to[2] > 0, np.maximum(0, 1 - off), 0))


#: Degrees of the major and the natural minor scale.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)


def tonality(x: np.ndarray) -> np.ndarray:
    """Share of steps on major degrees among those on major or minor ones, twelve degrees over +-3 deviations."""
    d = np.diff(x, axis=1)
    dev = d.std(1, keepdims=True)
    degree = np.clip(np.trunc((d / np.where(dev > EPS, dev, 1) + 3) / 6 * 11), 0, 11)
    major, minor = (np.isin(degree, scale).sum(1) for scale in (MAJOR, MINOR))
    both = major + minor
    return np.where((dev[:, 0] > EPS) & (both > 0), major / np.maximum(both, 1), 0.5)


def harmony(x: np.ndarray) -> np.ndarray:
    """Agreement of the steps of three moving averages: 1 if all go one way, a half if two do or none moves alone."""
    n = x.shape[1]
    total = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    spans = [max(3, n // 15), max(5, n // 10), max(8, n // 6)]
    means = [(total[:, w:] - total[:, :-w]) / w for w in spans]
    shortest = min(m.shape[1] for m in means)
    # A step of a moving average has the sign of what enters less what leaves.
    a, b, c = (np.sign(x[:, w:] - x[:, :-w])[:, -(shortest - 1) :] for w in spans)
    all_same = (a == b) & (b == c)
    two = (a == b) | (b == c) | (a == c)
    return np.where(all_same, (a != 0) * 1.0, 0.5 * two).mean(1)


def tension(x: np.ndarray) -> np.ndarray:
    """Mean over local windows of steps: half of the share of turns and of the largest step over the mean price, 1 at most."""
    d = np.diff(x, axis=1)
    near = _local(d, min(5, d.shape[1] // 3))
    sign = np.sign(near)
    turns = (sign[:, :, 1:] != sign[:, :, :-1]).sum(2) / near.shape[2]
    largest = np.abs(near).max(2) / (np.abs(x).mean(1)[:, None] + EPS)
    return np.minimum((turns + largest) / 2, 1).mean(1)


def kinetic(x: np.ndarray) -> np.ndarray:
    d = np.diff(x, axis=1)
    return (0.5 * x[:, 1:] * d * d).mean(1) / (x.mean(1) ** 2 + EPS)


def muscle_force(x: np.ndarray) -> np.ndarray:
    """Price times acceleration: 0.7 of the mean, and 0.3 of the mean over runs of one direction of two values or more, over the squared mean price."""
    acc = np.diff(x, 2, axis=1)
    force, way = x[:, 2:] * np.abs(acc), np.sign(acc)
    out = np.empty(len(x))
    for r in range(len(x)):
        # A run ends where the direction changes or is none.
        cut = np.flatnonzero((way[r, 1:] != way[r, :-1]) | (way[r, :-1] == 0)) + 1
        size = np.diff(np.concatenate([[0], cut, [force.shape[1]]]))
        mean = np.add.reduceat(force[r], np.concatenate([[0], cut])) / size
        out[r] = 0.7 * force[r].mean() + (0.3 * mean[size > 1].mean() if (size > 1).any() else 0)
    price = x.mean(1)
    return out / np.where(price > EPS, price**2, 1)


def efficiency(x: np.ndarray) -> np.ndarray:
    """Path over energy (squared steps and accelerations), against the path's share of itself; 1 at most."""
    d = np.diff(x, axis=1)
    path = np.abs(d).sum(1)
    energy = (d * d).sum(1) + (np.diff(d, axis=1) ** 2).sum(1)
    fine = (energy > EPS) & (path > EPS)
    raw = path / np.where(fine, energy, 1) / (path / (path + EPS) + EPS)
    return np.where(fine, np.minimum(raw, 1), 0)


def expenditure(x: np.ndarray) -> np.ndarray:
    """Variance, squared steps and accelerations, and squared distance from the line fitted, over the squared mean if that is above 0."""
    n = x.shape[1]
    d = np.diff(x, axis=1)
    t = np.arange(n) - (n - 1) / 2
    off = x - x.mean(1, keepdims=True)
    bent = (off * off).sum(1) - (off @ t) ** 2 / (t @ t)
    total = x.var(1) + (d * d).sum(1) + (np.diff(d, axis=1) ** 2).sum(1) + bent
    mean = x.mean(1)
    return total / np.where(mean > EPS, mean**2, 1)


def robust_volatility(x: np.ndarray) -> np.ndarray:
    """Median absolute deviation on the scale of a normal deviation."""
    return 1.4826 * np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1)


def robust_stabilised(x: np.ndarray) -> np.ndarray:
    """The last value within three median absolute deviations of the median; 0.6745 deviations stand for a deviation of none."""
    mid = np.median(x, axis=1)
    mad = np.median(np.abs(x - mid[:, None]), axis=1)
    mad = np.where(mad < EPS, 0.6745 * x.std(1, ddof=1), mad)
    return np.clip(x[:, -1], mid - 3 * mad, mid + 3 * mad)


def biweight(x: np.ndarray) -> np.ndarray:
    m = np.median(x, axis=1)
    scale = 6 * np.median(np.abs(x - m[:, None]), axis=1) + EPS
    for _ in range(50):
        u = (x - m[:, None]) / scale[:, None]
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        new = (w * x).sum(1) / (w.sum(1) + EPS)
        if np.abs(new - m).max() < 1e-10:
            break
        m = new
    return m


def anderson_darling(x: np.ndarray) -> np.ndarray:
    from math import erf

    n = x.shape[1]
    z = (np.sort(x, 1) - x.mean(1, keepdims=True)) / (x.std(1, ddof=1, keepdims=True) + EPS)
    cdf = np.clip(0.5 * (1 + np.vectorize(erf)(z / np.sqrt(2))), 1e-10, 1 - 1e-10)
    i = np.arange(1, n + 1)
    a2 = -n - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[:, ::-1]))).sum(1) / n
    return a2 * (1 + 4 / n - 25 / n**2)


def runs(x: np.ndarray) -> np.ndarray:
    up = x > np.median(x, axis=1, keepdims=True)
    n1, n2 = up.sum(1), (~up).sum(1)
    n = n1 + n2
    r = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return np.where(var > 0, (r - mean) / np.sqrt(np.maximum(var, EPS)), 0)


Kernel = Callable[[np.ndarray], np.ndarray]
#: name -> (column, kernel); `r` is the return of the close.
TIME_SERIES: dict[str, tuple[str, Kernel]] = {
    "adf": ("close", adf), "pp": ("close", pp), "kpss": ("close", kpss), "holt_level": ("close", holt_level), "holt_trend": ("close", holt_trend),
    "ar1_variance": ("close", ar1_variance), "kalman": ("close", kalman), "lowess": ("close", lowess), "theil_sen": ("close", theil_sen),
    "gev_shape": ("high", gev_shape), "biweight": ("close", biweight), "robust_stabilised": ("close", robust_stabilised), "anderson_darling": ("r", anderson_darling), "runs": ("r", runs),
}
SIGNAL: dict[str, tuple[str, Kernel]] = {
    "centroid": ("r", centroid), "bandwidth": ("r", bandwidth), "rolloff": ("r", rolloff), "flatness": ("r", flatness), "entropy": ("r", entropy),
    "flux": ("r", flux), "wavelet_energy": ("r", wavelet_energy), "phase_variance": ("r", phase_variance), "phase_stability": ("r", phase_stability), "frequency_mean": ("r", frequency_mean),
    "frequency_std": ("r", frequency_std), "hilbert_amplitude": ("r", hilbert_amplitude), "robust_volatility": ("r", robust_volatility),
}
EXPERIMENTAL: dict[str, tuple[str, Kernel]] = {
    "density": ("close", density), "clustering": ("close", clustering), "vocabulary": ("close", vocabulary), "complexity": ("close", complexity),
    "golden_ratio": ("close", golden_ratio), "symmetry": ("close", symmetry), "rhythm": ("close", rhythm), "harmony": ("close", harmony),
    "tension": ("close", tension), "kinetic": ("close", kinetic), "efficiency": ("close", efficiency), "semantic_flow": ("close", semantic_flow),
    "aesthetic_balance": ("close", aesthetic_balance), "tonality": ("close", tonality), "muscle_force": ("close", muscle_force), "expenditure": ("r", expenditure),
}


def rolling(x: np.ndarray, kernel: Kernel, n: int) -> np.ndarray:
    """The kernel over every full window of finite values; NaN elsewhere."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    views = np.lib.stride_tricks.sliding_window_view(x, n)
    for at in range(0, len(views), BLOCK):
        part = views[at : at + BLOCK]
        fine = np.isfinite(part).all(1)
        if fine.any():
            got = np.full(len(part), np.nan)
            got[fine] = kernel(np.ascontiguousarray(part[fine]))
            out[at + n - 1 : at + n - 1 + len(part)] = got
    return out


def apply(bars: DataFrame, kernels: dict[str, tuple[str, Kernel]], n: int, by: str = "symbol", order: str = "bucket") -> DataFrame:
    """Every kernel over the last n bars of its column; null until a window is full."""
    kind = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in (by, order)], *[f"{k} double" for k in kernels]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        close = pdf["close"].to_numpy(float)
        before = np.concatenate([[np.nan], close[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            cols = {"close": close, "high": pdf["high"].to_numpy(float), "r": (close - before) / np.where(before == 0, np.nan, before)}
            out = {k: rolling(cols[c], f, n) for k, (c, f) in kernels.items()}
        return pd.DataFrame({by: pdf[by].to_numpy(), order: pdf[order].to_numpy(), **{k: np.where(np.isfinite(v), v, np.nan) for k, v in out.items()}})

    return bars.select(by, order, "close", "high").groupBy(by).applyInPandas(run, schema)
