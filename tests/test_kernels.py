"""Window kernels against plain versions, one window and one value at a time."""

import math

import numpy as np
import pytest

from tidemark.operators import kernels


def windows(n=40, rows=25):
    rng = np.random.default_rng(11)
    out = np.cumsum(rng.normal(0, 1, (rows, n)), axis=1) + 100
    out[0] = 100.0  # no movement
    out[1] = np.arange(n) + 50.0
    out[2, ::2] = 100.0
    return out


def sign(v):
    return (v > 0) - (v < 0)


def mean(v):
    return sum(v) / len(v)


def dev(v):
    return math.sqrt(mean([(a - mean(v)) ** 2 for a in v]))


def steps(x):
    return [b - a for a, b in zip(x, x[1:])]


def plain_kalman(x):
    var = dev(x) ** 2 * len(x) / (len(x) - 1)
    d = steps(x)
    q, r, s, p = max(dev(d) ** 2 * len(d) / (len(d) - 1), var * 0.01), var * 0.1, x[0], 1.0
    for v in x[1:]:
        p += q
        k = p / (p + r) if p + r else 1.0
        s, p = s + k * (v - s), (1 - k) * p
    return s


def plain_gev(x):
    s, n = sorted(x), len(x)
    l2 = sum((2 * i - n + 1) / n * v for i, v in enumerate(s)) / 2
    l3 = sum((i * (i - 1) - 2 * i * (n - 1) + (n - 1) * (n - 2)) / (n * (n - 1)) * v for i, v in enumerate(s)) / 3
    if abs(l2) <= 1e-8:
        return 0.0
    t = l3 / l2
    return max(-0.5, min(0.5, 7.859 * t + 2.9554 * t * t))


def spectrum(x):
    n, size = len(x), 1 << (len(x) - 1).bit_length()
    return [abs(sum(v * complex(math.cos(2 * math.pi * k * j / size), -math.sin(2 * math.pi * k * j / size)) for j, v in enumerate(x))) for k in range(n // 2)]


def plain_centroid(x):
    m = spectrum(x)
    return sum(0.5 * k / (len(m) - 1) * v for k, v in enumerate(m)) / sum(m) if sum(m) else 0.0


def plain_bandwidth(x):
    m, c = spectrum(x), plain_centroid(x)
    return math.sqrt(sum((0.5 * k / (len(m) - 1) - c) ** 2 * v for k, v in enumerate(m)) / sum(m)) if sum(m) else 0.0


def plain_rolloff(x):
    p, run = [v * v for v in spectrum(x)], 0.0
    for k, v in enumerate(p):
        run += v
        if run >= 0.85 * sum(p):
            return k / (2 * len(p))


def plain_complexity(x):
    d = steps(x)
    s = [1 if v > 0.1 * dev(d) else -1 if v < -0.1 * dev(d) else 0 for v in d]
    two, three = list(zip(s, s[1:])), list(zip(s, s[1:], s[2:]))
    return (len(set(two)) / min(9, len(two)) + len(set(three)) / min(27, len(three))) / 2


def plain_semantic(x):
    r = min(5, len(x) // 3)
    v = [(mean([a - x[j] for a in x[j - r : j + r + 1]]), dev(x[j - r : j + r + 1])) for j in range(r, len(x) - r)]
    cos = [(a[0] * b[0] + a[1] * b[1]) / (math.hypot(*a) * math.hypot(*b)) for a, b in zip(v, v[1:]) if math.hypot(*a) > 1e-10 and math.hypot(*b) > 1e-10]
    return (mean(cos) + 1) / 2 if cos else 0.0


def plain_golden(x):
    phi, r = (1 + 5**0.5) / 2, min(8, len(x) // 2)
    return mean([1 / (1 + abs(max(p) / min(p) - phi) / phi) for p in (x[j - r : j + r + 1] for j in range(r, len(x) - r)) if min(p) > 0])


def plain_balance(x):
    d = [abs(v) for v in steps(x)]
    m, s = mean(d), dev(d)
    if s <= 1e-10:
        return 1.0
    a = sum(v <= m - 0.5 * s for v in d)
    b = sum(m - 0.5 * s < v <= m + 0.5 * s for v in d)
    c = sum(m + 0.5 * s < v <= m + 1.5 * s for v in d)
    t = a + b + c
    return max(0.0, 1 - (abs(a / t - 0.6) + abs(b / t - 0.3) + abs(c / t - 0.1)) / 2) if t else 0.0


def plain_tonality(x):
    d = steps(x)
    if dev(d) <= 1e-10:
        return 0.5
    at = [max(0, min(11, int((v / dev(d) + 3) / 6 * 11))) for v in d]
    major, minor = (sum(k in scale for k in at) for scale in ((0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)))
    return major / (major + minor) if major + minor else 0.5


def plain_rhythm(x):
    d = [abs(v) for v in steps(x)]
    b = [v > mean(d) for v in d]
    return max([mean([b[j] == b[j - k] for j in range(k, len(b))]) for k in range(2, min(8, len(b) // 3))], default=0.0)


def plain_harmony(x):
    n = len(x)
    ma = [[mean(x[i : i + w]) for i in range(n - w + 1)] for w in (max(3, n // 15), max(5, n // 10), max(8, n // 6))]
    short = min(map(len, ma))
    # Rounded, so that averages of equal prices do not move.
    s = [[sign(round(v, 9)) for v in steps(m[-short:])] for m in ma]
    return mean([(1.0 if a else 0.0) if a == b == c else 0.5 * (a == b or b == c or a == c) for a, b, c in zip(*s)])


def plain_tension(x):
    d = steps(x)
    r, price, out = min(5, len(d) // 3), mean([abs(v) for v in x]), []
    for j in range(r, len(d) - r):
        p = d[j - r : j + r + 1]
        turns = sum(sign(a) != sign(b) for a, b in zip(p, p[1:])) / len(p)
        out.append(min(1.0, (turns + max(map(abs, p)) / (price + 1e-10)) / 2))
    return mean(out)


def plain_force(x):
    a = steps(steps(x))
    f, runs, run = [p * abs(v) for p, v in zip(x[2:], a)], [], []
    for k, v in enumerate(a):
        if run and (sign(v) != sign(a[k - 1]) or sign(a[k - 1]) == 0):
            runs.append(run)
            run = []
        run.append(f[k])
    runs.append(run)
    long = [mean(r) for r in runs if len(r) > 1]
    return (0.7 * mean(f) + (0.3 * mean(long) if long else 0)) / mean(x) ** 2


def plain_efficiency(x):
    d = steps(x)
    path, energy = sum(map(abs, d)), sum(v * v for v in d) + sum(v * v for v in steps(d))
    return min(1.0, path / energy / (path / (path + 1e-10) + 1e-10)) if path > 1e-10 and energy > 1e-10 else 0.0


def plain_expenditure(x):
    n, d = len(x), steps(x)
    slope, base = np.polyfit(range(n), x, 1)
    total = dev(x) ** 2 + sum(v * v for v in d) + sum(v * v for v in steps(d)) + sum((v - base - slope * k) ** 2 for k, v in enumerate(x))
    return total / mean(x) ** 2


def plain_amplitude(x):
    n = len(x)
    f = np.fft.fft(x)
    for j in range(1, n // 2):
        f[j] *= -1j
        f[n - j] *= 1j
    return mean([math.hypot(v, h) for v, h in zip(x, f.real)])


def plain_stability(x):
    a = [math.atan2(x[k - 1], v) for k, v in enumerate(x)]
    return 1.0 if dev(x) < 1e-10 else 1 / (1 + dev(steps(a)) + 1e-10)


def plain_stabilised(x):
    mid = float(np.median(x))
    mad = float(np.median([abs(v - mid) for v in x]))
    mad = 0.6745 * dev(x) * math.sqrt(len(x) / (len(x) - 1)) if mad < 1e-10 else mad
    return max(mid - 3 * mad, min(mid + 3 * mad, x[-1]))


@pytest.mark.parametrize(
    ("kernel", "plain"),
    [
        (kernels.kalman, plain_kalman), (kernels.gev_shape, plain_gev), (kernels.centroid, plain_centroid), (kernels.bandwidth, plain_bandwidth),
        (kernels.rolloff, plain_rolloff), (kernels.complexity, plain_complexity), (kernels.semantic_flow, plain_semantic), (kernels.golden_ratio, plain_golden),
        (kernels.aesthetic_balance, plain_balance), (kernels.tonality, plain_tonality), (kernels.rhythm, plain_rhythm), (kernels.harmony, plain_harmony),
        (kernels.tension, plain_tension), (kernels.muscle_force, plain_force), (kernels.efficiency, plain_efficiency), (kernels.expenditure, plain_expenditure),
        (kernels.hilbert_amplitude, plain_amplitude), (kernels.phase_stability, plain_stability), (kernels.robust_stabilised, plain_stabilised),
    ],
)
def test_kernel_equals_plain(kernel, plain):
    for n in (40, 64):
        x = windows(n)
        got = kernel(x)
        for row, value in zip(x.tolist(), got):
            assert abs(value - plain(row)) < 1e-6 * max(1, abs(value)), kernel.__name__
