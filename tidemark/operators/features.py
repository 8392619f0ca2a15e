"""Rolling feature families over bars (symbol, bucket, open, high, low, close, volume).

Distances are in units of `atr`, which callers put on the bars (operators.recursive).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import EPS, Rolling

R = Rolling()
KEYS = ("symbol", "bucket")


def rolling_stats(bars: DataFrame, sizes: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Distances of mean, median, extremes and quantiles; scaled spread; z-score and bands."""
    c = F.col("close")
    out = [*KEYS]
    for n in sizes:
        m, s, v = R.mean("close", n), R.std("close", n), R.var("close", n)
        out += [
            ((c - m) / F.col("atr")).alias(f"mean_{n}"),
            (v / (F.col("atr") * F.col("atr"))).alias(f"variance_{n}"),
            (s / F.col("atr")).alias(f"std_{n}"),
            (s / (m + EPS)).alias(f"cv_{n}"),
            ((c - R.quantile("close", 0.5, n)) / F.col("atr")).alias(f"median_{n}"),
            ((R.min("close", n) - c) / F.col("atr")).alias(f"min_{n}"),
            ((R.max("close", n) - c) / F.col("atr")).alias(f"max_{n}"),
            ((c - m) / (s + EPS)).alias(f"zscore_{n}"),
            ((m + 2 * s - c) / F.col("atr")).alias(f"upper_{n}"),
            ((m - 2 * s - c) / F.col("atr")).alias(f"lower_{n}"),
        ]
    return bars.select(*out)


def quantile_stats(bars: DataFrame, n: int = 20) -> DataFrame:
    """Nearest-rank quartiles, trimmed and winsorised means, median absolute deviation."""
    out = bars.select(*KEYS, "close", "atr", R.values("close", n).alias("x"))
    s = F.array_sort("x")
    k = int(0.1 * n)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)

    def linear(a: Column, p: float) -> Column:
        at = p * (n - 1)
        low = int(at)
        return F.element_at(a, low + 1) + (F.element_at(a, min(low + 2, n)) - F.element_at(a, low + 1)) * (at - low)

    med = linear(s, 0.5)
    near = lambda p: F.element_at(s, int(p * (n - 1) + 0.5) + 1)
    dev = F.array_sort(F.transform("x", lambda v: F.abs(v - F.col("med"))))
    out = out.withColumn("med", med)
    return out.select(
        *KEYS,
        ((F.col("close") - near(0.25)) / F.col("atr")).alias(f"q25_{n}"),
        ((F.col("close") - near(0.75)) / F.col("atr")).alias(f"q75_{n}"),
        ((near(0.75) - near(0.25)) / F.col("atr")).alias(f"iqr_{n}"),
        (total(F.slice(s, k + 1, n - 2 * k)) / (n - 2 * k)).alias(f"trimmed_{n}"),
        (total(F.transform("x", lambda v: F.greatest(F.least(v, linear(s, 0.95)), linear(s, 0.05)))) / n).alias(f"winsor_{n}"),
        (linear(dev, 0.5) / F.col("atr")).alias(f"mad_{n}"),
    )


def moments(bars: DataFrame, n: int = 20) -> DataFrame:
    """Population skewness; kurtosis and higher moments from each row's own rolling mean; normality and tails of returns."""
    rows = bars.withColumns({"m": R.mean("close", n), "v0": R.complete(F.var_pop("close"), F.col("close"), n), "r": R.pct("close")})
    dev = F.col("close") - F.col("m")
    z = dev / F.sqrt(F.col("v0") + EPS)
    rows = rows.withColumns({"d4": F.pow(dev, 4), "z5": F.pow(z, 5), "z6": F.pow(z, 6), "z7": F.pow(z, 7), "z8": F.pow(z, 8)})
    w = R.last(n)
    skew = R.complete(F.avg(F.pow("close", 3)), F.col("close"), n) - 3 * F.col("m") * R.complete(F.avg(F.pow("close", 2)), F.col("close"), n)
    skew = (skew + 2 * F.pow("m", 3)) / F.pow(F.sqrt(F.col("v0") + EPS), 3)
    r1, r2 = F.avg("r").over(w), F.avg(F.col("r") * F.col("r")).over(w)
    r3, r4 = F.avg(F.pow("r", 3)).over(w), F.avg(F.pow("r", 4)).over(w)
    var = r2 - r1 * r1
    third, fourth = r3 - 3 * r1 * r2 + 2 * F.pow(r1, 3), r4 - 4 * r1 * r3 + 6 * r1 * r1 * r2 - 3 * F.pow(r1, 4)
    rs, rk = third / F.pow(F.sqrt(var) + EPS, 3), fourth / F.pow(F.sqrt(var) + EPS, 4) - 3
    # Variances of skewness and kurtosis of n normal values.
    c1 = 6.0 * (n - 2) / ((n + 1) * (n + 3))
    c2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    # Fourth moment on the unbiased deviation; its excess gives the degrees of freedom of a t distribution.
    m4 = fourth / F.pow(var * n / (n - 1), 2)
    dof = F.when(var <= 0, None).when(m4 > 3, F.greatest(F.least(4 * (3 + m4) / (m4 - 3), F.lit(100.0)), F.lit(2.1))).otherwise(100.0)
    there = F.count("r").over(w) == n
    scale = F.sqrt(F.greatest(var * n / (n - 1) * (dof - 2) / dof, F.lit(1e-8))) / (F.stddev_samp("r").over(w) + EPS)
    return rows.select(
        *KEYS,
        skew.alias(f"skew_{n}"),
        (R.mean("d4", n) / (F.col("v0") * F.col("v0") + EPS) - 3).alias(f"kurtosis_{n}"),
        R.mean("z5", n).alias(f"moment5_{n}"),
        R.mean("z6", n).alias(f"moment6_{n}"),
        R.mean("z7", n).alias(f"moment7_{n}"),
        R.mean("z8", n).alias(f"moment8_{n}"),
        F.when(there, rs * rs / c1 + rk * rk / c2).alias(f"jarque_bera_{n}"),
        F.when(there, dof).alias(f"tail_dof_{n}"),
        F.when(there, scale).alias(f"tail_scale_{n}"),
    )


def momentum(bars: DataFrame) -> DataFrame:
    """Price changes, their volatility, momentum oscillators without recursion."""
    rows = bars.withColumns({"r": R.pct("close"), "rv": F.col("volume") / (R.mean("volume", 20) + EPS)})
    roc = lambda k: R.pct("close", k)
    for k in (10, 11, 14, 15, 20, 30):
        rows = rows.withColumn(f"roc{k}", roc(k))
    rows = rows.withColumn("prv", F.col("r") * F.col("rv"))
    kst = sum((w * F.col(f"roc{k}") for w, k in ((1, 10), (2, 15), (3, 20), (4, 30))), F.lit(0.0)) / 10 * 100
    rows = rows.withColumns({"kst": kst, "copp": F.col("roc11") + F.col("roc14")})
    return rows.select(
        *KEYS,
        F.col("r").alias("change"),
        R.std("r", 20).alias("volatility_20"),
        ((F.col("high") - F.col("low")) / F.col("atr")).alias("range"),
        R.mean("prv", 10).alias("volume_price_trend"),
        (F.col("roc10") * 100).alias("rate_of_change_10"),
        ((F.col("close") - R.lag("close", 10)) / F.col("atr")).alias("momentum_10"),
        F.col("kst"),
        R.mean("kst", 9).alias("kst_signal"),
        R.mean("copp", 10).alias("coppock"),
    )


def place(c: str, n: int) -> Column:
    """The row number (i) of the largest of the last n values; of equal ones this row's, else the oldest's."""
    w = R.last(n)
    return F.when(F.col(c) == F.max(c).over(w), F.col("i")).otherwise(F.max_by("i", F.struct(F.col(c), -F.col("i"))).over(w))


def channels(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bollinger, Donchian, Aroon, Williams, stochastic, pivot and mid-range levels."""
    c, a = F.col("close"), F.col("atr")
    hi, lo = R.max("high", n), R.min("low", n)
    m, s = R.mean("close", n), R.std("close", n)
    rows = bars.withColumns({"hi": hi, "lo": lo, "m": m, "s": s, "i": F.row_number().over(R.base)})
    span = F.col("hi") - F.col("lo")
    rows = rows.withColumn("down", -F.col("low")).withColumn("k", F.when(span != 0, (c - F.col("lo")) / span * 100).otherwise(F.when(span == 0, 50.0)))
    up, down = place("high", n), place("down", n)
    full = F.col("hi").isNotNull()
    prev = lambda x: R.lag(x)
    pivot = (prev("hi") + prev("lo") + prev("close")) / 3
    width = 4 * F.col("s")
    return rows.select(
        *KEYS,
        ((F.col("m") + 2 * F.col("s") - c) / a).alias("bb_upper"),
        ((F.col("m") - 2 * F.col("s") - c) / a).alias("bb_lower"),
        (width / a).alias("bb_width"),
        ((c - (F.col("m") - 2 * F.col("s"))) / (width + EPS)).alias("bb_percent"),
        ((F.col("hi") - c) / a).alias("donchian_upper"),
        (((F.col("hi") + F.col("lo")) / 2 - c) / a).alias("donchian_middle"),
        ((F.col("lo") - c) / a).alias("donchian_lower"),
        F.when(full, 100.0 * (n - (F.col("i") - up)) / n).alias("aroon_up"),
        F.when(full, 100.0 * (n - (F.col("i") - down)) / n).alias("aroon_down"),
        F.when(span != 0, -100 * (F.col("hi") - c) / span).otherwise(F.when(span == 0, -50.0)).alias("williams_r"),
        F.col("k").alias("stoch_k"),
        R.mean("k", 3).alias("stoch_d"),
        ((c - F.col("m")) / a).alias("dpo"),
        ((pivot - c) / a).alias("pivot"),
        ((2 * pivot - prev("lo") - c) / a).alias("resistance1"),
        ((2 * pivot - prev("hi") - c) / a).alias("support1"),
        ((F.col("lo") + 0.5 * span - c) / a).alias("fib_50"),
    )


def weighted(c: str, n: int, oldest_heaviest: bool = False) -> Column:
    """Linearly weighted mean of the last n values."""
    total = sum(((k + 1 if oldest_heaviest else n - k) * R.lag(c, k) for k in range(n)), F.lit(0.0))
    return total / (n * (n + 1) / 2)


def trend(bars: DataFrame, n: int = 20) -> DataFrame:
    """Moving averages, their deviation, slope, strength and consistency."""
    c, a = F.col("close"), F.col("atr")
    half, root = n // 2, int(math.sqrt(n))
    rows = bars.withColumns(
        {
            "sma": R.mean("close", n),
            "s": R.std("close", n),
            "wma": weighted("close", n),
            "raw": 2 * weighted("close", half, True) - weighted("close", n, True),
            "up": F.signum(c - R.lag("close")),
        }
    )
    rows = rows.withColumn("turn", F.abs(F.col("up") - R.lag("up")))
    rvi_n, rvi_d = R.mean(c - F.col("open"), 10), R.mean(F.col("high") - F.col("low"), 10)
    rows = rows.withColumn("rvi", rvi_n / (rvi_d + EPS))
    return rows.select(
        *KEYS,
        ((F.col("sma") - c) / a).alias("sma"),
        ((c - F.col("sma")) / (F.col("sma") + EPS) * 100).alias("sma_deviation"),
        ((F.col("wma") - c) / a).alias("wma"),
        ((weighted("raw", root, True) - c) / a).alias("hma"),
        (6 * (F.col("wma") - F.col("sma")) / (n - 1) / a).alias("slope"),
        F.least(1 / (F.col("s") / a + EPS), F.lit(100.0)).alias("strength"),
        (1 - R.mean("turn", n) / 2).alias("consistency"),
        F.col("rvi"),
        R.mean("rvi", 4).alias("rvi_signal"),
    )


def volume(bars: DataFrame, n: int = 13) -> DataFrame:
    """Money flow, volume-weighted price, balance and force."""
    c, v, a = F.col("close"), F.col("volume"), F.col("atr")
    span = F.col("high") - F.col("low")
    tp = (F.col("high") + F.col("low") + c) / 3
    rows = bars.withColumns({"tp": tp, "clv": F.when(span > 0, ((c - F.col("low")) - (F.col("high") - c)) / span), "vm": R.mean("volume", 20)})
    rows = rows.withColumns({"dtp": F.col("tp") - R.lag("tp"), "dc": c - R.lag("close")})
    pos = R.sum(F.when(F.col("dtp") > 0, F.col("tp") * v).otherwise(F.when(F.col("dtp").isNotNull(), 0.0)), n)
    neg = R.sum(F.when(F.col("dtp") < 0, F.col("tp") * v).otherwise(F.when(F.col("dtp").isNotNull(), 0.0)), n)
    cv = F.sum(F.when(span > 0, F.col("clv") * v)).over(R.last(n))
    sv = F.sum(F.when(span > 0, v)).over(R.last(n))
    there = F.count(F.lit(1)).over(R.last(n)) == n
    return rows.select(
        *KEYS,
        F.when(there, F.coalesce(F.try_divide(cv, sv), F.lit(0.0))).alias("cmf"),
        F.when(neg > 0, 100 - 100 / (1 + pos / neg)).when(pos > 0, 100.0).when(pos == 0, 50.0).alias("mfi"),
        ((c - R.sum(F.col("tp") * v, n) / (R.sum("volume", n) + EPS)) / a).alias("vwap"),
        (F.signum("dc") * v / (F.col("vm") + EPS)).alias("obv"),
        (F.coalesce(F.col("clv"), F.lit(0.0)) * v / (F.col("vm") + EPS)).alias("accumulation"),
        (F.col("dc") * v / (a * F.col("vm") + EPS)).alias("force"),
        (v / (F.col("vm") + EPS)).alias("volume_ratio"),
    )


def price_action(bars: DataFrame) -> DataFrame:
    """Candle anatomy, patterns, and gaps."""
    o, h, l, c, a = (F.col(x) for x in ("open", "high", "low", "close", "atr"))
    body, top, bottom, span = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - l, h - l
    pattern = (
        F.when(span <= 0, 0)
        .when(body / span < 0.1, 3)
        .when((bottom / span > 0.6) & (top / span < 0.1), 1)
        .when((top / span > 0.6) & (bottom / span < 0.1), 2)
        .when((body / span > 0.6) & (c > o), 4)
        .when((body / span > 0.6) & (c < o), 5)
        .otherwise(0)
    )
    return bars.select(
        *KEYS,
        pattern.alias("pattern"),
        ((c - (h + l + c) / 3) / a).alias("typical"),
        ((c - (h + l + 2 * c) / 4) / a).alias("weighted"),
        ((c - (h + l) / 2) / a).alias("median"),
        (body / a).alias("body"),
        (top / (span + EPS)).alias("upper_wick"),
        (bottom / (span + EPS)).alias("lower_wick"),
        ((c - l) / (span + EPS)).alias("location"),
        ((c - o) / (o + EPS)).alias("intraday"),
        ((o - R.lag("close")) / (R.lag("close") + EPS)).alias("gap"),
    )


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Historical volatility and energy of returns."""
    rows = bars.withColumn("r", R.pct("close")).withColumn("hv", R.std("r", n))
    r2 = F.col("r") * F.col("r")
    cross = F.when((F.col("r") * R.lag("r")) < 0, 1.0).otherwise(F.when(R.lag("r").isNotNull(), 0.0))
    rows = rows.withColumns({"r2": r2, "x": F.abs("r"), "cross": cross})
    rms = F.sqrt(R.mean("r2", n))
    dev = rows.withColumn("von", F.pow(F.col("r") - R.lag("r"), 2))
    mean = R.mean("r", n)
    return dev.select(
        *KEYS,
        (F.col("hv") * math.sqrt(252)).alias("hv_annual"),
        R.sum("r2", n).alias("energy"),
        (R.max("x", n) / (F.col("hv") + EPS)).alias("peak"),
        rms.alias("rms"),
        (R.max("x", n) / (rms + EPS)).alias("crest"),
        (R.std("x", n) / (R.mean("x", n) + EPS)).alias("amplitude_cv"),
        ((R.max("close", n) - R.min("close", n)) / F.col("atr")).alias("peak_to_peak"),
        (R.sum("cross", n) / (2 * n)).alias("crossings"),
        F.least(F.greatest(R.sum("von", n) / (R.sum("r2", n) - n * mean * mean + 1e-12), F.lit(0.0)), F.lit(4.0)).alias("von_neumann"),
        (-R.sum(F.col("r2") * F.log2(F.col("r2") + EPS), n)).alias("wavelet_entropy"),
    )


def oscillators(bars: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index, ultimate oscillator, stabilised price, volatility regime, data quality."""
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    before = R.lag("close")
    rows = bars.withColumns(
        {
            "tp": (h + l + c) / 3,
            "bp": c - F.least(l, before),
            "rng": F.greatest(h, before) - F.least(l, before),
            "r": R.pct("close"),
        }
    )
    rows = rows.withColumns({"tps": R.values("tp", n), "tpm": R.mean("tp", n), "hv": R.std("r", n)})
    dev = F.aggregate("tps", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("tpm"))) / n
    average = lambda k: R.sum("bp", k) / (R.sum("rng", k) + EPS)
    # As far as the window has come; the first two bars stay as they are.
    lo, hi = F.min("close").over(R.last(n)), F.max("close").over(R.last(n))
    inner = F.greatest(F.least(c, hi - 0.01 * (hi - lo)), lo + 0.01 * (hi - lo))
    early = F.count(F.lit(1)).over(R.last(n)) <= 2
    q60, q80 = R.quantile("hv", 0.6, 3 * n), R.quantile("hv", 0.8, 3 * n)
    regime = F.coalesce((F.col("hv") > q80).cast("int") + (F.col("hv") > q60).cast("int"), F.lit(0))
    return rows.select(
        *KEYS,
        ((F.col("tp") - F.col("tpm")) / (0.015 * dev + EPS)).alias("cci"),
        (100 * (4 * average(7) + 2 * average(14) + average(28)) / 7).alias("ultimate"),
        F.when(early | (hi - lo <= EPS), c).otherwise(inner).alias("stabilised"),
        regime.alias("regime"),
        F.when(F.count(F.lit(1)).over(R.last(n)) == n, 0.8 * F.count("r").over(R.last(n)) / n + 0.2).otherwise(0.0).alias("quality"),
    )


BAND_SIZES, BAND_WIDTHS, AROON_SIZES, STOCHASTIC = (20, 30, 50), (2, 2.5, 3), (14, 25, 50), ((14, 3, 3), (21, 5, 5), (9, 3, 3))


def settings(bars: DataFrame) -> DataFrame:
    """Bollinger bands, Aroon and stochastic lines in all their settings."""
    a, c = F.col("atr"), F.col("close")
    rows = bars.withColumns({"i": F.row_number().over(R.base), "down": -F.col("low")})
    raw = {}
    for p in BAND_SIZES:
        raw |= {f"m{p}": R.mean("close", p), f"s{p}": R.std("close", p)}
    for p, _, _ in STOCHASTIC:
        lo, hi = R.min("low", p), R.max("high", p)
        raw[f"q{p}"] = F.when(hi - lo > 0, 100 * (c - lo) / (hi - lo)).when(hi.isNotNull(), 50.0)
    for p in AROON_SIZES:
        there = F.count(F.lit(1)).over(R.last(p)) == p
        raw |= {f"u{p}": F.when(there, 100.0 * (p - (F.col("i") - place("high", p))) / p), f"w{p}": F.when(there, 100.0 * (p - (F.col("i") - place("down", p))) / p)}
    rows = rows.withColumns(raw)
    rows = rows.withColumns({f"k{p}": R.mean(f"q{p}", d) for p, d, _ in STOCHASTIC})
    rows = rows.withColumns({f"d{p}": R.mean(f"k{p}", d) for p, d, _ in STOCHASTIC})
    out = []
    for p in BAND_SIZES:
        m, s = F.col(f"m{p}"), F.col(f"s{p}")
        for k in BAND_WIDTHS:
            name = f"{p}_{str(k).replace('.', 'h')}"
            low, wide = c - (m - k * s), 2 * k * s
            out += [
                ((m + k * s - c) / a).alias(f"bb_upper_{name}"),
                (low / a).alias(f"bb_lower_{name}"),
                (low / (wide + EPS)).alias(f"bb_percent_{name}"),
                (wide / a).alias(f"bb_width_{name}"),
                (wide / (m + EPS) * 100).alias(f"bb_width_pct_{name}"),
                ((c - m) / (s + EPS)).alias(f"bb_position_{name}"),
            ]
    for p in AROON_SIZES:
        out += [F.col(f"u{p}").alias(f"aroon_up_{p}"), F.col(f"w{p}").alias(f"aroon_down_{p}"), (F.col(f"u{p}") - F.col(f"w{p}")).alias(f"aroon_oscillator_{p}")]
    for p, d, s in STOCHASTIC:
        out += [F.col(f"k{p}").alias(f"stoch_k_{p}"), F.col(f"d{p}").alias(f"stoch_d_{p}_{d}"), R.mean(f"d{p}", s).alias(f"stoch_slow_d_{p}_{d}_{s}")]
    return rows.select(*KEYS, *out)


FAST_SIZES, WAVELET_SIZES = (5, 10, 20, 50, 100), (32, 64, 128, 256)


def relative_means(bars: DataFrame, lookback: int = 1440, n: int = 100) -> DataFrame:
    """Volume means against the mean of `lookback` bars; means and spreads of returns; their energy against the true range."""
    rows = bars.withColumns({"r": R.pct("close"), "base": R.mean("volume", lookback) + EPS})
    rows = rows.withColumns({"rel": F.col("volume") / F.col("base"), "x": F.abs("r"), "r2": F.col("r") * F.col("r")})
    out = [(R.mean("volume", p) / F.col("base")).alias(f"volume_mean_{p}") for p in FAST_SIZES]
    out += [R.mean("rel", 20).alias("volume_ma_20")]
    for p in WAVELET_SIZES:
        out += [R.mean("r", p).alias(f"wavelet_mean_{p}"), R.std("r", p).alias(f"wavelet_std_{p}")]
    share = F.col("atr") / (F.col("close") + EPS)
    out += [
        R.mean("x", n).alias("amplitude_mean"),
        R.std("x", n).alias("amplitude_std"),
        (R.std("x", n) / (R.mean("x", n) + EPS)).alias("amplitude_cv"),
        (R.sum("r2", n) / (share * share * n + EPS)).alias("energy_ratio"),
    ]
    return rows.select(*KEYS, *out)
