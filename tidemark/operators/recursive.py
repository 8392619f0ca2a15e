"""Recursions over ordered bars: exponential means, Wilder averages, clipping, thinning.

A recursion needs its whole history, so these run as one vectorised pass per
series (Arrow, grouped by symbol). `ewm_blocks` is the bounded form: blocks of
rows with enough rows before them that what is left out is below `tolerance`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def alpha(span: float | None = None, half_life: float | None = None, wilder: float | None = None) -> float:
    if span:
        return 2 / (span + 1)
    return 1 - math.exp(-math.log(2) / half_life) if half_life else 1 / wilder


def ewm(df: DataFrame, columns: dict[str, tuple[str, float]], by: str = "symbol", order: str = "bucket") -> DataFrame:
    """out -> (column, alpha): y = alpha * x + (1 - alpha) * y before; the first value starts it, nulls keep it."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{o}` double" for o in columns)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for out, (col, a) in columns.items():
            pdf[out] = pdf[col].astype(float).ewm(alpha=a, adjust=False, ignore_na=True).mean()
        return pdf

    return df.groupBy(by).applyInPandas(run, schema)


def ewm_blocks(df: DataFrame, column: str, a: float, out: str, by: str = "symbol", order: str = "bucket", tolerance: float = 1e-12, block: int = 4096) -> DataFrame:
    """The same for hot series: rows dealt out in blocks, each with the rows before it that still matter."""
    reach = max(1, math.ceil(math.log(tolerance) / math.log(1 - a)))
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = df.withColumn("_i", i)
    own = F.floor(F.col("_i") / block)
    ahead = F.sequence(own, F.floor((F.col("_i") + reach) / block))
    rows = rows.withColumn("_block", F.explode(ahead))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        pdf[out] = pdf[column].astype(float).ewm(alpha=a, adjust=False, ignore_na=True).mean()
        return pdf[pdf["_i"] // block == pdf["_block"]].drop(columns=["_i", "_block"])

    return rows.groupBy(by, "_block").applyInPandas(run, schema)


def true_range(bars: DataFrame) -> DataFrame:
    """tr: the range of a bar, reaching to the close before unless there is a gap (disc)."""
    w = Window.partitionBy("symbol").orderBy("bucket")
    before = F.lag("close").over(w)
    span = F.col("high") - F.col("low")
    wide = F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("tr", F.when(F.col("disc") | before.isNull(), span).otherwise(wide))


def atr(bars: DataFrame, period: int = 13) -> DataFrame:
    """Wilder average of the true range, in exponential form, plus a tiny constant."""
    return ewm(true_range(bars), {"atr": ("tr", 1 / period)}).withColumn("atr", F.col("atr") + EPS)


def atr_ratio(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(-(n - 1), 0)
    return bars.withColumn("atr_ratio", F.col("atr") / (F.avg("atr").over(w) + EPS))


def seeded(column: str, n: int, by: str = "symbol", order: str = "bucket") -> Column:
    """The column from its n-th row on, which has the mean of the first n: an exponential mean of it starts from a plain one."""
    w = Window.partitionBy(by).orderBy(order)
    nth = F.row_number().over(w)
    return F.when(nth == n, F.avg(column).over(w.rowsBetween(-(n - 1), 0))).when(nth > n, F.col(column))


def oscillators(bars: DataFrame, di: int = 13, tsi: int = 25) -> DataFrame:
    """RSI, MACD, direction lines, ADX, TRIX, true strength and exponential deviation.

    Direction lines divide sums that begin with the first `di` rows' own; true
    strength is null for its first tsi + tsi // 2 rows.
    """
    w = Window.partitionBy("symbol").orderBy("bucket")
    d = F.col("close") - F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = bars.withColumns(
        {
            "d": d, "gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0)), "d0": F.coalesce(d, F.lit(0.0)), "absd": F.coalesce(F.abs(d), F.lit(0.0)),
            "full": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w))),
            "pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    rows = rows.withColumns({c: F.when(F.lag("close").over(w).isNotNull(), F.col(c)) for c in ("gain", "loss")} | {c: F.when(F.lag("close").over(w).isNotNull(), F.col(c)) for c in ("pdm", "mdm")} | {"pd0": F.col("pdm"), "md0": F.col("mdm")})
    rows = rows.withColumns({"s_full": seeded("full", di), "s_pdm": seeded("pd0", di), "s_mdm": seeded("md0", di), "nth": F.row_number().over(w)})
    rows = ewm(
        rows,
        {
            "g": ("gain", alpha(wilder=14)), "s": ("loss", alpha(wilder=14)), "fast": ("close", alpha(span=12)), "slow": ("close", alpha(span=26)),
            "p": ("pdm", alpha(wilder=14)), "m": ("mdm", alpha(wilder=14)), "t1": ("close", alpha(span=14)),
            "ema20": ("close", alpha(span=20)), "d1": ("d0", alpha(span=tsi)), "a1": ("absd", alpha(span=tsi)),
            "w_full": ("s_full", 1 / di), "w_pdm": ("s_pdm", 1 / di), "w_mdm": ("s_mdm", 1 / di),
        },
    )
    rows = rows.withColumns(
        {
            "macd": F.col("fast") - F.col("slow"),
            "dx": F.abs(F.col("p") - F.col("m")) / (F.col("p") + F.col("m") + EPS) * 100,
        }
    )
    rows = ewm(rows, {"signal": ("macd", alpha(span=9)), "adx": ("dx", alpha(wilder=14)), "t2": ("t1", alpha(span=14)), "d2": ("d1", alpha(span=tsi // 2)), "a2": ("a1", alpha(span=tsi // 2))})
    rows = ewm(rows, {"t3": ("t2", alpha(span=14))})
    a = F.col("atr")
    line = lambda c: F.when((F.col("nth") > di) & (F.col("w_full") * di > EPS), F.col(c) / F.col("w_full") * 100)
    before = F.lag("t3").over(w)
    return rows.select(
        "symbol",
        "bucket",
        (100 - 100 / (1 + F.col("g") / (F.col("s") + EPS))).alias("rsi_14"),
        (F.col("macd") / a).alias("macd"),
        (F.col("signal") / a).alias("macd_signal"),
        ((F.col("macd") - F.col("signal")) / a).alias("macd_histogram"),
        line("w_pdm").alias("di_plus"),
        line("w_mdm").alias("di_minus"),
        F.col("adx").alias("adx_14"),
        ((F.col("t3") - before) / (before + EPS) * 1e4).alias("trix"),
        F.when(F.col("nth") > tsi + tsi // 2, F.coalesce(100 * F.try_divide("d2", "a2"), F.lit(0.0))).alias("tsi"),
        ((F.col("ema20") - F.col("close")) / a).alias("ema_20"),
    )


ATR_PERIODS, RSI_PERIODS, EMA_SPANS = (13, 21, 34, 55), (14, 21, 30, 50), (10, 20, 50, 100, 200)
MACD_SPANS, OSCILLATOR_SPANS, CYCLES = ((12, 26, 9), (5, 35, 5), (19, 39, 9)), ((12, 26), (5, 35), (10, 20)), ((23, 50, 10), (12, 26, 9))


def settings(bars: DataFrame) -> DataFrame:
    """True range, RSI, MACD, Schaff cycle, price oscillator and exponential deviation in all their settings.

    Three passes of exponential means, the later ones over columns of those before.
    """
    w = Window.partitionBy("symbol").orderBy("bucket")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda agg, c, n: F.when(F.count(c).over(last(n)) == n, agg(c).over(last(n)))
    lag = lambda c, k=1: F.lag(c, k).over(w)
    stochastic = lambda c, n: (F.col(c) - full(F.min, c, n)) / (full(F.max, c, n) - full(F.min, c, n) + EPS) * 100
    d = F.col("close") - lag("close")
    rows = bars.withColumns({"gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    spans = sorted({*EMA_SPANS, *(s for pair in OSCILLATOR_SPANS for s in pair), *(s for f, g, _ in MACD_SPANS for s in (f, g))})
    first = {f"a{p}": ("tr", 1 / p) for p in ATR_PERIODS} | {f"g{p}": ("gain", alpha(wilder=p)) for p in RSI_PERIODS} | {f"l{p}": ("loss", alpha(wilder=p)) for p in RSI_PERIODS}
    first |= {f"e{s}": ("close", alpha(span=s)) for s in spans} | {f"h{s}": ("close", alpha(half_life=s)) for f, g, _ in CYCLES for s in (f, g)}
    rows = ewm(rows, first)
    rows = rows.withColumns(
        {f"rsi_{p}": 100 - 100 / (1 + F.col(f"g{p}") / (F.col(f"l{p}") + EPS)) for p in RSI_PERIODS}
        | {f"m{f}": F.col(f"e{f}") - F.col(f"e{g}") for f, g, _ in MACD_SPANS}
        | {f"c{f}": F.col(f"h{f}") - F.col(f"h{g}") for f, g, _ in CYCLES}
    ).withColumns({f"x{f}": stochastic(f"c{f}", n) for f, _, n in CYCLES})
    rows = ewm(rows, {f"s{f}": (f"m{f}", alpha(span=n)) for f, _, n in MACD_SPANS} | {f"y{f}": (f"x{f}", alpha(span=3)) for f, _, _ in CYCLES})
    rows = ewm(rows.withColumns({f"z{f}": stochastic(f"y{f}", n) for f, _, n in CYCLES}), {f"t{f}": (f"z{f}", alpha(span=3)) for f, _, _ in CYCLES})
    a, c = F.col("atr"), F.col("close")
    out = []
    for p in ATR_PERIODS:
        raw = F.col(f"a{p}")
        out += [(raw / a).alias(f"atr_{p}"), (raw / (c + EPS) * 100).alias(f"atr_pct_{p}"), ((raw - lag(f"a{p}")) / a).alias(f"atr_trend_{p}"), (full(F.stddev_samp, f"a{p}", p) / a).alias(f"atr_volatility_{p}")]
    for p in RSI_PERIODS:
        out += [F.col(f"rsi_{p}"), (F.col(f"rsi_{p}") - lag(f"rsi_{p}")).alias(f"rsi_momentum_{p}")]
    for p in RSI_PERIODS[:2]:
        moved = F.try_divide(c - lag("close", p), lag("close", p))
        out += [stochastic(f"rsi_{p}", p).alias(f"stoch_rsi_{p}"), (moved - ((F.col(f"rsi_{p}") - lag(f"rsi_{p}", p)) / 50 - 1)).alias(f"rsi_divergence_{p}")]
    for f, g, n in MACD_SPANS:
        m, s = F.col(f"m{f}"), F.col(f"s{f}")
        out += [(m / a).alias(f"macd_{f}_{g}"), (s / a).alias(f"macd_signal_{f}_{g}_{n}"), ((m - s) / a).alias(f"macd_histogram_{f}_{g}_{n}")]
    out += [F.col(f"t{f}").alias(f"schaff_{f}_{g}_{n}") for f, g, n in CYCLES]
    out += [(F.try_divide(F.col(f"e{f}") - F.col(f"e{g}"), F.col(f"e{g}")) * 100).alias(f"price_oscillator_{f}_{g}") for f, g in OSCILLATOR_SPANS]
    for p in EMA_SPANS:
        out += [((F.col(f"e{p}") - c) / a).alias(f"ema_{p}"), ((c - F.col(f"e{p}")) / (F.col(f"e{p}") + EPS) * 100).alias(f"ema_deviation_{p}")]
    return rows.select("symbol", "bucket", *out)


def quality_clip(df: DataFrame, column: str, half_life: float, width: float = 5.0, by: str = "symbol", order: str = "bucket") -> DataFrame:
    """Clip to running mean +- width deviations; infinities go to the bounds, NaN and null to 0, the first value passes."""
    a = alpha(half_life=half_life)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "clipped double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[column].to_numpy(dtype=float)
        out = np.zeros(len(x))
        mean = var = weight = square = 0.0
        seen = False
        for i, v in enumerate(x):
            if math.isnan(v):
                continue
            if not seen:
                if math.isinf(v):
                    continue
                out[i], mean, seen, weight, square = v, v, True, 1.0, 1.0
                continue
            if not math.isinf(v):
                delta = v - mean
                mean += a * delta
                var = (1 - a) * (var + a * delta * delta)
                square = (1 - a) ** 2 * square + a * a
            bias = 1 - square
            dev = math.sqrt(var / bias) if bias > 1e-12 and var > 0 else 0.0
            out[i] = min(max(v, mean - width * dev), mean + width * dev) if dev > 0 or math.isinf(v) else v
        pdf["clipped"] = out
        return pdf

    return df.groupBy(by).applyInPandas(run, schema)


def thin(df: DataFrame, seconds: float, by: str = "symbol", on: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows at least `seconds` after the last row kept, in order of time; of equal times the first by `ties`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([on, *ties], kind="stable")
        t = pdf[on].to_numpy(dtype="datetime64[us]").astype(np.int64)
        step, keep, at = int(seconds * 1e6), [], 0
        while at < len(t):
            keep.append(at)
            at = max(at + 1, int(np.searchsorted(t, t[at] + step, "left")))
        return pdf.iloc[keep]

    return df.groupBy(by).applyInPandas(run, df.schema)


def error_mean(df: DataFrame, error: str, a: float = 0.02, by: str = "symbol", order: str = "bucket") -> DataFrame:
    """Running mean of an error as it was before each row; 0 at first."""
    w = Window.partitionBy(by).orderBy(order)
    return ewm(df, {"_e": (error, a)}, by, order).withColumn("error_mean", F.coalesce(F.lag("_e").over(w), F.lit(0.0))).drop("_e")


def kama(x: np.ndarray, n: int, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive moving average, started at the price; NaN before n + 1 values."""
    out, y = np.full(len(x), np.nan), np.nan
    step = np.abs(np.diff(x, prepend=x[:1]))
    path = np.cumsum(step)
    for i in range(n, len(x)):
        walked = path[i] - path[i - n]
        er = abs(x[i] - x[i - n]) / walked if walked > 0 else 0.0
        c = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        y = x[i - 1] if math.isnan(y) else y
        y = y + c * (x[i] - y)
        out[i] = y
    return out


def adaptive(bars: DataFrame) -> DataFrame:
    """Stochastic RSI, RSI divergence, Schaff cycle, price oscillator, KAMA, Chaikin volatility, mass index."""
    names = ("stoch_rsi", "rsi_divergence", "schaff", "price_oscillator", "kama", "chaikin_volatility", "mass_index")
    schema = ", ".join(["symbol string", "bucket timestamp", *(f"{c} double" for c in names)])
    ewm_of = lambda s, a: s.ewm(alpha=a, adjust=False, ignore_na=True).mean()

    def begun(s: pd.Series, n: int, at: int = 0) -> pd.Series:
        """From the n-th value after `at` on, which is the mean of those n."""
        out = s.copy()
        out.iloc[: at + n - 1] = np.nan
        if len(s) >= at + n:
            out.iloc[at + n - 1] = s.iloc[at : at + n].mean()
        return out

    def cycle(s: pd.Series, n: int) -> pd.Series:
        low, high = s.rolling(n).min(), s.rolling(n).max()
        return ewm_of((s - low) / (high - low + EPS) * 100, alpha(span=3))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable").reset_index(drop=True)
        close, a = pdf["close"].astype(float), pdf["atr"]
        d = close.diff()
        gain, loss = ewm_of(d.clip(lower=0), 1 / 14), ewm_of((-d).clip(lower=0), 1 / 14)
        rsi = 100 - 100 / (1 + gain / (loss + EPS))
        low, high = rsi.rolling(14).min(), rsi.rolling(14).max()
        macd = ewm_of(close, alpha(half_life=23)) - ewm_of(close, alpha(half_life=50))
        fast, slow = ewm_of(close, alpha(span=12)), ewm_of(close, alpha(span=26))
        span = pdf["high"] - pdf["low"]
        e10 = ewm_of(begun(span, 10), alpha(span=10))
        e9 = ewm_of(begun(span, 9), alpha(span=9))
        e99 = ewm_of(begun(e9, 9, 8), alpha(span=9))
        out = {
            "stoch_rsi": (rsi - low) / (high - low + EPS) * 100,
            "rsi_divergence": (close - close.shift(14)) / (close.shift(14) + EPS) - (rsi.diff(14) / 50 - 1),
            "schaff": cycle(cycle(macd, 10), 10),
            "price_oscillator": (fast - slow) / (slow + EPS) * 100,
            "kama": (pd.Series(kama(close.to_numpy(), 21)) - close) / a,
            "chaikin_volatility": ((e10 - e10.shift(10)) / e10.shift(10) * 100).where(e10.shift(10) > 0),
            "mass_index": (e9 / e99).where(e99 > 0).rolling(20).sum(),
        }
        return pd.DataFrame({"symbol": pdf["symbol"], "bucket": pdf["bucket"], **out})

    return bars.select("symbol", "bucket", "high", "low", "close", "atr").groupBy("symbol").applyInPandas(run, schema)
