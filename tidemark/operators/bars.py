"""Time bucketing: OHLCV bars of many sizes, gaps, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Rolling

#: Seconds of each bar size; calendar sizes have their nominal length.
SECONDS = {
    "M0.5": 30, "M1": 60, "M3": 180, "M5": 300, "M8": 480, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400,
    "H6": 21600, "H12": 43200, "D1": 86400, "W1": 604800, "MN": 2592000,
}
CALENDAR = {"W1": "week", "MN": "month"}


def bucket(ts: Column, size: str) -> Column:
    """Start of the bar that holds ts; weeks begin on Monday, months on the first."""
    if size in CALENDAR:
        return F.date_trunc(CALENDAR[size], ts)
    step = SECONDS[size] * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / step) * step)


def _base(sizes: tuple[str, ...]) -> str | None:
    """The smallest size, if all others are made of whole bars of it."""
    fixed = [x for x in sizes if x not in CALENDAR]
    base = min(fixed, key=SECONDS.__getitem__, default=None)
    day = [86400] if len(fixed) < len(sizes) else []
    return base if base and all(n % SECONDS[base] == 0 for n in [*(SECONDS[x] for x in fixed), *day]) else None


def ohlcv(ticks: DataFrame, sizes: tuple[str, ...] = ("H1",)) -> DataFrame:
    """symbol, timeframe, bucket, open, high, low, close, volume, tick_count, bid, ask, spread.

    Ticks are reduced to bars of the smallest size before any shuffle; the
    larger sizes, weeks and months come from those bars, not from the ticks.
    Open and close are those of the least and the greatest (ts, seq), whatever
    the order of arrival.
    """
    at = F.struct("ts", "seq")
    base = _base(sizes)
    gap = F.col("ask") - F.col("bid")
    if base is None:
        there = lambda c: c.isNotNull().cast("bigint")
        price = [F.col("price").alias(c) for c in ("open", "high", "low", "close")]
        counts = [F.lit(1).cast("bigint").alias("n"), there(F.col("bid")).alias("n_bid"), there(F.col("ask")).alias("n_ask"), there(gap).alias("n_gap")]
        small = ticks.select("symbol", F.col("ts").alias("_at"), at.alias("_first"), at.alias("_last"), *price, "bid", "ask", gap.alias("gap"), *counts)
    else:
        small = ticks.groupBy("symbol", bucket(F.col("ts"), base).alias("_at")).agg(
            F.min(at).alias("_first"), F.max(at).alias("_last"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("bid").alias("bid"), F.sum("ask").alias("ask"), F.sum(gap).alias("gap"),
            F.count("*").alias("n"), F.count("bid").alias("n_bid"), F.count("ask").alias("n_ask"), F.count(gap).alias("n_gap"),
        )
    # Sums to nine digits, so that the order of addition does not show.
    mean = lambda c: F.try_divide(F.round(F.sum(c), 9), F.sum(f"n_{c}"))
    if sizes == (base,):
        each = small.select("*", F.lit(base).alias("timeframe"), F.col("_at").alias("bucket"))
        return each.select(
            "symbol", "timeframe", "bucket", "open", "high", "low", "close", F.col("n").alias("volume"), F.col("n").alias("tick_count"),
            *[F.try_divide(F.round(c, 9), F.col(f"n_{c}")).alias(k) for c, k in (("bid", "bid"), ("ask", "ask"), ("gap", "spread"))],
        )
    x = F.explode(F.array(*[F.struct(F.lit(s).alias("timeframe"), bucket(F.col("_at"), s).alias("bucket")) for s in sizes]))
    return (
        small.withColumn("x", x)
        .groupBy("symbol", "x.timeframe", "x.bucket")
        .agg(
            F.min_by("open", "_first").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "_last").alias("close"),
            F.sum("n").alias("volume"),
            F.sum("n").alias("tick_count"),
            mean("bid").alias("bid"),
            mean("ask").alias("ask"),
            mean("gap").alias("spread"),
        )
    )


def passthrough(ticks: DataFrame) -> DataFrame:
    """Each tick as a bar of its own."""
    p = F.col("price")
    return ticks.select(
        "symbol", F.lit("tick").alias("timeframe"), F.col("ts").alias("bucket"), "seq",
        p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(1).alias("tick_count"), F.lit(False).alias("disc"),
    )


def gap_flags(bars: DataFrame) -> DataFrame:
    """disc: more than one and a half bars since the bar before; false for the first."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("bucket")
    length = F.create_map(*[x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v * 1_000_000))])
    delta = F.unix_micros("bucket") - F.unix_micros(F.lag("bucket").over(w))
    return bars.withColumn("disc", F.coalesce(delta > 1.5 * length[F.col("timeframe")], F.lit(False)))


def volume_fallback(ticks: DataFrame, volume: str = "volume") -> DataFrame:
    """One per tick where a symbol's largest volume is 0 or missing."""
    top = ticks.groupBy("symbol").agg(F.max(F.coalesce(volume, F.lit(0))).alias("_top"))
    use = F.when(F.col("_top") > 0, F.coalesce(volume, F.lit(0))).otherwise(F.lit(1))
    return ticks.join(top, "symbol").withColumn(volume, use).drop("_top")


def enrich(bars: DataFrame) -> DataFrame:
    """Log return, volatility, mean volume, momentum, direction and volume ratio."""
    r = Rolling(("symbol", "timeframe"))
    before = r.lag("close")
    out = bars.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))
    change = F.signum(F.col("close") - before)
    out = out.withColumns(
        {
            "rolling_volatility": F.stddev_samp("log_return").over(r.last(20)),
            "rolling_avg_volume": F.avg("volume").over(r.last(50)),
            "price_momentum": F.col("close") - r.lag("close", 5),
            "_sign": F.when(change != 0, change),
        }
    )
    w = r.base.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns(
        {
            "price_direction": F.coalesce(F.last("_sign", ignorenulls=True).over(w), F.lit(-1.0)).cast("tinyint"),
            "volume_ratio": F.col("volume") / F.when(F.col("rolling_avg_volume") == 0, 1.0).otherwise(F.col("rolling_avg_volume")),
        }
    ).drop("_sign")


def spike_guard(bars: DataFrame, low: float, high: float, most_change: float = 0.1) -> DataFrame:
    """Bars whose prices are consistent, within a range, and close to the bar before."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("bucket")
    before = F.lag("close").over(w)
    fine = (
        (F.col("high") >= F.greatest("open", "close", "low"))
        & (F.col("low") <= F.least("open", "close"))
        & F.col("close").between(low, high)
        & F.coalesce(F.abs(F.col("close") - before) <= most_change * F.abs(before), F.lit(True))
    )
    return bars.withColumn("ok", fine)


def resample(bars: DataFrame, size: str) -> DataFrame:
    """Larger bars from smaller ones; the last bucket of a symbol is withheld, as it may still be open."""
    at = F.col("bucket")
    out = bars.groupBy("symbol", bucket(F.col("bucket"), size).alias("start")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.sum("tick_count").alias("tick_count"),
    )
    end = out.groupBy("symbol").agg(F.max("start").alias("end"))
    return out.join(end, "symbol").filter("start < end").drop("end").withColumn("timeframe", F.lit(size)).withColumnRenamed("start", "bucket")


def quality_profile(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Counts of zero, missing and infinite values by column, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x.v") == 0).alias("zeros"),
        F.count_if(F.col("x.v").isNull() | F.isnan("x.v")).alias("missing"),
        F.count_if(F.abs("x.v") == float("inf")).alias("infinite"),
    )
