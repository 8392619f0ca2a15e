"""Every query of the analytics library by name, with its SQL oracle.

The events table serves as ticks (symbol = event_type), hourly bars are built
from it; lineitem serves as trades. Times come out as seconds, doubles rounded
to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import Rolling
from tidemark.operators import analytics, bars, features, joins, recursive, selection
from tidemark.sources.ticks import derived, event_ticks, valid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as seconds, dates as text, doubles rounded."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("timestamp"):
            c = F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.gap_flags(bars.ohlcv(event_ticks(spark, sf_dir), ("H1",)))


def atr_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.atr(hour_bars(spark, sf_dir))


TICKS = "t as (select event_type as symbol, ts, event_id as seq, value as price, value - 0.01 as bid, value + 0.01 as ask, user_id from events)"
BARS = TICKS + """,
b0 as (select symbol, date_trunc('hour', ts) as bucket, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low,
              arg_max(price, (ts, seq)) as close, count(*) as volume from t group by all),
b1 as materialized (
       select *, coalesce(epoch_us(bucket) - epoch_us(lag(bucket) over s) > 5400000000, false) as disc, lag(close) over s as pc, row_number() over s as i
       from b0 window s as (partition by symbol order by bucket)),
b2 as materialized (select *, case when disc or pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from b1)"""
ATR = BARS + """,
rec as (select symbol, i, tr as a from b2 where i = 1
        union all select b2.symbol, b2.i, b2.tr / 13.0 + (1 - 1 / 13.0) * a from rec join b2 on b2.symbol = rec.symbol and b2.i = rec.i + 1),
b as materialized (select b2.*, a + 1e-10 as atr from b2 join rec using (symbol, i))"""
EWITH, RWITH = "with ", "with recursive "


def over(n: int) -> str:
    return f"over (partition by symbol order by bucket rows between {n - 1} preceding and current row)"


def full(agg: str, c: str, n: int) -> str:
    return f"case when count({c}) {over(n)} = {n} then {agg} {over(n)} end"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) over (partition by symbol order by bucket)"


def final(columns: dict[str, str], source: str, keys: str = "symbol, epoch(bucket)::bigint as bucket") -> str:
    return f"select {keys}, " + ", ".join(f"round({v}, 6) + 0 as {k}" for k, v in columns.items()) + f" from {source}"


def staged(stages: list[dict[str, str]], columns: dict[str, str], head: str = RWITH + ATR, source: str = "b") -> str:
    """Stages of named expressions, each over the one before, then the rounded columns."""
    sql = head
    for k, stage in enumerate(stages):
        sql += f", s{k} as (select *, " + ", ".join(f"{v} as {n}" for n, v in stage.items()) + f" from {source})"
        source = f"s{k}"
    return sql + " " + final(columns, source)


def ewms(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursion over the rows of `source` (by i): exponential means that start at the first value and that nulls keep."""
    step = ", ".join(f"case when s.{c} is null then r.{o} when r.{o} is null then s.{c} else {a!r} * s.{c} + (1 - {a!r}) * r.{o} end as {o}" for o, (c, a) in columns.items())
    return (
        f", {name}_r as (select symbol, i, " + ", ".join(f"{c}::double as {o}" for o, (c, _) in columns.items()) + f" from {source} where i = 1 union all"
        f" select s.symbol, s.i, {step} from {name}_r r join {source} s on s.symbol = r.symbol and s.i = r.i + 1),"
        f" {name} as materialized (select s.*, " + ", ".join(f"r.{o}" for o in columns) + f" from {source} s join {name}_r r using (symbol, i))"
    )


def stage(name: str, source: str, columns: dict[str, str]) -> str:
    return f", {name} as materialized (select *, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {source})"


def seed(c: str, n: int) -> str:
    """The column from its n-th row on, which has the mean of the first n."""
    return f"case when i = {n} then avg({c}) {over(n)} when i > {n} then {c} end"


def place(c: str, n: int) -> str:
    return f"case when {c} = max({c}) {over(n)} then i else arg_max(i, ({c}, -i)) {over(n)} end"


# --- ticks and bars ---------------------------------------------------------------------------------------------


@query(
    "tick_clean",
    EWITH + TICKS + """ select symbol, seq, epoch(date_trunc('second', ts))::bigint as ts, round(ask - bid, 6) as spread, round((ask + bid) / 2, 6) as mid_price,
    year(ts)::int as year, month(ts)::int as month, day(ts)::int as day from t where ts is not null and bid > 0 and ask > 0""",
)
def tick_clean(spark, sf_dir):
    return derived(valid(event_ticks(spark, sf_dir))).select("symbol", "seq", "ts", "spread", "mid_price", "year", "month", "day")


_SIZES = ("M3", "M15", "H1", "H4", "D1", "W1", "MN")


@query(
    "ohlcv_multi_tf",
    EWITH + TICKS + ", x as (" + " union all ".join(
        f"select *, '{s}' as timeframe, " + (f"date_trunc('{bars.CALENDAR[s]}', ts)" if s in bars.CALENDAR else f"make_timestamp(epoch_us(ts) // {bars.SECONDS[s]}000000 * {bars.SECONDS[s]}000000)") + " as bucket from t"
        for s in _SIZES
    ) + """) select symbol, timeframe, epoch(bucket)::bigint as bucket, round(arg_min(price, (ts, seq)), 6) as open, round(max(price), 6) as high,
    round(min(price), 6) as low, round(arg_max(price, (ts, seq)), 6) as close, count(*) as volume, count(*) as tick_count,
    round(round(sum(bid), 9) / count(bid), 6) as bid, round(round(sum(ask), 9) / count(ask), 6) as ask, round(round(sum(ask - bid), 9) / count(ask - bid), 6) as spread from x group by all""",
)
def ohlcv_multi_tf(spark, sf_dir):
    return bars.ohlcv(event_ticks(spark, sf_dir), _SIZES)


@query("tick_passthrough", EWITH + TICKS + " select symbol, 'tick' as timeframe, epoch(date_trunc('second', ts))::bigint as bucket, seq, round(price, 6) as open, round(price, 6) as high, round(price, 6) as low, round(price, 6) as close, 1 as tick_count, false as disc from t")
def tick_passthrough(spark, sf_dir):
    return bars.passthrough(event_ticks(spark, sf_dir))


@query("gap_flags", EWITH + BARS + " select symbol, epoch(bucket)::bigint as bucket, disc from b1")
def gap_flags(spark, sf_dir):
    return hour_bars(spark, sf_dir).select("symbol", "bucket", "disc")


@query(
    "volume_fallback",
    EWITH + TICKS + """, v as (select symbol, seq, case when symbol < 'm' then 0 else user_id % 7 end as volume from t),
    m as (select symbol, max(coalesce(volume, 0)) as top from v group by 1)
    select v.symbol, seq, case when top > 0 then coalesce(volume, 0) else 1 end::bigint as volume from v join m using (symbol)""",
)
def volume_fallback(spark, sf_dir):
    v = F.when(F.col("symbol") < "m", 0).otherwise(F.col("user_id") % 7).cast("bigint")
    return bars.volume_fallback(event_ticks(spark, sf_dir).select("symbol", "seq", v.alias("volume"))).withColumn("volume", F.col("volume").cast("bigint"))


@query(
    "enrich_bars",
    EWITH + BARS + f""", e as (select *, case when close > 0 and pc > 0 then ln(close / pc) end as lr, sign(close - pc) as sg from b1),
    f as (select *, stddev_samp(lr) {over(20)} as vol, avg(volume) {over(50)} as av, close - {lag('close', 5)} as mom,
          last_value(nullif(sg, 0) ignore nulls) over (partition by symbol order by bucket rows unbounded preceding) as dir from e)
    select symbol, epoch(bucket)::bigint as bucket, round(lr, 6) as log_return, round(vol, 6) as rolling_volatility, round(av, 6) as rolling_avg_volume,
    round(mom, 6) as price_momentum, coalesce(dir, -1)::tinyint as price_direction, round(volume / case when av = 0 then 1 else av end, 6) as volume_ratio from f""",
)
def enrich_bars(spark, sf_dir):
    return bars.enrich(hour_bars(spark, sf_dir)).select("symbol", "bucket", "log_return", "rolling_volatility", "rolling_avg_volume", "price_momentum", "price_direction", "volume_ratio")


@query(
    "ohlc_guard",
    EWITH + BARS + """ select symbol, epoch(bucket)::bigint as bucket, high >= greatest(open, close, low) and low <= least(open, close) and close between 1 and 400
    and coalesce(abs(close - pc) <= 0.5 * abs(pc), true) as ok from b1""",
)
def ohlc_guard(spark, sf_dir):
    return bars.spike_guard(hour_bars(spark, sf_dir), 1, 400, 0.5).select("symbol", "bucket", "ok")


@query(
    "resample_closed",
    EWITH + BARS + """, r as (select symbol, make_timestamp(epoch_us(bucket) // 14400000000 * 14400000000) as start, arg_min(open, bucket) as open, max(high) as high,
    min(low) as low, arg_max(close, bucket) as close, sum(volume)::bigint as volume, sum(volume)::bigint as tick_count from b0 group by all)
    select symbol, epoch(start)::bigint as bucket, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, tick_count, 'H4' as timeframe
    from r where start < (select max(start) from r q where q.symbol = r.symbol)""",
)
def resample_closed(spark, sf_dir):
    return bars.resample(hour_bars(spark, sf_dir), "H4")


@query(
    "quality_profile",
    EWITH + BARS + """, p as (select open, high, low, close, pc from b1), u as (unpivot p on open, high, low, close, pc into name name value v),
    n as (select count(*) as n from b1)
    select c.name, n.n, coalesce(z, 0) as zeros, n.n - coalesce(k, 0) as missing, coalesce(f, 0) as infinite
    from (values ('open'), ('high'), ('low'), ('close'), ('pc')) c(name) cross join n left join
    (select name, count(*) filter (v = 0) as z, count(*) filter (not isnan(v)) as k, count(*) filter (isinf(v)) as f from u group by 1) q on q.name = c.name""",
)
def quality_profile(spark, sf_dir):
    rows = hour_bars(spark, sf_dir).withColumn("pc", Rolling(("symbol", "timeframe")).lag("close"))
    return bars.quality_profile(rows, ("open", "high", "low", "close", "pc"))


# --- joins in time ----------------------------------------------------------------------------------------------


def _bets(spark, sf_dir):
    ticks = event_ticks(spark, sf_dir)
    return ticks.select(F.col("seq").alias("id"), "symbol", F.col("ts").alias("t0"), F.col("price").alias("close"), (F.lit(5.0) + F.col("seq") % 7).alias("atr"))


_BETS = TICKS + ", bets as (select seq as id, symbol, ts as t0, price as close, 5.0 + seq % 7 as atr from t)"


def _asof_sql(way: str) -> str:
    return EWITH + BARS + f""", r as (select symbol as s, bucket as rts, close as rprice from b1)
    select t.symbol, t.seq, epoch(rts)::bigint as rbucket, round(rprice, 6) as rprice from t asof left join r on t.symbol = r.s and t.ts {way} r.rts"""


def _asof(spark, sf_dir, forward):
    right = hour_bars(spark, sf_dir).select("symbol", F.col("bucket").cast("timestamp").alias("ts"), "bucket", "close")
    left = event_ticks(spark, sf_dir).select("symbol", "seq", F.col("ts").cast("timestamp").alias("ts"))
    return joins.asof(left, right, "symbol", "ts", {"bucket": "rbucket", "close": "rprice"}, forward=forward).select("symbol", "seq", "rbucket", "rprice")


@query("asof_backward", _asof_sql(">="))
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query("asof_forward", _asof_sql("<="))
def asof_forward(spark, sf_dir):
    return _asof(spark, sf_dir, True)


def _barrier_sql(target: str = "1.0", stop: str = "5.0", horizon: int = 14400, extra: str = "", bets: str = "bets", keys: str = "id") -> str:
    return f"""h as (select {keys}, b.symbol, b.t0, b.close, b.atr,
      min(t.ts) filter (price >= b.close + atr * {target} + 0.5) as lp, min(t.ts) filter (price <= b.close - atr * {stop} + 0.5) as ls,
      min(t.ts) filter (price <= b.close - atr * {target} - 0.5) as sp, min(t.ts) filter (price >= b.close + atr * {stop} - 0.5) as ss
      from {bets} b left join t on t.symbol = b.symbol and t.ts > b.t0 and t.ts <= b.t0 + interval {horizon} second group by all),
    j as (select *, lp is not null and (ls is null or lp < ls) as wl, sp is not null and (ss is null or sp < ss) as ws from h),
    k as (select *, coalesce(epoch_us(case when wl then lp else ls end) - epoch_us(t0), {horizon}000000) / 60e6 as dl,
      coalesce(epoch_us(case when ws then sp else ss end) - epoch_us(t0), {horizon}000000) / 60e6 as ds from j)"""


@query(
    "triple_barrier",
    EWITH + _BETS + ", " + _barrier_sql() + " select id, symbol, epoch(date_trunc('second', t0))::bigint as t0, round(close, 6) as close, atr::double as atr, wl::int as label_long, round(dl * 60e6)::bigint as duration_long_us, ws::int as label_short, round(ds * 60e6)::bigint as duration_short_us from k",
)
def triple_barrier(spark, sf_dir):
    got = joins.triple_barrier(_bets(spark, sf_dir), event_ticks(spark, sf_dir), 14400, 1.0, 5.0, 0.5)
    # Whole microseconds: minutes rounded to six digits would have ties.
    whole = {f"duration_{s}_us": F.round(F.col(f"duration_{s}") * 60e6).cast("bigint") for s in ("long", "short")}
    return got.withColumns(whole).drop("duration_long", "duration_short")


@query(
    "barrier_grid",
    EWITH + _BETS + ", g as (select bets.*, pt, sl from bets cross join (values (1.0, 5.0), (2.0, 2.0), (3.0, 1.0)) p(pt, sl)), "
    + _barrier_sql("pt", "sl", bets="g", keys="id, pt, sl")
    + " select pt::double as pt, sl::double as sl, count(*) as bets, sum(wl::int)::bigint as wins, round(avg(wl::int), 6) as win_rate, round(avg(dl), 6) as mean_minutes from k group by pt, sl",
)
def barrier_grid(spark, sf_dir):
    got = joins.barrier_grid(_bets(spark, sf_dir), event_ticks(spark, sf_dir), 14400, [(1.0, 5.0), (2.0, 2.0), (3.0, 1.0)], 0.5)
    return got.groupBy("pt", "sl").agg(F.count("*").alias("bets"), F.sum("label_long").alias("wins"), F.avg("label_long").alias("win_rate"), F.avg("duration_long").alias("mean_minutes"))


@query(
    "concurrency_uniqueness",
    EWITH + _BETS + """, i as (select id, symbol, t0, t0 + to_seconds(3600 * (1 + id % 5)) as t1 from bets),
    e as (select symbol, t0 as moment, 1 as step from i union all select symbol, t1, -1 from i),
    l as (select *, sum(step) over (partition by symbol order by moment, step desc) as level from e),
    m as (select symbol, moment, max(level)::bigint as concurrency from l where step = 1 group by all)
    select id, i.symbol, concurrency, round(coalesce(1.0 / concurrency, 0), 6) as uniqueness from i left join m on m.symbol = i.symbol and m.moment = i.t0""",
)
def concurrency_uniqueness(spark, sf_dir):
    i = _bets(spark, sf_dir).withColumn("t1", F.timestamp_micros(F.unix_micros("t0") + 3_600_000_000 * (1 + F.col("id") % 5)))
    return joins.concurrency(i.select("id", "symbol", "t0", "t1")).select("id", "symbol", "concurrency", "uniqueness")


@query(
    "cooldown_thin",
    RWITH + TICKS + """, o as materialized (select symbol, ts, seq, row_number() over (partition by symbol order by ts, seq) as i from t),
    r as (select symbol, ts, seq from o where i = 1
          union all select n.symbol, n.ts, n.seq from r, lateral (select * from o where o.symbol = r.symbol and o.ts >= r.ts + interval 6 hour order by ts, seq limit 1) n)
    select symbol, seq from r""",
)
def cooldown_thin(spark, sf_dir):
    return recursive.thin(event_ticks(spark, sf_dir).select("symbol", "ts", "seq"), 6 * 3600, ties=("seq",)).select("symbol", "seq")


# --- features ---------------------------------------------------------------------------------------------------


@query("true_range_atr", RWITH + ATR + f", r as (select *, atr / (avg(atr) {over(24)} + 1e-10) as ratio from b) " + final({"tr": "tr", "atr": "atr", "atr_ratio": "ratio"}, "r"))
def true_range_atr(spark, sf_dir):
    return recursive.atr_ratio(atr_bars(spark, sf_dir), 24).select("symbol", "bucket", "tr", "atr", "atr_ratio")


def _stats_sql() -> str:
    c: dict[str, str] = {}
    for n in (10, 20):
        m, s = f"({full('avg(close)', 'close', n)})", f"({full('stddev_samp(close)', 'close', n)})"
        c |= {
            f"mean_{n}": f"(close - {m}) / atr", f"variance_{n}": f"({full('var_samp(close)', 'close', n)}) / (atr * atr)", f"std_{n}": f"{s} / atr",
            f"cv_{n}": f"{s} / ({m} + 1e-10)", f"median_{n}": f"(close - ({full('median(close)', 'close', n)})) / atr",
            f"min_{n}": f"(({full('min(close)', 'close', n)}) - close) / atr", f"max_{n}": f"(({full('max(close)', 'close', n)}) - close) / atr",
            f"zscore_{n}": f"(close - {m}) / ({s} + 1e-10)", f"upper_{n}": f"({m} + 2 * {s} - close) / atr", f"lower_{n}": f"({m} - 2 * {s} - close) / atr",
        }
    return RWITH + ATR + " " + final(c, "b")


@query("feat_rolling_stats", _stats_sql())
def feat_rolling_stats(spark, sf_dir):
    return features.rolling_stats(atr_bars(spark, sf_dir))


@query(
    "feat_quantiles",
    staged(
        [{"x": full("list(close)", "close", 20)}, {"s": "list_sort(x)"}, {"q05": "s[1] + 0.95 * (s[2] - s[1])", "q95": "s[19] + 0.05 * (s[20] - s[19])", "med": "(s[10] + s[11]) / 2"},
         {"dv": "list_sort([abs(v - med) for v in x])"}],
        {"q25_20": "(close - s[6]) / atr", "q75_20": "(close - s[15]) / atr", "iqr_20": "(s[15] - s[6]) / atr", "trimmed_20": "list_sum(s[3:18]) / 16",
         "winsor_20": "list_sum([greatest(least(v, q95), q05) for v in x]) / 20", "mad_20": "(dv[10] + dv[11]) / 2 / atr"},
    ),
)
def feat_quantiles(spark, sf_dir):
    return features.quantile_stats(atr_bars(spark, sf_dir))


_AVG = lambda e: f"avg({e}) {over(20)}"


@query(
    "feat_moments",
    staged(
        [{"m": full("avg(close)", "close", 20), "v0": full("var_pop(close)", "close", 20), "r": "(close - pc) / nullif(pc, 0)", "c3": full("avg(close ** 3)", "close", 20), "c2": full("avg(close ** 2)", "close", 20)},
         {"z": "(close - m) / sqrt(v0 + 1e-10)", "d4": "(close - m) ** 4", "r1": _AVG("r"), "r2": _AVG("r * r"), "r3": _AVG("r ** 3"), "r4": _AVG("r ** 4"), "rn": f"count(r) {over(20)}"},
         {"z5": "z ** 5", "z6": "z ** 6", "z7": "z ** 7", "z8": "z ** 8", "vr": "r2 - r1 * r1", "t3": "r3 - 3 * r1 * r2 + 2 * r1 ** 3", "t4": "r4 - 4 * r1 * r3 + 6 * r1 * r1 * r2 - 3 * r1 ** 4", "sr": f"stddev_samp(r) {over(20)}"},
         {"m4": "t4 / (vr * 20 / 19) ** 2", "rs": "t3 / (sqrt(vr) + 1e-10) ** 3", "rk": "t4 / (sqrt(vr) + 1e-10) ** 4 - 3"},
         {"dof": "case when vr <= 0 then null when m4 > 3 then greatest(least(4 * (3 + m4) / (m4 - 3), 100.0), 2.1) else 100.0 end"}],
        {"skew_20": "(c3 - 3 * m * c2 + 2 * m ** 3) / sqrt(v0 + 1e-10) ** 3", "kurtosis_20": f"({full('avg(d4)', 'd4', 20)}) / (v0 * v0 + 1e-10) - 3",
         "moment5_20": full("avg(z5)", "z5", 20), "moment6_20": full("avg(z6)", "z6", 20), "moment7_20": full("avg(z7)", "z7", 20), "moment8_20": full("avg(z8)", "z8", 20),
         # Finite-sample variances: 6(n-2)/((n+1)(n+3)) and 24n(n-2)(n-3)/((n+1)^2(n+3)(n+5)) for n = 20.
         "jarque_bera_20": "case when rn = 20 then rs * rs / (6.0 * 18 / (21 * 23)) + rk * rk / (24.0 * 20 * 18 * 17 / (21 * 21 * 23 * 25)) end",
         "tail_dof_20": "case when rn = 20 then dof end", "tail_scale_20": "case when rn = 20 then sqrt(greatest(sr * sr * (dof - 2) / dof, 1e-8)) / (sr + 1e-10) end"},
    ),
)
def feat_moments(spark, sf_dir):
    return features.moments(atr_bars(spark, sf_dir))


def _roc(k: int) -> str:
    return f"(close - {lag('close', k)}) / nullif({lag('close', k)}, 0)"


@query(
    "feat_momentum",
    staged(
        [{"r": "(close - pc) / nullif(pc, 0)", "rv": f"volume / (({full('avg(volume)', 'volume', 20)}) + 1e-10)", **{f"roc{k}": _roc(k) for k in (10, 11, 14, 15, 20, 30)}},
         {"prv": "r * rv", "kst": "(roc10 + 2 * roc15 + 3 * roc20 + 4 * roc30) / 10 * 100", "copp": "roc11 + roc14"}],
        {"change": "r", "volatility_20": full("stddev_samp(r)", "r", 20), "\"range\"": "(high - low) / atr", "volume_price_trend": full("avg(prv)", "prv", 10),
         "rate_of_change_10": "roc10 * 100", "momentum_10": f"(close - {lag('close', 10)}) / atr", "kst": "kst", "kst_signal": full("avg(kst)", "kst", 9), "coppock": full("avg(copp)", "copp", 10)},
    ),
)
def feat_momentum(spark, sf_dir):
    return features.momentum(atr_bars(spark, sf_dir))


@query(
    "feat_bands_channels",
    staged(
        [{"hi": full("max(high)", "high", 20), "lo": full("min(low)", "low", 20), "m": full("avg(close)", "close", 20), "s": full("stddev_samp(close)", "close", 20),
          "iu": place("high", 20), "idn": place("-low", 20)},
         {"k": "case when hi - lo <> 0 then (close - lo) / (hi - lo) * 100 when hi - lo = 0 then 50.0 end",
          "pv": f"({lag('hi')} + {lag('lo')} + {lag('close')}) / 3", "ph": lag("hi"), "pl": lag("lo")}],
        {"bb_upper": "(m + 2 * s - close) / atr", "bb_lower": "(m - 2 * s - close) / atr", "bb_width": "4 * s / atr", "bb_percent": "(close - (m - 2 * s)) / (4 * s + 1e-10)",
         "donchian_upper": "(hi - close) / atr", "donchian_middle": "((hi + lo) / 2 - close) / atr", "donchian_lower": "(lo - close) / atr",
         "aroon_up": "case when hi is not null then 100.0 * (20 - (i - iu)) / 20 end", "aroon_down": "case when hi is not null then 100.0 * (20 - (i - idn)) / 20 end",
         "williams_r": "case when hi - lo <> 0 then -100 * (hi - close) / (hi - lo) when hi - lo = 0 then -50.0 end", "stoch_k": "k", "stoch_d": full("avg(k)", "k", 3),
         "dpo": "(close - m) / atr", "pivot": "(pv - close) / atr", "resistance1": "(2 * pv - pl - close) / atr", "support1": "(2 * pv - ph - close) / atr", "fib_50": "(lo + 0.5 * (hi - lo) - close) / atr"},
    ),
)
def feat_bands_channels(spark, sf_dir):
    return features.channels(atr_bars(spark, sf_dir))


def _wma(c: str, n: int, old: bool = False) -> str:
    return "(" + " + ".join(f"{(k + 1 if old else n - k)} * {lag(c, k)}" for k in range(n)) + f") / {n * (n + 1) / 2}"


@query(
    "feat_trend",
    staged(
        [{"sma": full("avg(close)", "close", 20), "sd": full("stddev_samp(close)", "close", 20), "wma": _wma("close", 20), "raw": f"2 * ({_wma('close', 10, True)}) - ({_wma('close', 20, True)})", "up": "sign(close - pc)"},
         {"turn": f"abs(up - {lag('up')})", "rvi": f"({full('avg(close - open)', 'close', 10)}) / (({full('avg(high - low)', 'close', 10)}) + 1e-10)"}],
        {"sma": "(sma - close) / atr", "sma_deviation": "(close - sma) / (sma + 1e-10) * 100", "wma": "(wma - close) / atr", "hma": f"(({_wma('raw', 4, True)}) - close) / atr",
         "slope": "6 * (wma - sma) / 19 / atr", "strength": "case when sd is not null then least(1 / (sd / atr + 1e-10), 100.0) else 100.0 end", "consistency": f"1 - ({full('avg(turn)', 'turn', 20)}) / 2",
         "rvi": "rvi", "rvi_signal": full("avg(rvi)", "rvi", 4)},
    ),
)
def feat_trend(spark, sf_dir):
    return features.trend(atr_bars(spark, sf_dir))


@query(
    "feat_volume",
    staged(
        [{"tp": "(high + low + close) / 3", "clv": "case when high - low > 0 then ((close - low) - (high - close)) / (high - low) end", "vm": full("avg(volume)", "volume", 20)},
         {"dtp": f"tp - {lag('tp')}", "dc": "close - pc"},
         {"pf": "case when dtp > 0 then tp * volume when dtp is not null then 0.0 end", "nf": "case when dtp < 0 then tp * volume when dtp is not null then 0.0 end", "tv": "tp * volume",
          "cv": "clv * volume", "cs": "case when high - low > 0 then volume end"},
         {"pos": full("sum(pf)", "pf", 13), "neg": full("sum(nf)", "nf", 13), "scv": f"sum(cv) {over(13)}", "scs": f"sum(cs) {over(13)}", "rows13": f"count(*) {over(13)}"}],
        {"cmf": "case when rows13 = 13 then coalesce(scv / nullif(scs, 0), 0) end", "mfi": "case when neg > 0 then 100 - 100 / (1 + pos / neg) when pos > 0 then 100.0 when pos = 0 then 50.0 end",
         "vwap": f"(close - ({full('sum(tv)', 'tv', 13)}) / (({full('sum(volume)', 'volume', 13)}) + 1e-10)) / atr", "obv": "sign(dc) * volume / (vm + 1e-10)",
         "accumulation": "coalesce(clv, 0) * volume / (vm + 1e-10)", "force": "dc * volume / (atr * vm + 1e-10)", "volume_ratio": "volume / (vm + 1e-10)"},
    ),
)
def feat_volume(spark, sf_dir):
    return features.volume(atr_bars(spark, sf_dir))


@query(
    "feat_price_action",
    staged(
        [{"body": "abs(close - open)", "tw": "high - greatest(open, close)", "bw": "least(open, close) - low", "span": "high - low"}],
        {"pattern": "case when span <= 0 then 0 when body < 0.1 * span then 3 when bw > 0.6 * span and tw < 0.1 * span then 1 when tw > 0.6 * span and bw < 0.1 * span then 2 when body > 0.6 * span and close > open then 4 when body > 0.6 * span and close < open then 5 else 0 end",
         "typical": "(close - (high + low + close) / 3) / atr", "weighted": "(close - (high + low + 2 * close) / 4) / atr", "median": "(close - (high + low) / 2) / atr", "body": "body / atr",
         "upper_wick": "tw / (span + 1e-10)", "lower_wick": "bw / (span + 1e-10)", "location": "(close - low) / (span + 1e-10)", "intraday": "(close - open) / (open + 1e-10)", "gap": "(open - pc) / (pc + 1e-10)"},
    ),
)
def feat_price_action(spark, sf_dir):
    return features.price_action(atr_bars(spark, sf_dir))


@query(
    "feat_volatility",
    staged(
        [{"r": "(close - pc) / nullif(pc, 0)"}, {"hv": full("stddev_samp(r)", "r", 20), "r2": "r * r", "x": "abs(r)", "lr": lag("r")},
         {"crossing": "case when r * lr < 0 then 1.0 when lr is not null then 0.0 end", "von": "(r - lr) ** 2", "went": "r2 * log2(r2 + 1e-10)", "rms": f"sqrt({full('avg(r2)', 'r2', 20)})", "mr": full("avg(r)", "r", 20)}],
        {"hv_annual": "hv * sqrt(252)", "energy": f"({full('sum(r2)', 'r2', 20)}) / 1e6", "peak": f"({full('max(x)', 'x', 20)}) / (hv + 1e-10)", "rms": "rms", "crest": f"({full('max(x)', 'x', 20)}) / (rms + 1e-10)",
         "amplitude_cv": f"({full('stddev_samp(x)', 'x', 20)}) / (({full('avg(x)', 'x', 20)}) + 1e-10)",
         "peak_to_peak": f"(({full('max(close)', 'close', 20)}) - ({full('min(close)', 'close', 20)})) / atr", "crossings": f"({full('sum(crossing)', 'crossing', 20)}) / 40",
         "von_neumann": f"case when count(von) {over(20)} = 20 then least(greatest(sum(von) {over(20)} / (sum(r2) {over(20)} - 20 * mr * mr + 1e-12), 0), 4) else 0 end",
         "wavelet_entropy": f"-({full('sum(went)', 'went', 20)}) / 1e6"},
    ),
)
def feat_volatility(spark, sf_dir):
    # Returns of prices near 0 are large: both sums come out in millions.
    return features.volatility(atr_bars(spark, sf_dir)).withColumns({c: F.col(c) / 1e6 for c in ("energy", "wavelet_entropy")})


@query(
    "feat_cycles",
    staged(
        [{"tp": "(high + low + close) / 3", "bp": "case when pc is null then close - low else close - least(low, pc) end", "rng": "case when pc is null then high - low else greatest(high, pc) - least(low, pc) end", "r": "(close - pc) / nullif(pc, 0)"},
         {"tps": full("list(tp)", "tp", 20), "tpm": full("avg(tp)", "tp", 20), "hv": full("stddev_samp(r)", "r", 20), "lo": f"min(close) {over(20)}", "hi": f"max(close) {over(20)}", "been": f"count(*) {over(20)}"},
         {"q60": full("quantile_cont(hv, 0.6)", "hv", 60), "q80": full("quantile_cont(hv, 0.8)", "hv", 60), "dv": "list_sum([abs(v - tpm) for v in tps]) / 20"}],
        {"cci": "(tp - tpm) / (0.015 * dv + 1e-10)",
         "ultimate": "100 * (" + " + ".join(f"{w} * (({full('sum(bp)', 'bp', k)}) / (({full('sum(rng)', 'rng', k)}) + 1e-10))" for w, k in ((4, 7), (2, 14), (1, 28))) + ") / 7",
         "stabilised": "case when been <= 2 or hi - lo <= 1e-10 then close when close < lo + (hi - lo) * 0.01 then lo + (hi - lo) * 0.01 when close > hi - (hi - lo) * 0.01 then hi - (hi - lo) * 0.01 else close end", "regime": "coalesce((hv > q80)::int + (hv > q60)::int, 0)",
         "quality": f"case when count(*) {over(20)} = 20 then 0.8 * count(r) {over(20)} / 20 + 0.2 else 0.0 end"},
    ),
)
def feat_cycles(spark, sf_dir):
    return features.oscillators(atr_bars(spark, sf_dir))


_SPAN = {n: 2 / (n + 1) for n in (3, 9, 10, 12, 14, 20, 25, 26)}
_MOVES = stage("x0", "b", {
    "d": "close - pc", "up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "reach": "greatest(high - low, abs(high - pc), abs(low - pc))", "hl": "high - low", "xi": "i",
}) + stage("x1", "x0", {
    "gain": "case when pc is not null then greatest(d, 0) end", "loss": "case when pc is not null then greatest(-d, 0) end", "d0": "coalesce(d, 0)", "ad": "coalesce(abs(d), 0)",
    "p0": "case when up > dn and up > 0 then up else 0.0 end", "m0": "case when dn > up and dn > 0 then dn else 0.0 end",
}) + stage("x2", "x1", {
    "p1": "case when pc is not null then p0 end", "m1": "case when pc is not null then m0 end", "sf": seed("reach", 13), "sp": seed("p0", 13), "sm": seed("m0", 13), "s9": seed("hl", 9), "s10": seed("hl", 10),
})
_OSCILLATORS = (
    RWITH + ATR + _MOVES
    + ewms("y0", "x2", {"g": ("gain", 1 / 14), "s": ("loss", 1 / 14), "fast": ("close", _SPAN[12]), "slow": ("close", _SPAN[26]), "p": ("p1", 1 / 14), "m": ("m1", 1 / 14), "t1": ("close", _SPAN[14]),
                        "e20": ("close", _SPAN[20]), "d1": ("d0", _SPAN[25]), "a1": ("ad", _SPAN[25]), "wf": ("sf", 1 / 13), "wp": ("sp", 1 / 13), "wm": ("sm", 1 / 13)})
    + stage("y1", "y0", {"macd": "fast - slow", "dx": "abs(p - m) / (p + m + 1e-10) * 100"})
    + ewms("y2", "y1", {"signal": ("macd", _SPAN[9]), "adx": ("dx", 1 / 14), "t2": ("t1", _SPAN[14]), "d2": ("d1", _SPAN[12]), "a2": ("a1", _SPAN[12])})
    + ewms("y3", "y2", {"t3": ("t2", _SPAN[14])}) + " "
    + final({"rsi_14": "100 - 100 / (1 + g / (s + 1e-10))", "macd": "macd / atr", "macd_signal": "signal / atr", "macd_histogram": "(macd - signal) / atr",
             "di_plus": "case when i > 13 and wf * 13 > 1e-10 then wp / wf * 100 end", "di_minus": "case when i > 13 and wf * 13 > 1e-10 then wm / wf * 100 end", "adx_14": "adx",
             "trix": f"(t3 - {lag('t3')}) / ({lag('t3')} + 1e-10) * 1e4", "tsi": "case when i > 37 then coalesce(100 * d2 / nullif(a2, 0), 0) end", "ema_20": "(e20 - close) / atr"}, "y3")
)


def _cycle(source: str, c: str, name: str) -> str:
    low, high = full(f"min({c})", c, 10), full(f"max({c})", c, 10)
    return stage(f"{name}_0", source, {f"{name}_x": f"({c} - ({low})) / (({high}) - ({low}) + 1e-10) * 100"}) + ewms(f"{name}_1", f"{name}_0", {name: (f"{name}_x", _SPAN[3])})


_A23, _A50 = (recursive.alpha(half_life=h) for h in (23, 50))
_ADAPTIVE = (
    RWITH + ATR + _MOVES
    + ewms("y0", "x2", {"g": ("gain", 1 / 14), "s": ("loss", 1 / 14), "fast": ("close", _SPAN[12]), "slow": ("close", _SPAN[26]), "h23": ("close", _A23), "h50": ("close", _A50), "e9": ("s9", _SPAN[9]), "e10": ("s10", _SPAN[10])})
    + stage("y1", "y0", {"rsi": "100 - 100 / (1 + g / (s + 1e-10))", "macd": "h23 - h50", "s99": f"case when i = 17 then avg(e9) {over(9)} when i > 17 then e9 end",
                         "walk": "sum(abs(coalesce(close - pc, 0))) over (partition by symbol order by i)"})
    + stage("y2", "y1", {"er": f"case when walk - {lag('walk', 21)} > 0 then abs(close - {lag('close', 21)}) / (walk - {lag('walk', 21)}) else 0 end"})
    + ewms("y3", "y2", {"e99": ("s99", _SPAN[9])})
    + """, k_r as (select symbol, i, null::double as kama from y3 where i = 1 union all
         select s.symbol, s.i, case when s.i <= 21 then null else coalesce(r.kama, s.pc) + (s.er * (2 / 3.0 - 2 / 31.0) + 2 / 31.0) ** 2 * (s.close - coalesce(r.kama, s.pc)) end
         from k_r r join y3 s on s.symbol = r.symbol and s.i = r.i + 1), y4 as materialized (select y3.*, kama from y3 join k_r using (symbol, i))"""
    + stage("y5", "y4", {"mi": "case when e99 > 0 then e9 / e99 end"})
    + _cycle("y5", "macd", "c1") + _cycle("c1_1", "c1", "c2") + " "
    + final({"stoch_rsi": f"(rsi - ({full('min(rsi)', 'rsi', 14)})) / (({full('max(rsi)', 'rsi', 14)}) - ({full('min(rsi)', 'rsi', 14)}) + 1e-10) * 100",
             "rsi_divergence": f"(close - {lag('close', 14)}) / ({lag('close', 14)} + 1e-10) - ((rsi - {lag('rsi', 14)}) / 50 - 1)", "schaff": "c2",
             "price_oscillator": "(fast - slow) / (slow + 1e-10) * 100", "kama": "(kama - close) / atr",
             "chaikin_volatility": f"case when {lag('e10', 10)} > 0 then (e10 - {lag('e10', 10)}) / {lag('e10', 10)} * 100 end", "mass_index": full("sum(mi)", "mi", 20)}, "c2_1")
)


@query("feat_adaptive", _ADAPTIVE)
def feat_adaptive(spark, sf_dir):
    return recursive.adaptive(atr_bars(spark, sf_dir))


@query("feat_oscillators", _OSCILLATORS)
def feat_oscillators(spark, sf_dir):
    return recursive.oscillators(atr_bars(spark, sf_dir))


def _settings_sql() -> str:
    r, spans = recursive, sorted({*recursive.EMA_SPANS, *(s for pair in recursive.OSCILLATOR_SPANS for s in pair), *(s for f, g, _ in recursive.MACD_SPANS for s in (f, g))})
    first = {f"a{p}": ("tr", 1 / p) for p in r.ATR_PERIODS}
    for p in r.RSI_PERIODS:
        first |= {f"g{p}": ("gain", 1 / p), f"l{p}": ("loss", 1 / p)}
    first |= {f"e{s}": ("close", 2 / (s + 1)) for s in spans} | {f"h{s}": ("close", r.alpha(half_life=s)) for f, g, _ in r.CYCLES for s in (f, g)}
    between = lambda c, n: f"({c} - ({full(f'min({c})', c, n)})) / (({full(f'max({c})', c, n)}) - ({full(f'min({c})', c, n)}) + 1e-10) * 100"
    out = {}
    for p in r.ATR_PERIODS:
        sd = full(f"stddev_samp(a{p})", f"a{p}", p)
        out |= {f"atr_{p}": f"a{p} / atr", f"atr_pct_{p}": f"a{p} / (close + 1e-10) * 100", f"atr_trend_{p}": f"(a{p} - {lag(f'a{p}')}) / atr", f"atr_volatility_{p}": f"({sd}) / atr"}
    for p in r.RSI_PERIODS:
        out |= {f"rsi_{p}": f"rsi_{p}", f"rsi_momentum_{p}": f"rsi_{p} - {lag(f'rsi_{p}')}"}
    for p in r.RSI_PERIODS[:2]:
        out |= {f"stoch_rsi_{p}": between(f"rsi_{p}", p), f"rsi_divergence_{p}": f"(close - {lag('close', p)}) / nullif({lag('close', p)}, 0) - ((rsi_{p} - {lag(f'rsi_{p}', p)}) / 50 - 1)"}
    for f, g, n in r.MACD_SPANS:
        out |= {f"macd_{f}_{g}": f"m{f} / atr", f"macd_signal_{f}_{g}_{n}": f"s{f} / atr", f"macd_histogram_{f}_{g}_{n}": f"(m{f} - s{f}) / atr"}
    out |= {f"schaff_{f}_{g}_{n}": f"t{f}" for f, g, n in r.CYCLES} | {f"price_oscillator_{f}_{g}": f"(e{f} - e{g}) / nullif(e{g}, 0) * 100" for f, g in r.OSCILLATOR_SPANS}
    for p in r.EMA_SPANS:
        out |= {f"ema_{p}": f"(e{p} - close) / atr", f"ema_deviation_{p}": f"(close - e{p}) / (e{p} + 1e-10) * 100"}
    return (
        RWITH + ATR + _MOVES + ewms("y0", "x2", first)
        + stage("y1", "y0", {f"rsi_{p}": f"100 - 100 / (1 + g{p} / (l{p} + 1e-10))" for p in r.RSI_PERIODS} | {f"m{f}": f"e{f} - e{g}" for f, g, _ in r.MACD_SPANS} | {f"c{f}": f"h{f} - h{g}" for f, g, _ in r.CYCLES})
        + stage("y2", "y1", {f"x{f}": between(f"c{f}", n) for f, _, n in r.CYCLES})
        + ewms("y3", "y2", {f"s{f}": (f"m{f}", 2 / (n + 1)) for f, _, n in r.MACD_SPANS} | {f"y{f}": (f"x{f}", 0.5) for f, _, _ in r.CYCLES})
        + stage("y4", "y3", {f"z{f}": between(f"y{f}", n) for f, _, n in r.CYCLES})
        + ewms("y5", "y4", {f"t{f}": (f"z{f}", 0.5) for f, _, _ in r.CYCLES}) + " " + final(out, "y5")
    )


@query("feat_recursive_settings", _settings_sql())
def feat_recursive_settings(spark, sf_dir):
    return recursive.settings(atr_bars(spark, sf_dir))


def _band_settings_sql() -> str:
    raw, out = {}, {}
    for p in features.BAND_SIZES:
        raw |= {f"m{p}": full("avg(close)", "close", p), f"sd{p}": full("stddev_samp(close)", "close", p)}
        for k in features.BAND_WIDTHS:
            name, low, wide = f"{p}_{str(k).replace('.', 'h')}", f"(close - m{p} + {k} * sd{p})", f"(2 * {k} * sd{p})"
            out |= {f"bb_upper_{name}": f"(m{p} + {k} * sd{p} - close) / atr", f"bb_lower_{name}": f"{low} / atr", f"bb_percent_{name}": f"{low} / ({wide} + 1e-10)",
                    f"bb_width_{name}": f"{wide} / atr", f"bb_width_pct_{name}": f"{wide} / (m{p} + 1e-10) * 100", f"bb_position_{name}": f"(close - m{p}) / (sd{p} + 1e-10)"}
    for p in features.AROON_SIZES:
        raw |= {f"{n}{p}": f"case when count(*) {over(p)} = {p} then 100.0 * ({p} - (i - ({place(c, p)}))) / {p} end" for n, c in (("u", "high"), ("w", "-low"))}
        out |= {f"aroon_up_{p}": f"u{p}", f"aroon_down_{p}": f"w{p}", f"aroon_oscillator_{p}": f"u{p} - w{p}"}
    for p, d, s in features.STOCHASTIC:
        raw |= {f"lo{p}": full("min(low)", "low", p), f"hi{p}": full("max(high)", "high", p)}
        out |= {f"stoch_k_{p}": f"k{p}", f"stoch_d_{p}_{d}": f"d{p}", f"stoch_slow_d_{p}_{d}_{s}": full(f"avg(d{p})", f"d{p}", s)}
    three = features.STOCHASTIC
    return staged(
        [raw, {f"q{p}": f"case when hi{p} - lo{p} > 0 then 100 * (close - lo{p}) / (hi{p} - lo{p}) when hi{p} is not null then 50.0 end" for p, _, _ in three},
         {f"k{p}": full(f"avg(q{p})", f"q{p}", d) for p, d, _ in three}, {f"d{p}": full(f"avg(k{p})", f"k{p}", d) for p, d, _ in three}],
        out,
    )


@query("feat_band_settings", _band_settings_sql())
def feat_band_settings(spark, sf_dir):
    return features.settings(atr_bars(spark, sf_dir))


@query(
    "feat_relative_means",
    staged(
        [{"r": "(close - pc) / nullif(pc, 0)", "bv": f"({full('avg(volume)', 'volume', 120)}) + 1e-10"}, {"rel": "volume / bv", "x": "abs(r)", "r2": "r * r"}],
        {f"volume_mean_{p}": f"({full('avg(volume)', 'volume', p)}) / bv" for p in features.FAST_SIZES} | {"volume_ma_20": full("avg(rel)", "rel", 20)}
        | {f"wavelet_mean_{p}": full("avg(r)", "r", p) for p in features.WAVELET_SIZES} | {f"wavelet_std_{p}": full("stddev_samp(r)", "r", p) for p in features.WAVELET_SIZES}
        | {"amplitude_mean": full("avg(x)", "x", 100), "amplitude_std": full("stddev_samp(x)", "x", 100), "amplitude_cv": f"({full('stddev_samp(x)', 'x', 100)}) / (({full('avg(x)', 'x', 100)}) + 1e-10)",
           "energy_ratio": f"({full('sum(r2)', 'r2', 100)}) / ((atr / (close + 1e-10)) ** 2 * 100 + 1e-10)"},
    ),
)
def feat_relative_means(spark, sf_dir):
    return features.relative_means(atr_bars(spark, sf_dir), 120)


@query(
    "neutralize",
    staged(
        [{"x": "volume::double"}, {k: f"avg({v}) {over(48)}" for k, v in {"mx": "x", "my": "close", "mxx": "x * x", "mxy": "x * close"}.items()} | {"rows48": f"count(*) {over(48)}"},
         {"beta": "(mxy - mx * my) / (greatest(mxx - mx * mx, 0) + 1e-10)"}],
        {"close_neutralized": "case when rows48 >= 30 then close - (my - beta * mx) - beta * x end"}, head=EWITH + BARS, source="b1",
    ),
)
def neutralize(spark, sf_dir):
    rows = hour_bars(spark, sf_dir).withColumn("x", F.col("volume").cast("double"))
    return selection.neutralise(rows, "close", "x", 48).select("symbol", "bucket", "close_neutralized")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with gap flags, average true range and rolling statistics."""
    rows = atr_bars(spark, sf_dir)
    stats = features.rolling_stats(rows)
    return plain(rows.join(stats, ["symbol", "bucket"]).select("symbol", "bucket", "open", "high", "low", "close", "volume", "disc", "atr", "mean_20", "std_20", "zscore_20"))


from tidemark.plans import research  # noqa: E402, F401  (registers further queries)
