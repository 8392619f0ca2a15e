"""Queries of selection, validation, trades and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import Rolling
from tidemark.operators import analytics, frames, kernels, learn, recursive, selection, simulate
from tidemark.plans.catalogue import ATR, BARS, EWITH, RWITH, TICKS, atr_bars, final, full, hour_bars, lag, over, query, stage
from tidemark.sources.ticks import event_ticks
from tidemark.streaming import bars as stream

COLUMNS = ["open", "high", "low", "close", "volume", "pc"]


def _frame(spark, sf_dir):
    return hour_bars(spark, sf_dir).withColumn("pc", Rolling(("symbol", "timeframe")).lag("close"))


_LONG = EWITH + BARS + ", w as (select symbol, bucket, open, high, low, close, volume::double as volume, pc from b1), u as (select * from w unpivot include nulls (value for name in (open, high, low, close, volume, pc)))"


@query("feature_long_melt", _LONG + " select symbol, epoch(bucket)::bigint as bucket, name, round(value, 6) as value from u")
def feature_long_melt(spark, sf_dir):
    return selection.melt(_frame(spark, sf_dir), ("symbol", "bucket"), COLUMNS)


@query(
    "variance_null_filter",
    _LONG + """, s as (select name, var_samp(value) as variance, count(*) filter (value is null) / (count(*) + 1e-10) as null_rate from u group by 1)
    select name, round(variance, 6) as variance, round(null_rate, 6) as null_rate, coalesce(variance > 1e-6, true) and null_rate < 0.3 as keep from s""",
)
def variance_null_filter(spark, sf_dir):
    return selection.variance_and_nulls(_frame(spark, sf_dir), COLUMNS)


@query(
    "correlation_pairs",
    EWITH + BARS + " " + " union all ".join(f"select '{a}' as first, '{b}' as second, round(corr({a}, {b}), 6) as corr from b1" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]),
)
def correlation_pairs(spark, sf_dir):
    return selection.correlation_pairs(_frame(spark, sf_dir), COLUMNS)


@query(
    "ks_statistic",
    _LONG + """, x as (select name, value as v, bucket < timestamp '2024-01-16' as h from u where value is not null),
    n as (select name, count(*) filter (h) as n1, count(*) filter (not h) as n2 from x group by 1),
    c as (select name, v, sum(h::int) over w as c1, sum((not h)::int) over w as c2 from x window w as (partition by name order by v))
    select name, n1, n2, round(max(abs(c1 / n1 - c2 / n2)), 6) as d from c join n using (name) group by all""",
)
def ks_statistic(spark, sf_dir):
    rows = selection.melt(_frame(spark, sf_dir), ("bucket",), COLUMNS)
    return selection.ks_statistic(rows, "value", F.col("bucket") < F.lit("2024-01-16").cast("timestamp")).select("name", "n1", "n2", "d")


@query(
    "oob_counter",
    EWITH + BARS + """, q as (select quantile_cont(close, [0.01, 0.99]) as c, quantile_cont(volume, [0.01, 0.99]) as v, quantile_cont(high, [0.01, 0.99]) as h from b1 where bucket < timestamp '2024-01-16')
    select symbol, epoch(bucket)::bigint as bucket, ((close < c[1] or close > c[2])::int + (volume < v[1] or volume > v[2])::int + (high < h[1] or high > h[2])::int) as n_outside from b1, q""",
)
def oob_counter(spark, sf_dir):
    got = selection.out_of_bounds(hour_bars(spark, sf_dir), F.col("bucket") < F.lit("2024-01-16").cast("timestamp"), ["close", "volume", "high"])
    return got.select("symbol", "bucket", "n_outside")


_PARITY = """, l as (select symbol, 'H1' as timeframe, bucket, name, value from u where not (name = 'open' and extract(hour from bucket) = 5)),
    r as (select symbol, 'H1' as timeframe, bucket, name, case when name = 'close' and extract(hour from bucket) = 3 then value * 1.00001 else value end as value from u where not (name = 'low' and extract(hour from bucket) = 7))"""


@query(
    "parity_compare",
    _LONG + _PARITY + """, j as (select coalesce(l.timeframe, r.timeframe) as timeframe, coalesce(l.name, r.name) as name, l.name as ln, r.name as rn, l.value as a, r.value as b
      from l full join r on l.symbol = r.symbol and l.bucket = r.bucket and l.name = r.name),
    k as (select *, ln is not null and rn is not null as p, (a is null and b is null) or coalesce(abs(a - b) <= 1e-12 + 1e-7 * abs(b), false) as ok from j)
    select timeframe, name, count(*) filter (p) as total, count(*) filter (p and ok) as passed, count(*) filter (p and not ok) as failed,
    count(*) filter (rn is null) as only_captured, count(*) filter (ln is null) as only_reference from k group by all""",
)
def parity_compare(spark, sf_dir):
    u = selection.melt(_frame(spark, sf_dir), ("symbol", "timeframe", "bucket"), COLUMNS)
    at = F.hour("bucket")
    left = u.filter(~((F.col("name") == "open") & (at == 5)))
    right = u.filter(~((F.col("name") == "low") & (at == 7))).withColumn("value", F.when((F.col("name") == "close") & (at == 3), F.col("value") * 1.00001).otherwise(F.col("value")))
    return selection.parity(left, right)


@query(
    "feature_names",
    EWITH + BARS + """, n as (select distinct 'e1' || substr(symbol, 1, 1) || '_' || c || '_' || tf as name from b1, (values ('mean_20'), ('adx')) x(c), (values ('M3'), ('M30'), ('H12'), ('D1')) y(tf))
    select name, regexp_extract(name, '(M30|M3|H12|D1)$', 1) as timeframe, case when regexp_matches(name, '^e1[bcd]_') then 1 when regexp_matches(name, '^e1[aef]_') then 2 end as model,
           regexp_extract(name, '^(e1[a-f])_', 1) as engine, regexp_replace(regexp_replace(name, '^e1[a-f]_', ''), '_[^_]*$', '') as base,
           name like '%adx%' or name like 'e1p%' as excluded from n""",
)
def feature_names(spark, sf_dir):
    each = lambda *x: F.explode(F.array(*map(F.lit, x)))
    rows = hour_bars(spark, sf_dir).select("symbol").distinct().withColumn("c", each("mean_20", "adx")).withColumn("tf", each("M3", "M30", "H12", "D1"))
    rows = rows.select(F.concat(F.lit("e1"), F.substring("symbol", 1, 1), F.lit("_"), "c", F.lit("_"), "tf").alias("name")).distinct()
    name = F.col("name")
    parts = frames.name_parts(name)
    return rows.select(
        "name", selection.timeframe_of(F.regexp_replace("name", "_", " ")).alias("timeframe"), selection.model_of(name).alias("model"),
        parts["engine"].alias("engine"), parts["base"].alias("base"), frames.excluded(name, parts=("adx",), prefixes=("e1p",)).alias("excluded"),
    )


# --- trades -----------------------------------------------------------------------------------------------------

_TRADES = """tr as (select l_orderkey * 10 + l_linenumber as id, l_shipdate::date as day, l_returnflag as side, l_extendedprice * (l_discount - 0.05) as pnl,
    (l_quantity * 0.8)::double as held, l_quantity as size, l_tax as tax, l_suppkey as suppkey from lineitem)"""


def trades(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("side"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), (F.col("l_quantity") * 0.8).cast("double").alias("held"),
        F.col("l_quantity").alias("size"), F.col("l_tax").alias("tax"), F.col("l_suppkey").alias("suppkey"),
    )


@query(
    "daily_summary",
    EWITH + _TRADES + """ select day::varchar as day, count(*) as trades, round(sum(pnl), 6) + 0 as pnl, count(*) filter (pnl > 0) as wins, count(*) filter (pnl <= 0 and held >= 29.5) as timeouts,
    count(*) filter (pnl <= 0 and held < 29.5) as stops, round(count(*) filter (pnl > 0) / count(*), 6) as win_rate from tr group by 1""",
)
def daily_summary(spark, sf_dir):
    return analytics.daily_summary(trades(spark, sf_dir), F.col("day"))


@query("weekday_rollup", EWITH + _TRADES + " select isodow(day)::int as weekday, count(*) as trades, round(avg(pnl), 6) as mean_pnl, round(median(pnl), 6) as median_pnl, round(count(*) filter (pnl > 0) / count(*), 6) as win_rate from tr group by 1")
def weekday_rollup(spark, sf_dir):
    return analytics.rollup(trades(spark, sf_dir), F.weekday("day") + 1, "weekday")


@query("hourly_rollup", "select hour(ts)::int as hour, count(*) as trades, round(avg(value - 50), 6) as mean_pnl, round(median(value - 50), 6) as median_pnl, round(count(*) filter (value > 50) / count(*), 6) as win_rate from events group by 1")
def hourly_rollup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", (F.col("value") - 50).alias("pnl"))
    return analytics.rollup(e, F.hour("ts"), "hour")


@query("trade_stats", EWITH + _TRADES + " select side, count(*) as trades, round(count(*) filter (pnl > 0) / count(*), 6) as win_rate, round(avg(pnl) filter (pnl > 0), 6) as mean_win, round(avg(-pnl) filter (pnl < 0), 6) as mean_loss, round(sum(pnl) filter (pnl > 0) / sum(-pnl) filter (pnl < 0), 6) as profit_factor from tr group by 1")
def trade_stats(spark, sf_dir):
    return analytics.trade_stats(trades(spark, sf_dir), "side")


_DAYS = EWITH + _TRADES + ", d as (select day, sum(pnl) as pnl from tr group by 1)"


def _days(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("day").agg(F.sum("pnl").alias("pnl"))


@query("loss_streaks", _DAYS + """, m as (select *, row_number() over (order by day) - sum((pnl < 0)::int) over (order by day rows unbounded preceding) as run from d)
    select min(day)::varchar as first_day, max(day)::varchar as last_day, count(*) as days, round(sum(pnl), 6) as pnl from m where pnl < 0 group by run""")
def loss_streaks(spark, sf_dir):
    return analytics.streaks(_days(spark, sf_dir))


_EQUITY = _DAYS + ", e as (select *, 1000000 + sum(pnl) over (order by day rows unbounded preceding) as equity from d), f as (select *, max(equity) over (order by day rows unbounded preceding) as peak from e), g as (select *, (equity - peak) / peak as drawdown from f)"


@query("drawdown", _EQUITY + " select day::varchar as day, round(pnl, 6) + 0 as pnl, round(equity, 6) as equity, round(peak, 6) as peak, round(drawdown, 6) + 0 as drawdown from g")
def drawdown(spark, sf_dir):
    return analytics.drawdown(_days(spark, sf_dir), 1e6)


@query("sharpe_sortino", _EQUITY + ", r as (select *, equity / lag(equity) over (order by day) - 1 as r from g) select round(avg(r) / stddev_samp(r) * sqrt(252), 6) as sharpe, round(avg(r) / stddev_samp(r) filter (r < 0) * sqrt(252), 6) as sortino, round(min(drawdown), 6) as worst_drawdown from r")
def sharpe_sortino(spark, sf_dir):
    return analytics.sharpe_sortino(analytics.drawdown(_days(spark, sf_dir), 1e6))


_SCORED = "s as (select doc_id, ((doc_id * 37) % 101) / 101.0 as score, toxic as label from labels)"


def _scored(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows.select("doc_id", ((F.col("doc_id") * 37) % 101 / 101.0).alias("score"), F.col("toxic").alias("label"))


@query(
    "roc_auc",
    EWITH + _SCORED + """, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from s)
    select round((sum(rk) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 6) as auc,
    round(-avg(case when label = 1 then ln(greatest(least(score, 1 - 1e-7), 1e-7)) else ln(1 - greatest(least(score, 1 - 1e-7), 1e-7)) end), 6) as log_loss,
    count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives from r""",
)
def roc_auc(spark, sf_dir):
    return analytics.roc_auc(_scored(spark, sf_dir))


@query("class_weights", "select quality, count(*) filter (toxic = 1) as positives, count(*) filter (toxic = 0) as negatives, round(case when count(*) filter (toxic = 1) > 0 and count(*) filter (toxic = 0) > 0 then count(*) filter (toxic = 0) / count(*) filter (toxic = 1) else 1.0 end, 6) as pos_weight from labels group by 1")
def class_weights(spark, sf_dir):
    return analytics.class_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", "quality")


@query("reliability_curve", EWITH + _SCORED + ", q as (select quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) as e from s) select ((score > e[1])::int + (score > e[2])::int + (score > e[3])::int + (score > e[4])::int) as bin, count(*) as n, round(avg(score), 6) as mean_score, round(avg(label), 6) as rate from s, q group by 1")
def reliability_curve(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return analytics.reliability(s, analytics.quantile_edges(s, 5))


@query("confidence_bands", EWITH + _SCORED + " select case when score < 0.3 then 'full' when score < 0.7 then 'half' else 'skip' end as band, count(*) as n, round(avg(label), 6) as wrong_rate from s group by 1")
def confidence_bands(spark, sf_dir):
    return analytics.confidence_bands(_scored(spark, sf_dir), 0.3, 0.7)


@query("meta_label_join", EWITH + _SCORED + """, m as (select doc_id, score, greatest(least(ln(greatest(least(score, 1 - 1e-7), 1e-7) / (1 - greatest(least(score, 1 - 1e-7), 1e-7))), 10), -10) as logit from s)
    select m.doc_id, round(logit, 6) as logit, d.lang from m join documents d using (doc_id) where logit >= 0""")
def meta_label_join(spark, sf_dir):
    keys = _scored(spark, sf_dir).withColumn("logit", selection.logit(F.col("score"))).filter("logit >= 0")
    return keys.select("doc_id", "logit").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")


@query(
    "purged_kfold",
    EWITH + """d as (select distinct l_shipdate::date as day from lineitem), n as (select count(*) as n from d),
    f as (select day, least((row_number() over (order by day) - 1) // (select greatest(1, n // 5) from n), 4) as fold from d),
    s as (select fold, min(day) as lo, max(day) as hi from f group by 1)
    select * from (select fold::bigint as fold, day::varchar as day, case when day between lo and hi then 'test' when day < lo - interval 3 day or day > hi + interval 2 day then 'train' end as role from d, s) where role is not null""",
)
def purged_kfold(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return analytics.purged_folds(days, 5).withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "walk_forward",
    EWITH + """d as (select distinct l_shipdate::date as day from lineitem), m as (select min(day) as lo, max(day) as hi from d),
    k as (select unnest(range(greatest(0, (hi - lo + 1 - 365 - 5 - 90) // 90 + 1)))::int as fold, lo from m),
    o as (select fold, day, (day - lo) - fold * 90 as off from d, k)
    select fold, day::varchar as day, case when off >= 0 and off < 365 then 'train' else 'test' end as role from o where (off >= 0 and off < 365) or (off >= 370 and off < 460)""",
)
def walk_forward(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return analytics.walk_forward(days, 365, 90, 5)


@query("time_of_day_ratio", EWITH + BARS + """ select symbol, epoch(bucket)::bigint as bucket, round(case when count(high) over w = 5 then high / nullif(avg(high) over w, 0) end, 6) as tod_ratio from b1
    window w as (partition by symbol, hour(bucket), minute(bucket) order by bucket rows between 5 preceding and 1 preceding)""")
def time_of_day_ratio(spark, sf_dir):
    return analytics.time_of_day_ratio(hour_bars(spark, sf_dir), "high", 5).select("symbol", "bucket", "tod_ratio")


@query("filter_variants", EWITH + _TRADES + """ select name, count(*) as trades, round(count(*) filter (pnl > 0) / count(*), 6) as win_rate, round(avg(pnl) filter (pnl > 0), 6) as mean_win, round(avg(-pnl) filter (pnl < 0), 6) as mean_loss,
    round(sum(pnl) filter (pnl > 0) / sum(-pnl) filter (pnl < 0), 6) as profit_factor from tr join (values ('all', 0.0), ('mid', 0.02), ('high', 0.06)) v(name, least) on tax >= least group by 1""")
def filter_variants(spark, sf_dir):
    variants = spark.createDataFrame([("all", 0.0), ("mid", 0.02), ("high", 0.06)], "name string, least double")
    return analytics.filter_variants(trades(spark, sf_dir).withColumn("ratio", F.col("tax")), variants)


@query("position_sizing", EWITH + _TRADES + " select id, round(greatest(floor(10000 * 0.01 / (size + 1e-10) / 0.01 + 1e-9) * 0.01, 0.01), 6) as lots from tr")
def position_sizing(spark, sf_dir):
    return trades(spark, sf_dir).select("id", analytics.position_size(F.lit(10000.0), F.col("size")).alias("lots"))


@query("broker_reconcile", "select coalesce(l.o_orderkey, r.o_orderkey) as ticket, case when l.o_orderkey is null then 'import' when r.o_orderkey is null then 'remove' else 'keep' end as action from (select o_orderkey from orders where o_orderkey % 3 <> 0) l full join (select o_orderkey from orders where o_orderkey % 5 <> 0) r using (o_orderkey)")
def broker_reconcile(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ticket"))
    return analytics.reconcile(o.filter("ticket % 3 <> 0"), o.filter("ticket % 5 <> 0"))


# --- small frame operations --------------------------------------------------------------------------------------


def _ticks(spark, sf_dir):
    return event_ticks(spark, sf_dir)


@query("last_close_proxy", EWITH + TICKS + """, l as (select symbol, make_timestamp(epoch_us(ts) // 300000000 * 300000000) as bucket, arg_max(price, (ts, seq)) as close from t group by all)
    select symbol, epoch(bucket)::bigint as bucket, round(close, 6) as close, round((close - lag(close) over w) / nullif(lag(close) over w, 0), 6) as change from l window w as (partition by symbol order by bucket)""")
def last_close_proxy(spark, sf_dir):
    return frames.last_close(_ticks(spark, sf_dir))


@query("resample_right", EWITH + TICKS + """ select symbol, (ceil(epoch_us(ts) / 30000000.0) * 30)::bigint as bucket, round(arg_min(price, (ts, seq)), 6) as open, round(max(price), 6) as high,
    round(min(price), 6) as low, round(arg_max(price, (ts, seq)), 6) as close, count(*) as volume from t group by all""")
def resample_right(spark, sf_dir):
    return frames.resample_right(_ticks(spark, sf_dir))


@query("tail_rows", EWITH + TICKS + " select symbol, seq, round(price, 6) as price from t qualify row_number() over (partition by symbol order by ts desc, seq desc) <= 100")
def tail_rows(spark, sf_dir):
    return frames.tail(_ticks(spark, sf_dir), 100, ("symbol",), ("ts", "seq")).select("symbol", "seq", "price")


@query("first_seen", """with e as (select user_id, event_type, case when event_id % 3 > 0 then value end as value, case when event_id % 4 = 0 then props end as props, ts, event_id from events)
    select user_id, arg_min(value, (ts, event_id)) filter (value is not null) as value, arg_min(props, (ts, event_id)) filter (props is not null) as props from e group by 1""")
def first_seen(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumns({"value": F.when(F.col("event_id") % 3 > 0, F.col("value")), "props": F.when(F.col("event_id") % 4 == 0, F.col("props"))})
    return frames.first_seen(e, ("user_id",), ("ts", "event_id"), ("value", "props"))


@query("unique_rows", """select 'first' as keep, user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1
    union all select 'last', user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def unique_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    kept = [frames.unique(e, ("user_id",), ("ts", "event_id"), k).withColumn("keep", F.lit(k)) for k in ("first", "last")]
    return kept[0].unionByName(kept[1]).select("keep", "user_id", "event_id", "event_type")


@query("fold_means", "select l_orderkey % 5 as fold, count(*) as n, round(avg(l_quantity), 6) as mean_l_quantity, round(avg(l_discount), 6) as mean_l_discount from lineitem group by 1")
def fold_means(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("fold", F.col("l_orderkey") % 5)
    return frames.fold_means(rows, "fold", ("l_quantity", "l_discount"))


@query("forward_targets", EWITH + BARS + " select symbol, epoch(bucket)::bigint as bucket, " + ", ".join(f"round(lead(close, {n}) over w / nullif(close, 0) - 1, 6) as {k}" for k, n in (("next_1", 1), ("next_24", 24))) + " from b1 window w as (partition by symbol order by bucket)")
def forward_targets(spark, sf_dir):
    return frames.targets(hour_bars(spark, sf_dir), {"next_1": 1, "next_24": 24}).select("symbol", "bucket", "next_1", "next_24")


@query("top_trades", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc nulls last, l_orderkey, l_linenumber limit 50")
def top_trades(spark, sf_dir):
    return frames.top_k(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", 50, ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("seeded_sample", "select o_orderkey from orders order by md5(o_orderkey || ':42'), o_orderkey limit 100")
def seeded_sample(spark, sf_dir):
    return frames.sample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 100).select("o_orderkey")


@query("diagonal_concat", """select c_custkey as key, c_name as name, c_mktsegment as segment, null as acctbal from customer
    union all by name select s_suppkey as key, s_name as name, round(s_acctbal, 6) as acctbal from supplier""")
def diagonal_concat(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("acctbal"))
    return frames.stacked([c, s])


@query("name_sets", "with l as (select distinct p_brand as name from part where p_size < 10), r as (select distinct p_brand as name from part where p_retailprice > 1000) select coalesce(l.name, r.name) as name, case when l.name is null then 'right' when r.name is null then 'left' else 'both' end as side from l full join r using (name)")
def name_sets(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", F.col("p_brand"))
    return frames.name_sets(p.filter("p_size < 10"), p.filter("p_retailprice > 1000"))


@query("semi_join", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_join(spark, sf_dir):
    big = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("purged_rows", EWITH + BARS + """, n as (select symbol, bucket, i - 1 as position, count(*) over (partition by symbol) as n from b1),
    f as (select *, fold, fold * greatest(1, n // 4) as lo, case when fold = 3 then n else (fold + 1) * greatest(1, n // 4) end - 1 as hi from n, range(4) r(fold))
    select symbol, epoch(bucket)::bigint as bucket, position::int as position, fold::int as fold, case when position between lo and hi then 'test' else 'train' end as role
    from f where position between lo and hi or position < lo - 5 or position > hi + 3""")
def purged_rows(spark, sf_dir):
    return frames.purged_rows(hour_bars(spark, sf_dir).select("symbol", "bucket"), 4, 5, 3, "symbol", ("bucket",))


@query("expanding_folds", """select l_orderkey, l_linenumber, round::int as round, case when l_orderkey % 4 + 1 <= round then 'train' else 'test' end as role
    from lineitem, range(1, 4) r(round) where l_orderkey % 4 + 1 <= round + 1""")
def expanding_folds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4 + 1).alias("fold"))
    return frames.expanding(rows, "fold", 4).select("l_orderkey", "l_linenumber", "round", "role")


@query("baseline_ratio", RWITH + ATR + f", m as (select *, {full('avg(atr)', 'atr', 24)} as short, {full('avg(atr)', 'atr', 168)} as long from b) select symbol, epoch(bucket)::bigint as bucket, round(long, 6) as baseline, round(short / long, 6) as ratio, long >= 50 as above_floor from m")
def baseline_ratio(spark, sf_dir):
    return frames.baseline_ratio(atr_bars(spark, sf_dir), "atr", 24, 168, 50.0).select("symbol", "bucket", "baseline", "ratio", "above_floor")


@query("trigger_flags", RWITH + ATR + f", m as (select *, atr / (avg(atr) {over(24)} + 1e-10) as r from b) select symbol, epoch(bucket)::bigint as bucket, (case when r >= 0.8 then 1 else 0 end)::tinyint as is_trigger from m where year(bucket) = 2024 and month(bucket) = 1")
def trigger_flags(spark, sf_dir):
    rows = recursive.atr_ratio(atr_bars(spark, sf_dir), 24).filter(frames.in_period(F.col("bucket"), "month", 2024, 1))
    return rows.select("symbol", "bucket", frames.is_trigger(F.col("atr_ratio")).alias("is_trigger"))


@query("suffixed_names", EWITH + BARS + " select symbol, epoch(bucket)::bigint as bucket, round(open, 6) as open_H1, round(close, 6) as close_H1 from b1")
def suffixed_names(spark, sf_dir):
    rows = hour_bars(spark, sf_dir).select(F.col("symbol").alias("Ticker"), F.col("bucket").alias("TIME"), F.col("open").alias("Open"), "close")
    rows = frames.normalised(rows, {"symbol": ("ticker", "instrument"), "bucket": ("time", "timestamp"), "open": ("o",)})
    return frames.suffixed(rows, "H1", ("symbol", "bucket"))


@query("bar_first_hit", RWITH + ATR + """, j as (
        select x.symbol, x.bucket, x.i, min(y.i - x.i) filter (y.high >= x.close + x.atr) as pt, min(y.i - x.i) filter (y.low <= x.close - 2 * x.atr) as sl
        from b x left join b y on y.symbol = x.symbol and y.i between x.i + 1 and x.i + 12 group by all)
    select symbol, epoch(bucket)::bigint as bucket, (pt is not null and (sl is null or pt <= sl))::int as label,
           case when pt is not null and (sl is null or pt <= sl) then 'target' when sl is not null then 'stop' else 'time' end as reason,
           coalesce(case when pt is not null and (sl is null or pt <= sl) then pt else sl end, 12)::int as bars_held from j""")
def bar_first_hit(spark, sf_dir):
    rows = atr_bars(spark, sf_dir)
    bets = rows.select("symbol", "bucket", "close", "atr")
    got = frames.bar_first_hit(bets, rows, 12, F.col("close") + F.col("atr"), F.col("close") - 2 * F.col("atr"))
    return got.select("symbol", "bucket", "label", "reason", "bars_held")


@query("correlation_greedy", """with c as materialized (select * from (values (1, 'open'), (2, 'high'), (3, 'low'), (4, 'close'), (5, 'volume')) t(k, name)),
    """ + BARS + ", p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, abs(corr({a}, {b})) >= 0.5 as near from b1" for i, a in enumerate(COLUMNS[:5]) for b in COLUMNS[i + 1 : 5]) + """)
    select name from c where name = 'open'
        or name = 'high' and not (select near from p where a = 'open' and b = 'high')
        or name = 'low' and not (select near from p where a = 'open' and b = 'low') and not ((select near from p where a = 'high' and b = 'low') and not (select near from p where a = 'open' and b = 'high'))
        or name = 'close' and not (select near from p where a = 'open' and b = 'close') and not ((select near from p where a = 'high' and b = 'close') and not (select near from p where a = 'open' and b = 'high'))
           and not ((select near from p where a = 'low' and b = 'close') and not (select near from p where a = 'open' and b = 'low') and not ((select near from p where a = 'high' and b = 'low') and not (select near from p where a = 'open' and b = 'high')))
        or name = 'volume' and not exists (select 1 from p where b = 'volume' and near)""")
def correlation_greedy(spark, sf_dir):
    kept = selection.blocked_correlation(_frame(spark, sf_dir), COLUMNS[:5], 0.5, block=2)
    return spark.createDataFrame([(k,) for k in kept], "name string")


# --- kernels, simulation, streams: checked by tests against plain versions ----------------------------------------


_HALF = recursive.alpha(half_life=50)


@query(
    "qa_clip",
    RWITH + BARS + f""", q as (
        select symbol, i, bucket, close as v, close as mean, 0.0::double as var, 1.0::double as sq, close as clipped from b2 where i = 1
        union all
        select symbol, i, bucket, v, mean, var, sq,
               case when 1 - sq > 1e-12 and var > 0 then least(greatest(v, mean - 5 * sqrt(var / (1 - sq))), mean + 5 * sqrt(var / (1 - sq))) else v end
        from (select b2.symbol, b2.i, b2.bucket, b2.close as v, q.mean + {_HALF!r} * (b2.close - q.mean) as mean,
                     (1 - {_HALF!r}) * (q.var + {_HALF!r} * (b2.close - q.mean) ** 2) as var, (1 - {_HALF!r}) ** 2 * q.sq + {_HALF!r} ** 2 as sq
              from q join b2 on b2.symbol = q.symbol and b2.i = q.i + 1))
    select symbol, epoch(bucket)::bigint as bucket, round(clipped, 6) as clipped from q""",
)
def qa_clip(spark, sf_dir):
    return recursive.quality_clip(hour_bars(spark, sf_dir), "close", 50).select("symbol", "bucket", "clipped")


@query("feat_kernels_ts")
def feat_kernels_ts(spark, sf_dir):
    return kernels.apply(atr_bars(spark, sf_dir), kernels.TIME_SERIES, 50)


@query("feat_kernels_signal")
def feat_kernels_signal(spark, sf_dir):
    return kernels.apply(atr_bars(spark, sf_dir), kernels.SIGNAL, 64)


@query("feat_kernels_experimental")
def feat_kernels_experimental(spark, sf_dir):
    return kernels.apply(atr_bars(spark, sf_dir), kernels.EXPERIMENTAL, 30)


@query(
    "portfolio_sim",
    RWITH + ATR + """,
    p as materialized (select symbol, i - 1 as k, bucket, close, atr, ((epoch(bucket)::bigint // 3600) * 7919 + length(symbol) * 613) % 1000 / 1000.0 as score,
                              max(i - 1) over (partition by symbol) as final_k from b),
    r as (
        select symbol, 0::bigint as k, -1::bigint as until_k, 0 as stops, 10000.0::double as money, 10000.0::double as peak, null::timestamp as entry, null::timestamp as exit,
               null::double as entry_price, null::double as exit_price, null::double as lots, null::double as pnl, null::varchar as reason
        from p where k = 0
        union all
        select symbol, greatest(end_k, entry_k + 1), case when stops = 3 then end_k + 12 else until_k end, case when stops = 3 then 0 else stops end, money, greatest(peak, money),
               entry, exit, entry_price, exit_price, lots, pnl, reason
        from (select *, money0 + pnl as money, case when reason = 'stop' then stops0 + 1 else 0 end as stops
              from (select *, (exit_price - entry_price) * lots as pnl
                    from (select r.symbol, r.until_k, r.stops as stops0, r.money as money0, r.peak, e.k as entry_k, e.bucket as entry, e.close as entry_price, x.k as end_k, x.bucket as exit, x.close as exit_price,
                                 case when x.close >= e.close + e.atr then 'target' when x.close <= e.close - 2 * e.atr then 'stop' else 'time' end as reason,
                                 greatest(0.01, floor(r.money * 0.01 / (2 * e.atr + 1e-10) * 100 + 1e-9) / 100) as lots
                          from r, lateral (select * from p where p.symbol = r.symbol and p.k >= greatest(r.k, r.until_k) and p.score >= 0.7 order by p.k limit 1) e,
                               lateral (select * from p where p.symbol = e.symbol and p.k between e.k and least(e.k + 6, e.final_k) and (p.k > e.k or e.k = e.final_k)
                                        and (p.close >= e.close + e.atr or p.close <= e.close - 2 * e.atr or p.k = least(e.k + 6, e.final_k)) order by p.k limit 1) x))))
    select symbol, epoch(entry)::bigint as entry, epoch(exit)::bigint as exit, round(entry_price, 6) as entry_price, round(exit_price, 6) as exit_price, round(lots, 6) as lots,
           round(pnl, 6) as pnl, reason, round(money, 6) as balance, round((peak - money) / peak, 6) as drawdown from r where entry is not null""",
)
def portfolio_sim(spark, sf_dir):
    # A score that any engine works out alike, from the hour and the symbol.
    score = F.pmod(F.floor(F.unix_micros(F.col("bucket").cast("timestamp")) / 3_600_000_000) * 7919 + F.length("symbol") * 613, F.lit(1000)) / 1000.0
    rows = atr_bars(spark, sf_dir).select("symbol", "bucket", "close", "atr", score.alias("score"))
    return simulate.portfolio(rows, threshold=0.7)


@query("oof_scores")
def oof_scores(spark, sf_dir):
    rows = trades(spark, sf_dir).select("id", F.col("size").cast("double").alias("size"), F.col("tax").cast("double").alias("tax"), "held", (F.col("pnl") < 0).cast("int").alias("bad"))
    rows = rows.withColumn("fold", F.pmod(F.col("id"), F.lit(3)).cast("int"))
    return learn.out_of_fold(rows, ["size", "tax", "held"], "bad", "fold", 3, depth=2, rounds=3).select("id", "fold", "bad", "prediction")


@query("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    return learn.calibrated(_scored(spark, sf_dir).withColumn("score", F.col("score").cast("double")), "score", "label").select("doc_id", "score", "calibrated")


@query("bad_trade_filter")
def bad_trade_filter(spark, sf_dir):
    rows = trades(spark, sf_dir).select("id", F.col("size").cast("double").alias("size"), F.weekday("day").cast("double").alias("weekday"), (F.col("pnl") < 0).cast("int").alias("bad"))
    return learn.bad_trade_filter(rows, ["size", "weekday"], "bad").select("id", "bad_score", "skip")


@query(
    "event_state_fold",
    """with e as (select user_id % 50 as account, event_id as seq, ['FILL', 'CLOSE', 'SL', 'TP', 'EQUITY'][event_id % 5 + 1] as kind, event_id % 40 as ticket, value as amount from events),
    c as (select account, max(seq) filter (kind in ('CLOSE', 'TP')) as last_other from e group by account),
    k as (select account, ticket, arg_max(kind, seq) as last_kind from e where kind <> 'EQUITY' group by account, ticket),
    o as (select account, count(*) filter (last_kind = 'FILL') as open_tickets from k group by account)
    select e.account, count(*) as events, any_value(coalesce(o.open_tickets, 0))::int as open_tickets,
           (count(*) filter (kind = 'SL' and seq > coalesce(c.last_other, -1)))::int as consecutive_stops,
           round(coalesce(arg_max(amount, seq) filter (kind = 'EQUITY'), 0), 6) as equity, round(greatest(coalesce(max(amount) filter (kind = 'EQUITY'), 0), 0), 6) as peak,
           round(case when greatest(coalesce(max(amount) filter (kind = 'EQUITY'), 0), 0) > 0 then
                 (greatest(coalesce(max(amount) filter (kind = 'EQUITY'), 0), 0) - coalesce(arg_max(amount, seq) filter (kind = 'EQUITY'), 0)) / greatest(coalesce(max(amount) filter (kind = 'EQUITY'), 0), 0)
                 else 0 end, 6) as drawdown
    from e left join c using (account) left join o using (account) group by e.account""",
)
def event_state_fold(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.array(*[F.lit(k) for k in ("FILL", "CLOSE", "SL", "TP", "EQUITY")])
    rows = e.select((F.col("user_id") % 50).alias("account"), F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), (F.col("event_id") % 40).alias("ticket"), F.col("value").alias("amount"))
    return simulate.fold_events(rows)


@query(
    "streaming_ohlcv",
    # Bars whose end the watermark, ten minutes behind the last tick, has passed; open ones are kept for the next run.
    "with " + BARS + """ select symbol, epoch(bucket)::bigint as bucket, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume
    from b0 where bucket + interval 1 hour <= (select max(ts) from events) - interval 10 minute""",
)
def streaming_ohlcv(spark, sf_dir):
    return stream.run_once(spark, sf_dir)
