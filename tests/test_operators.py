"""Hand-made cases of the operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import Rolling
from tidemark.operators import analytics, bars, joins, kernels, recursive, selection, simulate
from tidemark.sources import ticks as source

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_read_tsv(spark, tmp_path):
    lines = ["<DATE>\t<TIME>\t<BID>\t<ASK>\t<LAST>\t<VOLUME>\t<FLAGS>", "2021.07.12\t00:00:00.123\t1.5\t1.6\t\t\t6", "2021.07.13\t00:00:01.000\t\t1.7\t\t\t4", "2021.07.14\tbad\t1\t2\t\t\t2", "2021.07.15\t00:00"]
    (tmp_path / "t.tsv").write_text("\n".join(lines))
    got = source.valid(source.read_tsv(spark, str(tmp_path / "t.tsv"))).collect()
    assert [(r.ts, round(r.bid, 4), r.volume, r.flags) for r in got] == [(dt.datetime(2021, 7, 12, 0, 0, 0, 123000), 1.5, None, 6)]
    assert source.read_tsv(spark, str(tmp_path / "t.tsv"), "2021.07.13", "2021.07.14").count() == 2


def test_partitioned_sink_prunes(spark, tmp_path):
    t = spark.createDataFrame([(at(0), 1.0, 1.2), (at(60 * 24 * 40), 1.0, 1.3)], "ts timestamp, bid double, ask double")
    source.write_partitioned(source.derived(t), str(tmp_path / "lake"))
    got = source.read_period(spark, str(tmp_path / "lake"), (2024, 2), (2024, 2))
    assert got.count() == 1
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()
    source.compact(spark, str(tmp_path / "lake"), str(tmp_path / "months"))
    assert spark.read.parquet(str(tmp_path / "months")).count() == 2


def test_gap_flag(spark):
    rows = [("a", "H1", at(m)) for m in (0, 60, 150, 270)]
    got = bars.gap_flags(spark.createDataFrame(rows, "symbol string, timeframe string, bucket timestamp")).orderBy("bucket").collect()
    assert [r.disc for r in got] == [False, False, False, True]


def test_full_window(spark):
    rows = [("a", i, float(i)) for i in range(1, 6)]
    got = spark.createDataFrame(rows, "symbol string, bucket int, x double").select("bucket", Rolling().mean("x", 3).alias("m")).orderBy("bucket").collect()
    assert [r.m for r in got] == [None, None, 2.0, 3.0, 4.0]


def test_weeks_start_on_monday(spark):
    got = spark.createDataFrame([(dt.datetime(2024, 1, 7, 5),)], "ts timestamp").select(bars.bucket(F.col("ts"), "W1").alias("w")).first().w
    assert got == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("ticks", "label", "minutes"),
    [([(1, 101.5)], 1, 1.0), ([(1, 95.5), (2, 101.5)], 0, 1.0), ([], 0, 30.0), ([(0, 101.5)], 0, 30.0), ([(30, 101.5)], 1, 30.0)],
)
def test_first_hit(spark, ticks, label, minutes):
    bets = spark.createDataFrame([(1, "a", T0, 100.0, 1.0)], "id int, symbol string, t0 timestamp, close double, atr double")
    t = spark.createDataFrame([("a", at(m), p) for m, p in ticks], "symbol string, ts timestamp, price double")
    got = joins.triple_barrier(bets, t, 1800, 1.0, 5.0, 0.5).first()
    assert (got.label_long, got.duration_long) == (label, minutes)


@pytest.mark.parametrize("rows", [7, 65536])
def test_first_hits_of_odd_ticks(spark, monkeypatch, rows):
    """Against all pairs: equal times and bets, nulls, NaN, infinite prices and levels, groups over batches' ends."""
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    price = lambda: odd[rng.integers(6)] if rng.random() < 0.2 else round(float(rng.normal(0, 4)), 1)
    moment = lambda: None if rng.random() < 0.03 else T0 + dt.timedelta(seconds=int(rng.integers(-60, 60)) * 37)
    symbol = lambda: [None, "a", "a", "b"][rng.integers(4)]
    ticks = [(symbol(), moment(), price()) for _ in range(300)]
    bets = [(i, symbol(), moment(), price()) for i in range(150)]
    monkeypatch.setattr(joins, "ROWS", rows)
    b = spark.createDataFrame(bets + bets[:9], "id int, symbol string, t0 timestamp, close double").repartition(3)
    t = spark.createDataFrame(ticks, "symbol string, ts timestamp, price double").repartition(3)
    got = joins.first_hits(b, t, 600, {"up": (True, F.col("close") + 1), "down": (False, F.col("close") - 1)}).collect()
    assert len(got) == len(bets)
    key = lambda x: (x != x, 0.0 if x != x else x)  # NaN above all
    for r in got:
        seen = [(ts, p) for s, ts, p in ticks if s is not None and s == r.symbol and None not in (ts, p, r.t0, r.close) and r.t0 < ts <= r.t0 + dt.timedelta(seconds=600)]
        assert r.up == min((ts for ts, p in seen if key(p) >= key(r.close + 1)), default=None), r
        assert r.down == min((ts for ts, p in seen if key(p) <= key(r.close - 1)), default=None), r


def test_first_hits_of_dense_ticks(spark):
    """20,000 bets and ticks in one horizon: no join of them all."""
    n = 20_000
    price = (50 + 40 * np.sin(np.arange(n) / 3000) + np.arange(n) % 7).round(2)
    t = spark.createDataFrame(pd.DataFrame({"symbol": "a", "k": np.arange(n), "price": price})).withColumn("ts", F.timestamp_seconds(F.col("k") + 1_700_006_400))
    bets = t.select(F.col("k").alias("id"), "symbol", F.col("ts").alias("t0"), F.col("price").alias("close"), F.lit(1.0).alias("atr"))
    got = joins.triple_barrier(bets, t, 100_000, 9.0, 2.0, 0.5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    first = lambda ok: int(ok.argmax()) + 1 if ok.any() else None
    some = got.filter("id % 500 = 3").collect()
    assert len(some) == n // 500
    for r in some:
        after, c = price[r.id + 1 :], price[r.id]
        win, lose = first(after >= c + 9 + 0.5), first(after <= c - 2 + 0.5)
        won = win is not None and (lose is None or win < lose)
        end = win if won else lose
        assert r.label_long == won and r.duration_long == pytest.approx((100_000 if end is None else end) / 60)


def test_barrier_grid_is_one_pass(spark):
    t = spark.range(400).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 37 % 11).cast("double").alias("price"))
    bets = t.select("symbol", F.col("ts").alias("t0"), F.col("price").alias("close"), F.lit(1.0).alias("atr"))
    grid = [(1.0, 5.0), (2.0, 2.0), (3.0, 1.0)]
    got = joins.barrier_grid(bets, t, 1800, grid, 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    one = lambda df: sorted(tuple(r) for r in df.select("t0", "label_long", "duration_long", "label_short", "duration_short").collect())
    for pt, sl in grid:
        assert one(got.filter(f"pt = {pt} and sl = {sl}")) == one(joins.triple_barrier(bets, t, 1800, pt, sl, 0.5))


def test_concurrency(spark):
    rows = [(i, "a", at(a), at(b)) for i, (a, b) in enumerate([(0, 10), (5, 12), (12, 20)])]
    got = joins.concurrency(spark.createDataFrame(rows, "id int, symbol string, t0 timestamp, t1 timestamp")).orderBy("id").collect()
    assert [r.concurrency for r in got] == [1, 2, 2]


def test_asof_ties_and_empty(spark):
    left = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("b", at(5), 3)], "symbol string, ts timestamp, id int")
    right = spark.createDataFrame([("a", at(1), 10.0), ("a", at(4), 40.0)], "symbol string, ts timestamp, v double")
    back = {r.id: r.v for r in joins.asof(left, right, "symbol", "ts", {"v": "v"}).collect()}
    ahead = {r.id: r.v for r in joins.asof(left, right, "symbol", "ts", {"v": "v"}, forward=True).collect()}
    assert back == {1: 10.0, 2: 40.0, 3: None}
    assert ahead == {1: 10.0, 2: None, 3: None}


def test_ewm_and_blocks(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(np.random.default_rng(1).normal(size=500))]
    df = spark.createDataFrame(rows, "symbol string, bucket int, x double")
    one = [r.y for r in recursive.ewm(df, {"y": ("x", 0.3)}).orderBy("bucket").collect()]
    two = [r.y for r in recursive.ewm_blocks(df, "x", 0.3, "y", block=64).orderBy("bucket").collect()]
    assert np.allclose(one, two, atol=1e-9)
    got = recursive.ewm(spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3)], "symbol string, bucket int, x double"), {"y": ("x", 0.5)})
    assert [r.y for r in got.orderBy("bucket").collect()] == [1.0, 1.5, 2.25]


def test_thin(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), s) for s in (0, 30, 60, 100, 120)], "symbol string, ts timestamp, s int")
    assert sorted(r.s for r in recursive.thin(df, 60).collect()) == [0, 60, 120]


def test_quality_clip(spark):
    x = [0.0, 0.1, -0.1, 0.05, float("inf"), float("nan"), 100.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "symbol string, bucket int, x double")
    got = [r.clipped for r in recursive.quality_clip(df, "x", 5).orderBy("bucket").collect()]
    # The value itself moves the running mean and deviation before it is held against them.
    assert got[:4] == x[:4] and np.isfinite(got).all() and got[4] > 0.1 and got[5] == 0.0 and got[6] <= 100


def test_drawdown(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1 + i), p) for i, p in enumerate([0.0, 20.0, -30.0, 40.0])], "day date, pnl double")
    assert analytics.drawdown(days, 100.0).agg(F.min("drawdown")).first()[0] == -0.25


@pytest.mark.parametrize(("a", "b", "want"), [((1.0, 2.5), (1.0, 2.5), (2, 2, 0)), ((1.0, 2.5), (1.0, 2.50001), (2, 1, 1))])
def test_parity(spark, a, b, want):
    frame = lambda v: spark.createDataFrame([("s", "M3", T0, f"f{i}", x) for i, x in enumerate(v)], "symbol string, timeframe string, bucket timestamp, name string, value double")
    got = selection.parity(frame(a), frame(b)).agg(F.sum("total"), F.sum("passed"), F.sum("failed")).first()
    assert tuple(got) == want


def test_greedy_drop():
    assert selection.greedy_drop([("a", "b", 0.99), ("b", "c", 0.99), ("a", "c", 0.1)], ["a", "b", "c"]) == ["a", "c"]


def test_kernels_on_known_series():
    line = np.arange(40, dtype=float)[None, :]
    assert np.allclose(kernels.theil_sen(line), 1) and np.allclose(kernels.lowess(line), 39)
    wave = np.sin(2 * np.pi * np.arange(64) * 8 / 64)[None, :]
    assert abs(kernels.centroid(wave)[0] - 0.5 * 8 / 31) < 1e-6 and kernels.flatness(wave)[0] < 0.1
    walk = np.cumsum(np.random.default_rng(0).normal(size=(1, 200)), 1)
    noise = np.random.default_rng(0).normal(size=(1, 200))
    assert kernels.adf(noise)[0] < -5 < kernels.adf(walk)[0]
    for _, f in [*kernels.TIME_SERIES.values(), *kernels.SIGNAL.values(), *kernels.EXPERIMENTAL.values()]:
        assert np.isfinite(f(np.random.default_rng(2).normal(10, 1, size=(5, 64)))).all()


def test_rolling_is_null_until_full():
    got = kernels.rolling(np.arange(10.0), lambda w: w.mean(1), 4)
    assert np.isnan(got[:3]).all() and np.allclose(got[3:], pd.Series(np.arange(10.0)).rolling(4).mean()[3:])


def test_portfolio_and_events(spark):
    rows = [("a", at(60 * i), p, 1.0, s) for i, (p, s) in enumerate([(100.0, 0.9), (101.5, 0.0), (100.0, 0.9), (97.0, 0.0)])]
    got = simulate.portfolio(spark.createDataFrame(rows, "symbol string, bucket timestamp, close double, atr double, score double"), 0.5).orderBy("entry").collect()
    assert [r.reason for r in got] == ["target", "stop"] and got[0].pnl > 0 > got[1].pnl
    ev = spark.createDataFrame([(1, 1, "FILL", 7, 0.0), (1, 2, "EQUITY", 0, 100.0), (1, 3, "SL", 7, 0.0), (1, 4, "EQUITY", 0, 90.0)], "account bigint, seq bigint, kind string, ticket bigint, amount double")
    r = simulate.fold_events(ev).first()
    assert (r.open_tickets, r.consecutive_stops, r.equity, round(r.drawdown, 6)) == (0, 1, 90.0, 0.1)


def test_stream_matches_batch(spark):
    from conftest import SF

    from tidemark.streaming import bars as stream

    live = stream.run_once(spark, SF)
    batch = bars.ohlcv(source.event_ticks(spark, SF), ("H1",)).select("symbol", "bucket", "open", "high", "low", "close", "volume")
    assert live.count() > 0 and live.exceptAll(batch).count() == 0
    assert batch.count() - live.count() <= 10  # bars that the watermark has not closed


def test_kama_follows_a_line_and_oscillators_run(spark):
    x = np.arange(60.0)
    got = recursive.kama(x, 10)
    assert np.isnan(got[:10]).all() and got[-1] > x[-1] - 3
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(size=200))
    rows = [("a", at(60 * i), float(c + 1), float(c - 1), float(c), 1.0) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, bucket timestamp, high double, low double, close double, atr double")
    last = recursive.adaptive(df).orderBy("bucket").collect()[-1]
    assert 0 <= last.stoch_rsi <= 100 and 0 <= last.schaff <= 100 and abs(last.mass_index - 20) < 0.1


def test_learners(spark):
    from tidemark.operators import learn

    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0), i % 3) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, fold int")
    scored = learn.out_of_fold(df, ["a", "b"], "y", "fold", 3)
    assert scored.count() == 600
    assert analytics.roc_auc(scored.withColumnRenamed("prediction", "score"), "score", "y").first().auc > 0.9
    fixed = learn.calibrated(scored, "prediction", "y").select("prediction", "calibrated").orderBy("prediction").collect()
    assert all(a.calibrated <= b.calibrated + 1e-9 for a, b in zip(fixed, fixed[1:]))
    assert [n for n, _ in learn.importances(df, ["a", "b"], "y")][0] == "a"
    # A label with noise: scores of a separable one are all 0 or 1, and ties at the edge are skipped.
    noisy = df.withColumn("y", (F.col("a") + F.lit(2.0) * (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0 - 0.5) > 0).cast("int"))
    assert 0.1 < learn.bad_trade_filter(noisy, ["a", "b"], "y").agg(F.avg(F.col("skip").cast("int"))).first()[0] < 0.3
