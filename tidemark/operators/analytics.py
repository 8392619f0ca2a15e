"""Trades, scores and risk: summaries, drawdown, ratios, ranking metrics, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_summary(trades: DataFrame, day: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Count, profit, wins, timeouts and stops by day. trades: pnl, held (minutes)."""
    won, late = F.col("pnl") > 0, F.col("held") >= 29.5
    return trades.groupBy(day.alias("day"), *extra).agg(
        F.count("*").alias("trades"),
        F.sum("pnl").alias("pnl"),
        F.count_if(won).alias("wins"),
        F.count_if(~won & late).alias("timeouts"),
        F.count_if(~won & ~late).alias("stops"),
        (F.count_if(won) / F.count("*")).alias("win_rate"),
    )


def rollup(trades: DataFrame, by: Column, name: str) -> DataFrame:
    """Mean, median and rates of profit by a part of time."""
    return trades.groupBy(by.alias(name)).agg(
        F.count("*").alias("trades"), F.avg("pnl").alias("mean_pnl"), F.median("pnl").alias("median_pnl"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
    )


def trade_stats(trades: DataFrame, by: str) -> DataFrame:
    """Win rate, mean win and loss, profit factor (null without a loss)."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    return trades.groupBy(by).agg(
        F.count("*").alias("trades"), (F.count(win) / F.count("*")).alias("win_rate"), F.avg(win).alias("mean_win"),
        F.avg(loss).alias("mean_loss"), F.try_divide(F.sum(win), F.sum(loss)).alias("profit_factor"),
    )


def streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive days with a loss: start, end, length, total. days: day, pnl, one row each."""
    w = Window.orderBy("day")  # one row for each day
    marked = days.withColumn("_run", F.row_number().over(w) - F.sum(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("pnl < 0").groupBy("_run").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.sum("pnl").alias("pnl")
    ).drop("_run")


def drawdown(days: DataFrame, start: float) -> DataFrame:
    """Equity, its running peak and the drawdown by day."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row for each day
    out = days.withColumn("equity", F.lit(start) + F.sum("pnl").over(w))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def sharpe_sortino(equity: DataFrame) -> DataFrame:
    """Yearly Sharpe and Sortino ratios of daily returns (252 days, sample deviation), and the worst drawdown."""
    w = Window.orderBy("day")
    r = equity.withColumn("r", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)
    down = F.when(F.col("r") < 0, F.col("r"))
    return r.agg(
        (F.try_divide(F.avg("r"), F.stddev_samp("r")) * 252**0.5).alias("sharpe"),
        (F.try_divide(F.avg("r"), F.stddev_samp(down)) * 252**0.5).alias("sortino"),
        F.min("drawdown").alias("worst_drawdown"),
    )


#: Pieces of a unit of score that are numbered by themselves.
PIECES = 4096


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank, and the log loss.

    Scores are counted first, then numbered within pieces of the score's range;
    what lies below a piece comes from the few pieces' totals.
    """
    g = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    g = g.withColumn("_piece", F.floor(F.coalesce(F.col(score).cast("double"), F.lit(0.0)) * PIECES).cast("bigint"))
    lower = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = g.groupBy("_piece").agg(F.sum("n").alias("n")).select("_piece", lower(Window.orderBy("_piece")).alias("_under"))
    g = g.join(pieces, "_piece")
    below = F.col("_under") + lower(Window.partitionBy("_piece").orderBy(score))
    g = g.withColumn("u", F.col("p") * (below + F.col("n") / 2.0))
    q = F.greatest(F.least(F.col(score), F.lit(1 - 1e-7)), F.lit(1e-7))
    return g.agg(
        F.try_divide(F.sum("u"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"),
        (-F.try_divide(F.sum(F.col("p") * F.ln(q) + F.col("n") * F.ln(1 - q)), F.sum(F.col("p") + F.col("n")).cast("double"))).alias("log_loss"),
        F.sum("p").alias("positives"),
        F.sum("n").alias("negatives"),
    )


def class_weights(rows: DataFrame, label: str, by: str) -> DataFrame:
    """Counts and the weight of positives, negatives / positives (1 where there is none)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.groupBy(by).agg(pos.alias("positives"), neg.alias("negatives"), F.when((pos > 0) & (neg > 0), F.try_divide(neg, pos)).otherwise(1.0).alias("pos_weight"))


def reliability(scored: DataFrame, edges: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Mean score and rate of positives by bins of the score at given edges."""
    b = sum((F.col(score) > e).cast("int") for e in edges)
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def quantile_edges(scored: DataFrame, bins: int, score: str = "score") -> list[float]:
    """Inner edges of bins of equal size."""
    got = scored.agg(F.percentile(score, F.array(*[F.lit(k / bins) for k in range(1, bins)]))).first()[0]
    return [float(x) for x in got or []]


def purged_folds(days: DataFrame, k: int, purge: int = 3, embargo: int = 2) -> DataFrame:
    """fold, day, role for k folds of consecutive days: test, or train outside [first - purge, last + embargo].

    days: day, one row each; a fold table of k rows is what days are compared with.
    """
    total = days.count()
    size = max(1, total // k)
    numbered = days.withColumn("fold", F.least(F.floor((F.row_number().over(Window.orderBy("day")) - 1) / size), F.lit(k - 1)))
    span = numbered.groupBy("fold").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    each = days.join(F.broadcast(span), F.lit(True))  # k rows
    role = F.when(F.col("day").between(F.col("first"), F.col("last")), "test").when(
        (F.col("day") < F.date_sub("first", purge)) | (F.col("day") > F.date_add("last", embargo)), "train"
    )
    return each.withColumn("role", role).filter("role is not null").select("fold", "day", "role")


def walk_forward(days: DataFrame, train: int, test: int, gap: int) -> DataFrame:
    """Windows of `train` days, a gap, then `test` days, moved by `test` days; only whole windows.

    The starts are a short sequence; each day joins the windows that hold it.
    """
    lo, hi = days.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return days.select(F.lit(0).alias("fold"), "day", F.lit("").alias("role")).limit(0)
    whole = (hi - lo).days + 1
    n = max(0, (whole - train - gap - test) // test + 1)
    at = F.datediff("day", F.lit(lo))
    folds = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("fold")
    rows = days.select("day", at.alias("at"), folds).filter(F.lit(n > 0))
    off = F.col("at") - F.col("fold") * test
    role = F.when((off >= 0) & (off < train), "train").when((off >= train + gap) & (off < train + gap + test), "test")
    return rows.withColumn("role", role).filter("role is not null").select("fold", "day", "role")


def time_of_day_ratio(bars: DataFrame, value: str, days: int = 10, by: str = "symbol") -> DataFrame:
    """A value over its mean at the same time of day on the previous `days` days it was seen."""
    w = Window.partitionBy(by, F.hour("bucket"), F.minute("bucket")).orderBy("bucket").rowsBetween(-days, -1)
    return bars.withColumn("tod_ratio", F.when(F.count(value).over(w) == days, F.try_divide(F.col(value), F.avg(value).over(w))))


def confidence_bands(scored: DataFrame, lower: float, upper: float) -> DataFrame:
    """Counts and rates of wrong by band: full below lower, half below upper, skip above."""
    band = F.when(F.col("score") < lower, "full").when(F.col("score") < upper, "half").otherwise("skip")
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("wrong_rate"))


def filter_variants(trades: DataFrame, variants: DataFrame) -> DataFrame:
    """Trade statistics under each variant (name, least). variants is a short table of parameters."""
    both = trades.join(F.broadcast(variants), F.col("ratio") >= F.col("least"))
    return trade_stats(both, "name")


def position_size(balance: Column, atr: Column, risk: float = 0.01, step: float = 0.01, least: float = 0.01) -> Column:
    """Lots by risk, rounded down to the lot step."""
    return F.greatest(F.floor(balance * risk / (atr + 1e-10) / step + 1e-9) * step, F.lit(least))


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Tickets to import (only remote), to remove (only local), or in both."""
    both = local.select("ticket", F.lit(1).alias("l")).join(remote.select("ticket", F.lit(1).alias("r")), "ticket", "full_outer")
    return both.select("ticket", F.when(F.col("l").isNull(), "import").when(F.col("r").isNull(), "remove").otherwise("keep").alias("action"))
