"""Feature selection: variance, missing values, correlation, drift, neutralisation, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of a name's values that are numbered by themselves.
PIECES = 64


def melt(wide: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Long form: keys, name, value."""
    return wide.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "name", "value")


def variance_and_nulls(wide: DataFrame, columns: list[str], least_var: float = 1e-6, most_null: float = 0.3) -> DataFrame:
    """name, variance, null_rate, keep: one scan for all columns. A null variance survives."""
    rows = melt(wide, (), columns).groupBy("name").agg(
        F.var_samp("value").alias("variance"), (F.count_if(F.col("value").isNull()) / (F.count("*") + 1e-10)).alias("null_rate")
    )
    keep = F.coalesce(F.col("variance") > least_var, F.lit(True)) & (F.col("null_rate") < most_null)
    return rows.withColumn("keep", keep)


def correlation_pairs(wide: DataFrame, columns: list[str]) -> DataFrame:
    """first, second, corr for the upper triangle, by one aggregation over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]))
    return row.select(each.alias("x")).select("x.*")


def greedy_drop(pairs: list[tuple[str, str, float]], order: list[str], most: float = 0.95) -> list[str]:
    """Names kept, in order: each is kept unless it correlates with one kept before."""
    close = {frozenset((a, b)) for a, b, c in pairs if c is not None and abs(c) >= most}
    kept: list[str] = []
    for name in order:
        if not any(frozenset((name, k)) in close for k in kept):
            kept.append(name)
    return kept


def blocked_correlation(wide: DataFrame, columns: list[str], most: float = 0.95, block: int = 500) -> list[str]:
    """Names kept in order, for columns by the thousand: blocks of columns first, then what is left across blocks.

    Each step is one aggregate of at most block * block correlations, so no plan holds all pairs.
    """

    def close(left: list[str], right: list[str]) -> list[tuple[str, str, float]]:
        pairs = [(a, b) for a in left for b in right if a != b and (left is not right or left.index(a) < right.index(b))]
        if not pairs:
            return []
        row = wide.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
        return [(a, b, row[k]) for k, (a, b) in enumerate(pairs)]

    parts = [columns[at : at + block] for at in range(0, len(columns), block)]
    kept: list[str] = []
    for part in parts:
        own = greedy_drop(close(part, part), part, most)
        for at in range(0, len(kept), block):
            before = kept[at : at + block]
            near = {b for _, b, c in close(before, own) if c is not None and abs(c) >= most}
            own = [c for c in own if c not in near]
        kept += own
    return kept


def ks_statistic(rows: DataFrame, value: str, half: Column, by: str = "name") -> DataFrame:
    """Largest distance of the two halves' distribution functions, and its p-value, by name.

    Values are counted first, so that ties step together. Running counts follow
    the value within PIECES ranges of it, cut at approximate quantiles, on top of
    the totals of the ranges below: no task orders all values of a name.
    half: true for the first sample.
    """
    x = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), half.alias("h"))
    n = x.groupBy(by).agg(F.count_if("h").alias("n1"), F.count_if(~F.col("h")).alias("n2"))
    steps = x.groupBy(by, "v").agg(F.count_if("h").alias("k1"), F.count_if(~F.col("h")).alias("k2"))
    cuts = steps.groupBy(by).agg(F.percentile_approx("v", F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)]), 10 * PIECES).alias("_cuts"))
    steps = steps.join(cuts, by).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts")
    pieces = steps.groupBy(by, "_piece").agg(F.sum("k1").alias("p1"), F.sum("k2").alias("p2"))
    lower = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(by, "_piece", F.coalesce(F.sum("p1").over(lower), F.lit(0)).alias("u1"), F.coalesce(F.sum("p2").over(lower), F.lit(0)).alias("u2"))
    w = Window.partitionBy(by, "_piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(pieces, [by, "_piece"])
    run = run.withColumns({"c1": F.col("u1") + F.sum("k1").over(w), "c2": F.col("u2") + F.sum("k2").over(w)}).join(n, by)
    d = run.groupBy(by, "n1", "n2").agg(F.max(F.abs(F.try_divide("c1", "n1") - F.try_divide("c2", "n2"))).alias("d"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    terms = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)), F.lit(0.0))
    p = F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))
    return d.withColumn("p", p).withColumn("unstable", (F.col("p") < 0.05) & (F.col("n1") + F.col("n2") >= 200))


def neutralise(rows: DataFrame, y: str, x: str, n: int, least: int = 30, by: str = "symbol", order: str = "bucket") -> DataFrame:
    """Residual of y on x by rolling least squares over the last n rows; null where fewer than `least`."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    a, b = F.coalesce(F.col(y), F.lit(0.0)), F.coalesce(F.col(x), F.lit(0.0))
    mx, my = F.avg(b).over(w), F.avg(a).over(w)
    var = F.greatest(F.avg(b * b).over(w) - mx * mx, F.lit(0.0))
    beta = (F.avg(a * b).over(w) - mx * my) / (var + 1e-10)
    full = F.count(F.lit(1)).over(w) >= least
    return rows.withColumn(f"{y}_neutralized", F.when(full, a - (my - beta * mx) - beta * b))


def parity(captured: DataFrame, reference: DataFrame, rtol: float = 1e-7, atol: float = 1e-12) -> DataFrame:
    """One row per (timeframe, name): total, passed, failed, and rows without a partner on each side.

    long frames: timeframe, bucket, name, value. NaN equals NaN.
    """
    keys = ["symbol", "timeframe", "bucket", "name"]
    both = captured.withColumnRenamed("value", "a").withColumn("_l", F.lit(1)).join(
        reference.withColumnRenamed("value", "b").withColumn("_r", F.lit(1)), keys, "full_outer"
    )
    paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    same = (F.isnan("a") & F.isnan("b")) | (F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b")) | (F.col("a").isNull() & F.col("b").isNull())
    ok = paired & F.coalesce(same, F.lit(False))
    return both.groupBy("timeframe", "name").agg(
        F.count_if(paired).alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(paired & ~ok).alias("failed"),
        F.count_if(F.col("_r").isNull()).alias("only_captured"),
        F.count_if(F.col("_l").isNull()).alias("only_reference"),
    )


def failure_hints(summary: DataFrame) -> DataFrame:
    """Whether the failures of a parity summary lie in one timeframe or one feature."""
    bad = summary.filter("failed > 0")
    return bad.agg(
        F.sum("failed").alias("failed"),
        (F.countDistinct("timeframe") == 1).alias("single_timeframe"),
        (F.countDistinct("name") == 1).alias("single_feature"),
    )


def out_of_bounds(rows: DataFrame, train: Column, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Number of columns outside the training rows' quantiles, by row."""
    q = rows.filter(train).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns])
    flags = sum(((F.col(c) < F.col(f"_{c}")[0]) | (F.col(c) > F.col(f"_{c}")[1])).cast("int") for c in columns)
    # One row of bounds.
    return rows.crossJoin(F.broadcast(q)).withColumn("n_outside", flags).drop(*[f"_{c}" for c in columns])


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return F.greatest(F.least(F.ln(q / (1 - q)), F.lit(10.0)), F.lit(-10.0))


def timeframe_of(name: Column) -> Column:
    """The timeframe suffix of a feature's name, by itself, not as a part of another word."""
    sizes = "M0\\.5|M15|M30|M1|M3|M5|M8|H12|H1|H4|H6|D1|W1|MN"
    return F.regexp_extract(name, f"(?<![A-Za-z0-9])({sizes})(?![A-Za-z0-9])", 1)


def model_of(name: Column) -> Column:
    return F.when(name.rlike("^e1[bcd]_"), 1).when(name.rlike("^e1[aef]_"), 2)


