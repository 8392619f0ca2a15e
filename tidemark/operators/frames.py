"""Small frame operations: names, periods, rows kept by order, folds by rows, targets, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixed(df: DataFrame, suffix: str, keys: tuple[str, ...]) -> DataFrame:
    """Every column but the keys renamed to name_suffix."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keys else f"{c}_{suffix}") for c in df.columns])


def normalised(df: DataFrame, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns renamed to the first known name of which they are a spelling, whatever their case; others stay."""
    by = {a.lower(): name for name, spellings in known.items() for a in (name, *spellings)}
    taken: set[str] = set()
    out = []
    for c in df.columns:
        name = by.get(c.lower(), c)
        if name in taken:
            name = c
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def name_parts(name: Column) -> dict[str, Column]:
    """engine, base and timeframe of a feature's name: the prefix up to the first underscore, the last part, what lies between."""
    return {
        "engine": F.regexp_extract(name, "^(e1[a-f])_", 1),
        "base": F.regexp_replace(name, "^e1[a-f]_|_[^_]*$", ""),
        "timeframe": F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", -1)),
    }


def excluded(name: Column, exact: tuple[str, ...] = (), parts: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a name is one of `exact`, holds one of `parts`, or begins with one of `prefixes`."""
    out = name.isin(*exact) if exact else F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def in_period(at: Column, mode: str, year: int | None = None, month: int | None = None) -> Column:
    """all; year: that year; month: that month of that year."""
    if mode == "all":
        return F.lit(True)
    return (F.year(at) == year) & (F.lit(True) if mode == "year" else F.month(at) == month)


def is_trigger(ratio: Column, least: float = 0.8) -> Column:
    return F.when(ratio >= least, 1).otherwise(0).cast("tinyint")


def last_close(ticks: DataFrame, seconds: int = 300, by: str = "symbol") -> DataFrame:
    """The last price of each bucket that has one, and its change since the one before."""
    bucket = F.timestamp_micros(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * (seconds * 1_000_000))
    rows = ticks.groupBy(by, bucket.alias("bucket")).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"))
    before = F.lag("close").over(Window.partitionBy(by).orderBy("bucket"))
    return rows.withColumn("change", F.try_divide(F.col("close") - before, before))


def resample_right(ticks: DataFrame, seconds: int = 30, by: str = "symbol") -> DataFrame:
    """Buckets closed and labelled on the right: a tick at a border belongs to the bucket that ends there."""
    step = seconds * 1_000_000
    end = F.timestamp_micros(F.ceil(F.unix_micros("ts") / step) * step)
    at = F.struct("ts", "seq")
    return ticks.groupBy(by, end.alias("bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume")
    )


def tail(df: DataFrame, n: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def first_seen(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The first value that is not null, by column and group."""
    at = F.struct(*order)
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def unique(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], keep: str = "first") -> DataFrame:
    """One row of each group, the first or last in order; reduced in every map task, so a hot group is no task of its own."""
    whole, at = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)
    one = (F.min_by if keep == "first" else F.max_by)(whole, at)
    return df.groupBy(*by).agg(one.alias("_one")).select("_one.*")


def fold_means(df: DataFrame, fold: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows and means by fold."""
    return df.groupBy(fold).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def targets(bars: DataFrame, steps: dict[str, int], column: str = "close", by: str = "symbol", order: str = "bucket") -> DataFrame:
    """name -> the relative change over the next `steps` rows; null where they are not there yet."""
    w = Window.partitionBy(by).orderBy(order)
    return bars.withColumns({k: F.try_divide(F.lead(column, n).over(w), F.col(column)) - 1 for k, n in steps.items()})


def top_k(df: DataFrame, metric: str, k: int, ties: tuple[str, ...]) -> DataFrame:
    """The k rows of largest metric; equal ones by `ties`."""
    return df.orderBy(F.desc_nulls_last(metric), *ties).limit(k)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for a seed wherever the rows lie."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed).cast("string"))), key).limit(n)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the names of any; null where a frame has no such column."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def name_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """name and where it is: left, right or both. Each side counts once."""
    a, b = left.select("name").distinct().withColumn("l", F.lit(1)), right.select("name").distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, "name", "full_outer").select("name", side.alias("side"))


def purged_rows(df: DataFrame, k: int, purge: int, embargo: int, by: str, order: tuple[str, ...]) -> DataFrame:
    """fold, position, role by row position within a group: train rows lie before first - purge or after last + embargo."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumn("position", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    first = F.col("fold") * size
    last = F.when(F.col("fold") == k - 1, F.col("_n")).otherwise((F.col("fold") + 1) * size) - 1
    role = F.when(F.col("position").between(first, last), "test").when((F.col("position") < first - purge) | (F.col("position") > last + embargo), "train")
    return rows.withColumn("role", role).filter("role is not null").drop("_n")


def expanding(df: DataFrame, fold: str, folds: int) -> DataFrame:
    """round i: rows of the folds up to i train, those of fold i + 1 test; folds count from 1."""
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(max(1, folds - 1)))))
    role = F.when(F.col(fold) <= F.col("round"), "train").when(F.col(fold) == F.col("round") + 1, "test")
    return rounds.withColumn("role", role).filter(F.col("role").isNotNull() & F.lit(folds > 1))


def baseline_ratio(bars: DataFrame, value: str, short: int, long: int, floor: float, by: str = "symbol", order: str = "bucket") -> DataFrame:
    """The mean of the last `short` rows over that of the last `long`, and whether the latter reaches a floor; null until full."""
    w = Window.partitionBy(by).orderBy(order)
    mean = lambda n: F.when(F.count(value).over(w.rowsBetween(-(n - 1), 0)) == n, F.avg(value).over(w.rowsBetween(-(n - 1), 0)))
    return bars.withColumns({"baseline": mean(long), "ratio": F.try_divide(mean(short), mean(long)), "above_floor": mean(long) >= floor})


def bar_first_hit(bets: DataFrame, bars: DataFrame, ahead: int, target: Column, stop: Column, by: str = "symbol") -> DataFrame:
    """Labels at bar grain: the first of the next `ahead` bars that reaches target or stop; on one bar the target counts.

    bets: id, symbol, bucket and what target and stop (price levels) read; bars: symbol, bucket, high, low.
    Bars are numbered, so each bet meets `ahead` bars by equality of a block of numbers.
    """
    w = Window.partitionBy(by).orderBy("bucket")
    numbered = bars.select(by, "bucket", "high", "low", F.row_number().over(w).alias("k"))
    own = bets.withColumns({"_up": target, "_down": stop}).join(numbered.select(by, "bucket", "k"), [by, "bucket"])
    own = own.withColumn("_block", F.explode(F.sequence(F.floor((F.col("k") + 1) / ahead), F.floor((F.col("k") + ahead) / ahead))))
    right = numbered.select(by, F.col("k").alias("_k"), "high", "low", F.floor(F.col("k") / ahead).alias("_block"))
    meets = own.join(right, [by, "_block"], "left")
    inside = (F.col("_k") > F.col("k")) & (F.col("_k") <= F.col("k") + ahead)
    hit = lambda cond: F.min(F.when(inside & cond, F.col("_k") - F.col("k")))
    out = meets.groupBy(*bets.columns).agg(hit(F.col("high") >= F.col("_up")).alias("_pt"), hit(F.col("low") <= F.col("_down")).alias("_sl"))
    won = F.col("_pt").isNotNull() & (F.col("_sl").isNull() | (F.col("_pt") <= F.col("_sl")))
    reason = F.when(won, "target").when(F.col("_sl").isNotNull(), "stop").otherwise("time")
    bars_held = F.coalesce(F.when(won, F.col("_pt")).otherwise(F.col("_sl")), F.lit(ahead))
    return out.withColumns({"label": won.cast("int"), "reason": reason, "bars_held": bars_held}).drop("_pt", "_sl")


def write_log(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A log or ranking as CSV with a header, or as lines of JSON."""
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def read_log(spark, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """The log back; lines that do not fit the schema have nulls."""
    return spark.read.schema(schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(schema).json(path)
