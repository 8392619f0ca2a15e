"""Tick sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "time", "bid", "ask", "last", "volume", "flags")])


def read_tsv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tab-separated quote lines, within a range of dates (yyyy.MM.dd, both ends in) if given.

    Lines with fewer than six fields or that do not parse are dropped by
    `valid`; empty fields are null.
    """
    raw = spark.read.csv(path, sep="\t", schema=RAW, mode="PERMISSIVE", header=False, emptyValue="", nullValue="")
    if start or end:
        raw = raw.filter(F.col("date").between(start or "0000", end or "9999"))
    ts = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm:ss.SSS"))
    return raw.filter("volume is not null or flags is not null or last is not null").select(
        ts.alias("ts"),
        *[F.expr(f"try_cast({c} as float)").alias(c) for c in ("bid", "ask", "last")],
        F.expr("try_cast(volume as bigint)").alias("volume"),
        F.expr("try_cast(flags as int)").alias("flags"),
    )


def valid(ticks: DataFrame) -> DataFrame:
    return ticks.filter("ts is not null and bid is not null and ask is not null and bid > 0 and ask > 0")


def derived(ticks: DataFrame) -> DataFrame:
    """Spread, mid price and the date parts that partition the sink."""
    return ticks.withColumns(
        {
            "spread": F.col("ask") - F.col("bid"),
            "mid_price": (F.col("ask") + F.col("bid")) / 2,
            "year": F.year("ts"),
            "month": F.month("ts"),
            "day": F.dayofmonth("ts"),
        }
    )


def write_partitioned(ticks: DataFrame, path: str, by: tuple[str, ...] = ("year", "month", "day"), mode: str = "overwrite") -> None:
    """Hive-partitioned sink; with dynamic overwrite only the partitions that are written change."""
    ticks.repartition(*by).sortWithinPartitions("ts").write.mode(mode).option("compression", "zstd").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)


def write_sorted(ticks: DataFrame, path: str) -> None:
    ticks.sort("ts").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_period(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Months first to last of a partitioned table; only their folders are read."""
    month = F.col("year") * 12 + F.col("month")
    return spark.read.parquet(path).filter(month.between(first[0] * 12 + first[1], last[0] * 12 + last[1]))


def compact(spark: SparkSession, source: str, target: str, by: tuple[str, ...] = ("year", "month")) -> None:
    """Small daily files to one set of files per month."""
    spark.read.parquet(source).repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(target)


def missing_days(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """Days of `wanted` that a resumed run has still to write."""
    return wanted.join(done.select("year", "month", "day").distinct(), ["year", "month", "day"], "left_anti")


def feature_names(spark: SparkSession, paths: list[str], drop: tuple[str, ...] = ("sample_weight",)) -> DataFrame:
    """Sorted union of feature lists, one name per line."""
    names = spark.read.text(paths).select(F.trim("value").alias("name"))
    return names.filter((F.col("name") != "") & ~F.col("name").isin(*drop)).distinct().orderBy("name")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: symbol, ts, seq, price, and quotes of one cent to either side."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (F.col("value") - 0.01).alias("bid"),
        (F.col("value") + 0.01).alias("ask"),
        "user_id",
    )
