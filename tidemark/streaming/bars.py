"""The streaming twin of the bars: watermarked tumbling windows, and their parity with batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import SECONDS
from tidemark.sources.ticks import event_ticks


def windows(ticks: DataFrame, size: str = "H1", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks; a bar is emitted once the watermark has passed its end."""
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{SECONDS[size]} seconds").alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")
    )


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks from Parquet files that arrive in a folder."""
    schema = "symbol string, ts timestamp, seq bigint, price double, bid double, ask double, user_id bigint"
    return spark.readStream.schema(schema).parquet(folder)


def run_once(spark: SparkSession, sf_dir: str, size: str = "H1", name: str | None = None) -> DataFrame:
    """Land the ticks as files, stream all that is there, and return the closed bars.

    Bars that the watermark has not passed stay open in the state for the next run.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    event_ticks(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    got = windows(tick_stream(spark, f"{base}/in"), size)
    sink = got.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out")
    running = sink.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out")
