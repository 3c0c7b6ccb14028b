"""Newly arriving runs: files are picked up once, aggregated in event-time windows, and kept by checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import shared_dir


def arriving(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """Rows of the files that appear under ``path``; each file is read once, whatever fails."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def hourly(rows: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by sample and hour of event time; rows later than ``late`` are dropped, finished hours are emitted."""
    timed = rows.withColumn("time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("time", late).groupBy(F.window("time", width), F.col("user_id").alias("sample_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of each sample: a session ends after ``gap`` without a row."""
    timed = rows.withColumn("time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("time", late).groupBy(F.session_window("time", gap), F.col("user_id").alias("sample_id")).agg(F.count("*").alias("n"))


def start(rows: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet; with the same checkpoint a restarted query goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Takes in what is there now and returns the hourly table: sample_id, hour, n, total."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    rows = arriving(spark, folder, schema, pathGlobFilter=name)
    state = rows.withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp"))).groupBy(F.col("user_id").alias("sample_id"), "hour").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table")

    state.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/table").select("sample_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 6).alias("total"))

