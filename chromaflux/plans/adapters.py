"""The driver's tables in the roles of the domain: events as signals, line items as peaks, parts as method tables, embeddings as spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, seq, x (minutes since 2024-01-01), y, channel."""
    e = table(spark, sf_dir, "events")
    x = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(6e7)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("sample_id"), seq.cast("long").alias("seq"), x.alias("x"), F.col("value").alias("y"), F.col("event_type").alias("channel"))


#: DuckDB: the same table.
SIGNALS = """signals AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7 AS x, value AS y, event_type AS channel FROM events)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, peak_number, part, rt, area: peaks of an order in order of date, line and part."""
    line = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    return line.select(F.col("l_orderkey").alias("sample_id"), n.cast("long").alias("peak_number"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("rt"), F.col("l_extendedprice").alias("area"))


PEAKS = """peaks AS (SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS peak_number,
  l_partkey AS part, l_quantity AS rt, l_extendedprice AS area FROM lineitem)"""


def rt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, compound, start, apex, end: a method's windows, one for each nation."""
    k = F.col("n_nationkey")
    start = (k * 2).cast("double")
    return table(spark, sf_dir, "nation").select(k.alias("seq"), F.concat(F.lit("cmp"), k.cast("string")).alias("compound"), start.alias("start"), (start + 0.5 + k % 3 * 0.25).alias("apex"), (start + 1.25 + k % 4 * 0.5).alias("end"))


RT_TABLE = """rt_table AS (SELECT n_nationkey AS seq, 'cmp' || n_nationkey AS compound, (n_nationkey * 2)::DOUBLE AS start, n_nationkey * 2 + 0.5 + n_nationkey % 3 * 0.25 AS apex,
  n_nationkey * 2 + 1.25 + n_nationkey % 4 * 0.5 AS "end" FROM nation)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, mz, intensity: absolute values of the vectors as ions 1 to 64."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("i", "v"))
    return long.select("id", "label", (F.col("i") + 1).alias("mz"), F.abs(F.col("v").cast("double")).alias("intensity"))


SPECTRA = """spectra AS (SELECT vec_id AS id, label, i AS mz, abs(embedding[i]::DOUBLE) AS intensity FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"""
