"""Tables kept in the folder that all executors share, so that what follows sees the same rows however often it runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a session on one machine gets one, a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chromaflux-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chromaflux-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
