"""Helpers the text operators share: reading whole tables, cutting lineage, running Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) gets a folder of its own; on a cluster it is an error, as what
    executors write to their own disks cannot be read again.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chromaflux-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, group: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs nothing before it.

    The files go when :func:`remove` is called or the application ends. Tables of large rows name the bytes of a row
    ``group``: writers hold a group and readers decode one at a time, and by default the first is not looked at before it has 100 rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chromaflux-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    sizes = {"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group else {}
    df.write.options(**sizes).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame | None) -> None:
    """Deletes the files of tables from :func:`written` that nothing reads any more."""
    for table in tables:
        if table is not None:
            files, at = _file_system(table.sparkSession, table.written_to)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table, cut down to ``columns``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


#: Spark's own number of rows that go to Python in one Arrow batch, and what takes its place for texts.
USUAL_BATCH, TEXT_BATCH = "10000", "1024"


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches have ``TEXT_BATCH`` rows, unless the session has a number of its own: 10,000 long texts a batch are held several times, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, USUAL_BATCH) == USUAL_BATCH:
        spark.conf.set(name, TEXT_BATCH)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` as long and ``text`` without nulls (a null text counts as empty), with ``extra`` columns."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them first."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Rows of an Arrow batch that become Python objects together.
ROWS = 1024

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, rows: int = ROWS) -> Run:
    """``run`` over batches of at most ``rows`` rows (0: as they come), which gives its memory back when a task ends.

    Python workers live on and would keep their largest size.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run((b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)) if rows else batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def arrow_map(df: DataFrame, schema: str, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = ROWS) -> DataFrame:
    """``one`` applied to Arrow batches of at most ``rows`` rows inside Spark tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield out

    return df.mapInArrow(lean(run, rows), schema)


def rows_of(names: list[str], arrays: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=names)
