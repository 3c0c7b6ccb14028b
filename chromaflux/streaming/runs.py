"""A run for each arrival: files are taken up once, processed in micro-batches, and what fails goes to a table of its own.

A file stream remembers the paths it has seen in its checkpoint. Each micro-batch is written under its number, in place of
whatever an interrupted attempt left there, so after a restart every run is there once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import signal as G

def arriving_runs(spark: SparkSession, folder: str, pattern: str = "*.csv", per_batch: int = 100, header: bool = True) -> DataFrame:
    """Samples of the delimited files that appear under ``folder``: sample_id (file name), path, line (text as it is, place in the file).

    A file counts once by its path, whatever happens to it later; at most ``per_batch`` files make a micro-batch.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    files = reader.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]+?)(?:\\.[^./]*)?$", 1).alias("sample_id"), F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("sample_id", "path", F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("seq", "line"))
    return lines.filter("seq > 0") if header else lines


def samples_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, failures): the lines' numbers, and the runs with a line that isn't two numbers, which have no samples."""
    cells = F.split("line", ",")
    read = lines.select("sample_id", F.col("seq").cast("long").alias("seq"), F.get(cells, F.lit(0)).try_cast("double").alias("x"), F.get(cells, F.lit(1)).try_cast("double").alias("y"))
    wrong = F.min(F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("seq"))).over(Window.partitionBy("sample_id"))
    marked = read.withColumn("wrong", wrong)
    bad = marked.filter("wrong is not null").select("sample_id", F.concat(F.lit("no two numbers in line "), F.col("wrong").cast("string")).alias("error")).distinct()
    return marked.filter("wrong is null").drop("wrong"), bad


def run_each(spark: SparkSession, folder: str, out: str, checkpoint: str, method: G.Method = G.Method(), once: bool = True, **options) -> StreamingQuery:
    """Starts the watcher: peaks of each run to ``out``/peaks, failures (sample_id, error) to ``out``/failures, both by micro-batch.

    With ``once`` it takes what is there and ends, else it goes on. A restart with the same ``checkpoint`` continues.
    """

    def put(lines: DataFrame, number: int) -> None:
        held = lines.persist()
        try:
            samples, unread = samples_of(held)
            peaks, failed = G.run_isolated(samples, method)
            peaks.write.mode("overwrite").parquet(f"{out}/peaks/batch={number}")
            unread.unionByName(failed).write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        finally:
            held.unpersist()

    writer = arriving_runs(spark, folder, **options).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def results(spark: SparkSession, out: str, table: str = "peaks") -> DataFrame:
    """What the watcher has written: ``peaks`` or ``failures``, with the ``batch`` of each."""
    return spark.read.option("basePath", f"{out}/{table}").parquet(f"{out}/{table}")


@dataclass
class Progress(StreamingQueryListener):
    """What streams report as they go: per query name the rows and batches so far, when last, and how it ended."""

    rows: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    last: dict[str, datetime] = field(default_factory=dict)
    ended: dict[str, str | None] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.batches[name] = p.batchId + 1
        self.last[name] = datetime.now(UTC)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[self.names.get(str(event.id), str(event.id))] = event.exception
