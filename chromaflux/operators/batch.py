"""A batch of runs in one go: peaks, components of neighbouring peaks, library search, with what failed said per peak."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import kept
from . import extract as E
from . import signal as G


def isolated_batch(samples: DataFrame, scans: DataFrame, library: DataFrame, names: DataFrame, method: G.Method, gap: float, tolerance: float = 0.05, **deconvolution: float) -> DataFrame:
    """:func:`batch` of the runs that can be integrated; a run that raises has one row with its ``error`` and no peak."""
    peaks, failed = G.run_isolated(samples, method)
    done = _searched(peaks, scans, library, names, gap, tolerance, **deconvolution)
    return done.unionByName(failed, allowMissingColumns=True)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs that this thread begins inside carry ``tag``; what is yielded cancels those that still run, as does :func:`cancel` from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield lambda: cancel(spark, tag)
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends all jobs that run under ``tag``; their callers get an error."""
    spark.sparkContext.cancelJobsWithTag(tag)


def batch(samples: DataFrame, scans: DataFrame, library: DataFrame, names: DataFrame, method: G.Method, gap: float, tolerance: float = 0.05, **deconvolution: float) -> DataFrame:
    """Peaks of all runs with their best library hit.

    A peak's spectrum is that of the component it was given; a peak without one has the spectrum of its own scans
    (``spectrum`` says which). A peak that neither gives a spectrum for keeps its label and says so in ``error``; no other
    peak or run is held up. samples: sample_id, seq, x, y; scans: sample_id, scan, rt, mz, intensity; library: id, mz,
    intensity; names: id, name, casno.
    """
    return _searched(G.run(samples, method), scans, library, names, gap, tolerance, **deconvolution)


def _searched(integrated: DataFrame, scans: DataFrame, library: DataFrame, names: DataFrame, gap: float, tolerance: float, **deconvolution: float) -> DataFrame:
    # peaks are read by five steps below: kept, so that signals are integrated once
    found = kept(integrated.select("sample_id", F.col("peak_number").cast("long").alias("peak"), F.col("retention_time").alias("rt"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "area", "compound_id"))
    parts = E.windowed_deconvolution(found, scans, gap, tolerance, **deconvolution).filter("peak is not null")
    own = parts.groupBy("sample_id", "peak", "mz").agg(F.sum("intensity").alias("intensity"))
    rest = found.join(own.select("sample_id", "peak").distinct(), ["sample_id", "peak"], "left_anti")
    raw = E.peak_spectra(scans, rest.select("sample_id", "peak", "start", "end")).select("sample_id", "peak", "mz", "intensity")
    ions = own.withColumn("spectrum", F.lit("component")).unionByName(raw.withColumn("spectrum", F.lit("scans")))
    kind = ions.select("sample_id", "peak", "spectrum").distinct()
    searched = E.batch_search(found.withColumn("manual", F.lit(False)), ions.drop("spectrum"), library, names).drop("manual")
    return searched.join(kind, ["sample_id", "peak"], "left")


def observed(results: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """``results`` and what passes by as they are written: peaks, peaks with a hit and peaks with an error. A job group cancels it."""
    seen = Observation(name)
    return results.observe(seen, F.count("*").alias("peaks"), F.count("match_score").alias("matched"), F.count("error").alias("errors")), seen
