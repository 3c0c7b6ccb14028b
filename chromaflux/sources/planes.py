"""Binary traces of two-dimensional runs, read through Spark: one task may take many files, one file is one signal."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the mark before the first block, how far before it blocks begin, and the largest block that is one
MARK, BACK, MOST = b"\xe1\x40", 18, 2000


def blocks(data: bytes) -> np.ndarray:
    """Values of a trace: blocks of two numbers, a count and so many doubles; too large a count moves on by one byte."""
    at = data.find(MARK)
    if at < 0:
        return np.empty(0)
    at, out = max(0, at - BACK), []
    while at + 12 <= len(data):
        count = struct.unpack_from("<I", data, at + 8)[0]
        if count > MOST:
            at += 1
            continue
        if at + 12 + 8 * count > len(data):
            break
        out.append(np.frombuffer(data, "<f8", count, at + 12))
        at += 12 + 8 * count
    return np.concatenate(out) if out else np.empty(0)


def header(text: str) -> tuple[float, float]:
    """(rate in Hz, modulation in s) of ``key = value`` lines; ``;`` begins a comment; either missing raises."""
    pairs = {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines() if not line.lstrip().startswith(";"))}
    found = {k: next((float(v.split()[0]) for key, v in pairs.items() if k in key), None) for k in ("data rate", "cal modulation pulse")}
    if None in found.values():
        raise ValueError(f"header lacks {[k for k, v in found.items() if v is None]}")
    return found["data rate"], found["cal modulation pulse"]


def traces(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, seq, y of all trace files under ``path``, read through Spark so that any store will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1).alias("sample_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = blocks(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y), pa.string()), pa.array(np.arange(len(y), dtype=np.int64)), pa.array(y)], names=["sample_id", "seq", "y"])

    return named.mapInArrow(run, "sample_id string, seq long, y double")


def signal(spark: SparkSession, path: str, rate: float | None = None) -> DataFrame:
    """:func:`traces` as signals: sample_id, seq, x, y; x in minutes at ``rate`` Hz, without a rate the place itself."""
    x = F.col("seq").cast("double") if rate is None else F.col("seq") / F.lit(60.0 * rate)
    return traces(spark, path).select("sample_id", "seq", x.alias("x"), "y")


#: fixed values: tag of a spectrum block, where its count stands, and the size of a record and the place of its intensity
TAG, COUNT_AT, RECORD, INTENSITY_AT = b"SD04", 12, 16, 8


def spectrum_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(m/z in thousandths, intensity) of each block of a spectrum file; a block that is cut short ends it, none at all raises."""
    at = data.find(TAG, 0, 128 << 10)
    if at < 0:
        raise ValueError("no spectrum block within the first 128 KB")
    record = np.dtype({"names": ["mz", "intensity"], "formats": ["<u4", "<f8"], "offsets": [0, INTENSITY_AT], "itemsize": RECORD})
    while data[at : at + 4] == TAG and at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if size < 8 + COUNT_AT + 4 or at + size > len(data):
            return
        count = struct.unpack_from("<I", data, body + COUNT_AT)[0]
        rows = np.frombuffer(data, record, count, body + COUNT_AT + 4)
        yield rows["mz"], rows["intensity"]
        at += size


def plane_ions(spark: SparkSession, path: str, suffix: str = ".lsc") -> DataFrame:
    """sample_id, scan, mz_milli, intensity of all spectrum files under ``path``; scans without ions have one row of nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    named = files.select(F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)*$", 1).alias("sample_id"), "content")
    names = ["sample_id", "scan", "mz_milli", "intensity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for scan, (mz, intensity) in enumerate(spectrum_blocks(content)):
                    n = max(1, len(mz))
                    columns = [pa.array([name] * n, pa.string()), pa.array([scan] * n, pa.int64()), pa.array(mz.astype(np.int64)) if len(mz) else pa.nulls(1, pa.int64()), pa.array(intensity) if len(mz) else pa.nulls(1, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return named.mapInArrow(run, "sample_id string, scan long, mz_milli long, intensity double")


def plane_tic(ions: DataFrame) -> DataFrame:
    """Total current of each scan."""
    return ions.groupBy("sample_id", "scan").agg(F.coalesce(F.sum("intensity"), F.lit(0.0)).alias("tic"))


def plane_spectrum(ions: DataFrame, scans: DataFrame) -> DataFrame:
    """Spectra of the asked scans (sample_id, scan) by whole m/z, halves to even; a scan without ions gives no rows."""
    own = ions.filter("mz_milli is not null").join(scans.select("sample_id", "scan"), ["sample_id", "scan"], "left_semi")
    return own.groupBy("sample_id", "scan", F.bround(F.col("mz_milli") / 1000).cast("int").alias("mz")).agg(F.sum("intensity").alias("intensity"))
