"""Runs as a Spark data source: ``spark.read.format("chromaflux")``, a partition for each file, filters on run and channel pushed to the list of files.

Options: ``path`` (a folder, or one file, of any store that Arrow's file systems reach) and ``kind``:

* ``gc``: delimited files with a header; ``x`` and ``y`` name columns or give their places (0 and 1 without)
* ``ftir``: delimited files without a header
* ``uvvis``: wide files of spectra; a channel is a spectrum's number
* ``gcxgc``: binary traces; x is minutes at ``rate`` Hz, without a rate the place itself
* ``container``: folders with a ``manifest.json``; the first delimited file of ``data`` is read, by the columns that the manifest names

Rows are sample_id (name of the file, or of the container's folder), channel, seq, x, y. Give a narrower schema to
``spark.read.schema`` and only its columns are made. Filters reach the source where ``spark.sql.python.filterPushdown.enabled`` is on
(:func:`register` sets it): equality, membership and beginnings of sample_id and channel.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .planes import blocks

NAME = "chromaflux"
SCHEMA = "sample_id string, channel string, seq long, x double, y double"
#: Files of each kind, and the channel of those that have one.
KINDS = {"gc": ("*.csv", "gc"), "ftir": ("*.csv", "ftir"), "uvvis": ("*.csv", None), "gcxgc": ("*.bin", "fid"), "container": ("manifest.json", "container")}
#: Rows of a batch that a reader gives.
ROWS = 1 << 16


@dataclass
class Run(InputPartition):
    """One file, or one container."""

    path: str
    sample_id: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _files(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return files, [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return files, sorted(f.path for f in files.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File)


class Runs(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options = dict(options)
        self.names = schema.names
        if unknown := set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"there are no columns {sorted(unknown)}")
        self.kind = self.options.get("kind", "gc")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}; there are {sorted(KINDS)}")
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, membership and beginnings of run and channel; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("sample_id", "channel") and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith)):
                self.filters.append((column, type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _lets(self, column: str, value: str) -> bool:
        hold = {"EqualTo": lambda v: value == v, "EqualNullSafe": lambda v: value == v, "In": lambda v: value in v, "StringStartsWith": lambda v: value.startswith(v)}
        return all(hold[how](v) for c, how, v in self.filters if c == column)

    def partitions(self) -> list[InputPartition]:
        """The files whose name and channel pass the filters; no file is opened."""
        pattern, channel = KINDS[self.kind]
        if channel is not None and not self._lets("channel", self.options.get("channel", channel)):
            return []
        _, found = _files(self.options["path"])
        runs = []
        for f in found:
            if fnmatch.fnmatch(posixpath.basename(f), self.options.get("pattern", pattern)):
                name = posixpath.basename(posixpath.dirname(f) if self.kind == "container" else f)
                name = name.rpartition(".")[0] or name
                if self._lets("sample_id", name):
                    runs.append(Run(f, name))
        return runs

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file passed the filters
            return
        files = _files(self.options["path"])[0] if "://" in self.options["path"] else None
        from pyarrow import fs

        files = files or fs.LocalFileSystem()
        for channel, x, y in self._signals(files, partition.path):
            if not self._lets("channel", channel):
                continue
            kinds = {"sample_id": pa.string(), "channel": pa.string(), "seq": pa.int64(), "x": pa.float64(), "y": pa.float64()}
            for at in range(0, len(y), ROWS):
                n = min(ROWS, len(y) - at)
                own = {"sample_id": lambda n: [partition.sample_id] * n, "channel": lambda n: [channel] * n, "seq": lambda n: np.arange(at, at + n), "x": lambda n: x[at : at + n], "y": lambda n: y[at : at + n]}  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(own[c](n), kinds[c]) for c in self.names], names=self.names)

    def _signals(self, files, path: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(channel, x, y) of what a file holds."""
        channel = self.options.get("channel", KINDS[self.kind][1])
        if self.kind == "gcxgc":
            with files.open_input_stream(path) as f:
                y = blocks(f.read())
            rate = self.options.get("rate")
            yield channel, np.arange(len(y)) / (60.0 * float(rate)) if rate else np.arange(len(y), dtype=float), y
        elif self.kind == "uvvis":
            yield from self._spectra(files, path)
        elif self.kind == "container":
            with files.open_input_stream(path) as f:
                manifest = json.loads(f.read())
            if not manifest.get("signal_type"):
                raise ValueError(f"{path} has no signal type")
            from pyarrow import fs

            data = posixpath.join(posixpath.dirname(path), "data")
            tables = sorted(f.path for f in files.get_file_info(fs.FileSelector(data)) if f.path.lower().endswith(".csv"))
            if not tables:
                raise FileNotFoundError(f"no delimited file in {data}")
            columns = manifest.get("csv_columns") or {}
            yield channel, *self._columns(files, tables[0], columns.get("x", 0), columns.get("y", 1), True)
        else:
            yield channel, *self._columns(files, path, self.options.get("x", 0), self.options.get("y", 1), self.kind == "gc")

    def _columns(self, files, path: str, x: str | int, y: str | int, header: bool) -> tuple[np.ndarray, np.ndarray]:
        """The two columns of a delimited file, and no other; one that isn't there raises KeyError."""
        from pyarrow import csv

        with files.open_input_stream(path) as f:
            first = f.read(1 << 16).split(b"\n", 1)[0].decode().rstrip("\r").split(",")
        names = first if header else [str(i) for i in range(len(first))]

        def name(c: str | int) -> str:
            if c in names and header:
                return c
            if str(c).lstrip("-").isdigit() and -len(names) <= int(c) < len(names):
                return names[int(c)]
            raise KeyError(c)

        wanted = dict.fromkeys([name(x), name(y)])
        with files.open_input_stream(path) as f:
            table = csv.read_csv(f, csv.ReadOptions(column_names=names, skip_rows=int(header)), convert_options=csv.ConvertOptions(include_columns=list(wanted), column_types=dict.fromkeys(wanted, pa.float64())))
        return table[name(x)].to_numpy(), table[name(y)].to_numpy()

    def _spectra(self, files, path: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """The spectra of a wide file: five rows of settings, then a wavelength and a value for each spectrum."""
        from pyarrow import csv

        with files.open_input_stream(path) as f:
            names = f.readall().split(b"\n", 1)[0].decode().rstrip("\r").split(",")
        names = [str(i) for i in range(len(names))]
        wanted = [n for n in names[1:] if self._lets("channel", n)]
        if not wanted:
            return
        with files.open_input_stream(path) as f:
            table = csv.read_csv(f, csv.ReadOptions(column_names=names, skip_rows=5), convert_options=csv.ConvertOptions(include_columns=["0", *wanted], column_types=dict.fromkeys(["0", *wanted], pa.float64())))
        x = table["0"].to_numpy()
        order = np.argsort(x, kind="stable")
        for n in wanted:
            y = table[n].to_numpy()
            held = order[~(np.isnan(x) | np.isnan(y))[order]]
            yield n, x[held], y[held]


class Signals(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Runs(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Signals)
