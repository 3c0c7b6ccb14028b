"""Kinds of signal with their readers and defaults, and the engine's functions under names for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import WEIGHTS
from .operators import kernels as K
from .operators import signal as G

#: A reader: (session, path) to the long table of samples. Any function of this shape can take a built-in one's place.
Loader = Callable[[SparkSession, str], DataFrame]
STAGES = ("load", "smooth", "baseline", "peaks", "integrate", "match", "search", "deconvolve", "quantitate", "export")


@dataclass(frozen=True)
class Profile:
    """A kind of signal: its reader, labels, the stages it goes through and its parameters."""

    name: str
    load: Loader | None
    x_label: str
    y_label: str
    stages: tuple[str, ...]
    defaults: dict = field(default_factory=dict)
    inverted_x: bool = False


_PROFILES: dict[str, Profile] = {}


def register_profile(profile: Profile) -> Profile:
    """Adds a kind of signal; a name twice or a stage that is none raises."""
    if profile.name in _PROFILES:
        raise ValueError(f"{profile.name} is there already")
    if unknown := [s for s in profile.stages if s not in STAGES]:
        raise ValueError(f"unknown stages {unknown}")
    _PROFILES[profile.name] = profile
    return profile


def profile(name: str) -> Profile:
    if name not in _PROFILES:
        raise ValueError(f"unknown signal type {name}; there are {sorted(_PROFILES)}")
    return _PROFILES[name]


def load(spark: SparkSession, path: str, kind: str, reader: Loader | None = None) -> DataFrame:
    """Samples of a path by the reader of its kind, or by the one given."""
    found = reader or profile(kind).load
    if found is None:
        raise ValueError(f"{kind} has no reader: give one")
    return found(spark, path)


def _built_in() -> None:
    from .sources import planes, tables

    common = ("load", "smooth", "baseline", "peaks", "integrate", "export")
    register_profile(Profile("gc", tables.csv_signal, "min", "pA", (*common, "match", "quantitate")))
    register_profile(Profile("gcms", None, "min", "counts", STAGES))
    register_profile(Profile("ftir", tables.infrared_csv, "1/cm", "absorbance", common, inverted_x=True))
    register_profile(Profile("uvvis", tables.ultraviolet_signal, "nm", "absorbance", common))
    register_profile(Profile("gcxgc", planes.signal, "min", "pA", common))


_built_in()

#: Column functions as SQL text, inlined by Catalyst: name, parameters, result, body.
SQL_FUNCTIONS = (
    ("molecular_weight", "c INT, h INT, o INT, s INT, n INT", "DOUBLE", " + ".join(f"coalesce({k}, 0) * {v}D" for k, v in WEIGHTS.items())),
    ("rf_composition", "area DOUBLE, factor DOUBLE", "DOUBLE", "CASE WHEN factor = 0 THEN 0D ELSE area / factor END"),
    ("absorbance", "transmittance DOUBLE", "DOUBLE", "-log10(greatest(transmittance, 1D) / 100)"),
    ("sensitivity_snr", "s DOUBLE", "DOUBLE", "CASE WHEN s >= 1 THEN 8 - (s - 1) * 5.5 / 9 ELSE 3 + (s - 0.01) * 7 / 0.09 END"),
)


def register_sql(spark: SparkSession) -> list[str]:
    """Registers the engine's functions with a session, and returns their names.

    Scalars are SQL functions; ``baseline``, ``smoothed`` and ``simpson_area`` take arrays, batch by batch; ``simpson``, ``noise_level``
    and ``asymmetry`` are aggregates of a group's x and y (y alone); ``signal_peaks`` is a table function of a signal's arrays and
    ``run_peaks`` one of a table: ``run_peaks(TABLE(samples) PARTITION BY (sample_id) ORDER BY (x), 0.05)`` gets each run's rows (sample_id, x, y) as they
    are dealt and sorted, without any array column; a third argument ``false`` leaves flat tops out.
    """
    names = []
    for name, params, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
        names.append(name)

    @F.pandas_udf("array<double>")
    def baseline(y: pd.Series, method: pd.Series, lam: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(y), dtype=object)
        for (m, v), rows in y.groupby([method, lam]).groups.items():
            at = [i for i in rows if y[i] is not None]
            for i, z in zip(at, K.baselines([np.asarray(y[i], float) for i in at], m, v), strict=True):
                out[i] = z
        return out

    @F.pandas_udf("array<double>")
    def smoothed(y: pd.Series, method: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else K.smooth(np.asarray(v, float), m) for v, m in zip(y, method, strict=True)], dtype=object)

    @F.pandas_udf("double")
    def simpson_area(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else float(K.simpson(np.asarray(b, float), np.asarray(a, float))) for a, b in zip(x, y, strict=True)], dtype="float64")

    def in_order(x: pd.Series, y: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        a, b = x.to_numpy(float), y.to_numpy(float)
        ok = ~(np.isnan(a) | np.isnan(b))
        order = np.argsort(a[ok], kind="stable")
        return a[ok][order], b[ok][order]

    @F.pandas_udf("double")
    def simpson(x: pd.Series, y: pd.Series) -> float:
        a, b = in_order(x, y)
        return float(K.simpson(b, a)) if len(a) > 1 else 0.0

    @F.pandas_udf("double")
    def noise_level(y: pd.Series) -> float:
        v = y.dropna().to_numpy(float)
        return float(1.4826 * np.median(np.abs(v - np.median(v)))) if len(v) else 0.0

    @F.pandas_udf("double")
    def asymmetry(x: pd.Series, y: pd.Series) -> float | None:
        """Back over front at a tenth of the height above the lowest value."""
        a, b = in_order(x, y)
        if len(b) < 3:
            return None
        high = np.nonzero(b - b.min() >= 0.1 * (b.max() - b.min()))[0]
        top = int(np.argmax(b))
        front = a[top] - a[high[0]]
        return float((a[high[-1]] - a[top]) / front) if front > 0 else None

    @F.udtf(returnType="sample_id string, peak_number int, retention_time double, area double, start_time double, end_time double")
    class RunPeaks:
        def __init__(self) -> None:
            self.x, self.y, self.sample, self.least, self.flat = [], [], None, 0.05, True

        def eval(self, row: Row, prominence: float, flat: bool = True) -> None:
            self.sample, self.least, self.flat = row["sample_id"], float(prominence), flat
            if row["x"] is not None:
                self.x.append(row["x"])
                self.y.append(np.nan if row["y"] is None else row["y"])

        def terminate(self) -> Iterator[tuple]:
            if self.x:
                for r in G.peaks_of(0, np.array(self.x), G.filled(np.array(self.y, float)), G.Method(min_prominence=self.least, flat_tops=self.flat)):
                    yield str(self.sample), r[2], r[3], r[6], r[7], r[8]

    @F.udtf(returnType="peak_number int, retention_time double, area double, start_time double, end_time double")
    class SignalPeaks:
        def eval(self, x: list, y: list, prominence: float) -> Iterator[tuple]:
            a, b = np.asarray(x, float), G.filled(np.asarray(y, float))
            for r in G.peaks_of(0, a, b, G.Method(min_prominence=prominence)):
                yield r[2], r[3], r[6], r[7], r[8]

    aggregates = (("simpson", simpson), ("noise_level", noise_level), ("asymmetry", asymmetry))
    for name, f in (("baseline", baseline), ("smoothed", smoothed), ("simpson_area", simpson_area), *aggregates):
        spark.udf.register(name, f)
        names.append(name)
    spark.udtf.register("signal_peaks", SignalPeaks)
    spark.udtf.register("run_peaks", RunPeaks)
    return [*names, "signal_peaks", "run_peaks"]
