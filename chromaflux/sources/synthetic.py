"""Signals with known peaks, made by Spark: for tests and for load at any scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import kernels as K


def signals(spark: SparkSession, runs: int, points: int = 10_000, minutes: float = 60.0, peaks: int = 15, noise: float = 1.0, seed: int = 7, parts: int | None = None) -> DataFrame:
    """sample_id, seq, x, y, truth: exponentially modified peaks on a drifting baseline with white noise and a random walk."""

    def make(frames):
        for frame in frames:
            for i in frame["id"]:
                r = np.random.default_rng([seed, int(i)])
                x = np.linspace(0, minutes, points)
                y = 20 + 5 * np.sin(x / minutes * np.pi) + r.normal(0, noise, points) + np.cumsum(r.normal(0, noise / 50, points))
                truth = np.zeros(points)
                for mu in np.sort(r.uniform(0.05, 0.95, peaks)) * minutes:
                    truth += K.emg(x, r.uniform(50, 500), mu, r.uniform(0.03, 0.1), r.uniform(0.01, 0.1))
                yield pd.DataFrame({"sample_id": int(i), "seq": np.arange(points), "x": x, "y": y + truth, "truth": truth})

    return spark.range(runs).repartition(parts or max(1, min(runs, 200))).mapInPandas(make, "sample_id long, seq long, x double, y double, truth double")
