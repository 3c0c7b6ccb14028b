"""Each kind of signal from file to peaks, identifiers of any type, and wide tables."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaflux import registry
from chromaflux.operators import aggregates as A
from chromaflux.operators import extract as E
from chromaflux.operators import signal as G
from chromaflux.operators import spectra as M
from chromaflux.operators import windows as W

X = np.linspace(0, 10, 400)
Y = 50 * np.exp(-((X - 3) ** 2) / 0.02) + 30 * np.exp(-((X - 7) ** 2) / 0.03) + 2
METHOD = G.Method(baseline=None, min_prominence=0.2)


def block(y):
    """A trace file: blocks of (two integers, a count, doubles); the first value near 35,000 has the mark in its last bytes."""
    return b"".join(struct.pack("<iiI", 0, 0, len(p)) + np.asarray(p, "<f8").tobytes() for p in np.array_split(y + 34_998, 3))


def write(tmp_path, kind):
    if kind == "gcxgc":
        (tmp_path / "run-a.bin").write_bytes(block(Y))
        return f"file://{tmp_path}/run-a.bin", np.arange(400.0)
    if kind == "uvvis":
        head = "ms,10,20\navg,1,1\nl,a,b\nn,1,2\nt,01/02/2024 03:04:05,bad\n"
        (tmp_path / "run-a.csv").write_text(head + "\n".join(f"{x},{y},{y}" for x, y in zip(X, Y, strict=True)))
        return f"file://{tmp_path}/run-a.csv", X
    lines = [f"{x},{y}" for x, y in zip(X, Y, strict=True)]
    (tmp_path / "run-a.csv").write_text("\n".join(lines if kind == "ftir" else ["time,signal", *lines]))
    return f"file://{tmp_path}/run-a.csv", X


@pytest.mark.parametrize("kind", ["gc", "ftir", "uvvis", "gcxgc"])
def test_from_file_to_peaks(spark, tmp_path, kind):
    path, x = write(tmp_path, kind)
    samples = registry.load(spark, path, kind)
    peaks = G.run(samples, METHOD).orderBy("sample_id", "peak_number").collect()
    runs = {"uvvis": ["run-a#1", "run-a#2"]}.get(kind, ["run-a"])
    assert [(p.sample_id, p.peak_number) for p in peaks] == [(r, k) for r in runs for k in (1, 2)]
    assert [round(p.retention_time, 6) for p in peaks] == [round(x[np.argmin(abs(X - c))], 6) for _ in runs for c in (3, 7)]
    processed = G.processed(samples, G.Method(lam=1e4))
    assert {r.sample_id for r in G.integrated(processed, METHOD).collect()} == {r.sample_id for r in G.detect(processed, METHOD).collect()} == set(runs)
    assert {r.sample_id for r in G.chunked(samples).collect()} == {r.sample_id for r in G.split_geometric(samples).collect()} == set(runs)


def test_places_of_a_wide_table(spark):
    rows = spark.range(300_000).select(F.expr("(id * 7919) % 300007").alias("k"), F.col("id"), F.repeat(F.lit("x"), 50).alias("wide"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        got = W.placed(rows, F.col("k").desc())
        facts = got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place"), F.countDistinct("id")).first()
        assert tuple(facts) == (300_000, 300_000, 1, 300_000, 300_000)
        pairs = got.select("place", "k")
        assert pairs.join(pairs.select((F.col("place") - 1).alias("place"), F.col("k").alias("n")), "place").filter("n >= k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_equal_peaks_are_two_members(spark):
    peaks = spark.createDataFrame([(1, 6.0, 10.0), (1, 6.0, 10.0), (1, 30.0, 5.0), (1, 30.0, 5.0)], "sample_id int, rt double, area double")
    few = spark.createDataFrame([(0, 5.0, 12.0), (1, 5.5, 20.0)], "seq int, g_low double, g_high double")
    many = few.unionByName(spark.range(2, 1500).select(F.col("id").cast("int").alias("seq"), (F.col("id") + 1000.0).alias("g_low"), (F.col("id") + 1001.0).alias("g_high")))
    for groups in (few, many):
        got = sorted((r.rt, r.area, r.members, r.compound_id, r.number) for r in A.peak_groups(peaks, groups, ["sample_id"]).collect())
        assert got == [(5.0, 20.0, 2, "Group", 1), (30.0, 5.0, 1, "peak", 2), (30.0, 5.0, 1, "peak", 3)]


@pytest.mark.parametrize("names", [(0, 1), ("run-a", "run-b")])
def test_ion_baselines_keep_runs_and_masses_apart(spark, names):
    x = np.arange(30)
    rows = [(run, int(i), mz, float(500 + i * (k + 1) + 900 * np.exp(-((i - 10 - k) ** 2) / 8))) for k, (run, mz) in enumerate([(names[0], 100000.0), (names[1], 1.0), (names[1], 57.5)]) for i in x]
    scans = spark.createDataFrame(rows, f"sample_id {'long' if names[0] == 0 else 'string'}, scan int, mz double, intensity double")
    got = E.ion_baselines(scans, lam=1e3)
    assert [t for _, t in got.dtypes] == [dict(scans.dtypes)[c] for c in got.columns]
    per = {(r.sample_id, r.mz): r.n for r in got.groupBy("sample_id", "mz").agg(F.count("*").alias("n")).collect()}
    assert per == {(names[0], 100000.0): 30, (names[1], 1.0): 30, (names[1], 57.5): 30}
    alone = E.ion_baselines(scans.filter("mz = 57.5"), lam=1e3)
    want = {(r.scan): r.intensity for r in alone.collect()}
    assert {r.scan: pytest.approx(r.intensity) for r in got.filter("mz = 57.5").collect()} == want


def test_deconvolution_of_named_runs_and_fractional_masses(spark):
    rows = [("run-a", i, i / 100, mz, float(5000 * w * np.exp(-((i - c) ** 2) / 18) + 1)) for mz, c, w in ((57.5, 20, 1), (71.25, 20, 0.6), (43.0, 40, 1), (99.0, 40, 0.5)) for i in range(60)]
    scans = spark.createDataFrame(rows, "sample_id string, scan int, rt double, mz double, intensity double")
    found = M.deconvolved(M.ion_peaks(scans), eps=0.02, min_sharpness=1.0).collect()
    assert {(r.sample_id, r.component, r.mz) for r in found} == {("run-a", 0, 57.5), ("run-a", 0, 71.25), ("run-a", 1, 43.0), ("run-a", 1, 99.0)}
