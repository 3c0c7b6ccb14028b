"""Method files, libraries, containers, spectra of two-dimensional runs, writers and SQL functions, there and back."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from chromaflux import registry as R
from chromaflux.functions import scalars as S
from chromaflux.sources import methods as M
from chromaflux.sources import planes as P
from chromaflux.sources import sinks, tables

METHOD = {
    "name": "fame", "signal_type": "gc", "smoothing": {"enabled": True, "method": "median", "median_kernel": 7}, "baseline": {"enabled": True, "method": "asls", "lambda": 1e6},
    "peaks": {"enabled": True, "min_prominence": 0.1, "ranges": [[1.0, 2.0], [3.0, 4.0]]}, "rt_table": [{"compound": "a", "start": 1.0, "apex": 1.5, "end": 2.0}], "rf_unit": "area_per_mol", "area_factor": 2.0,
}


def written(tmp_path, name, value):
    at = tmp_path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(at)


def test_methods_there_and_back(spark, tmp_path):
    rows = M.methods(spark, written(tmp_path, "m.json", METHOD))
    m = M.method_of(rows.first())
    assert (m.smoothing, m.smoothing_options, m.baseline, m.lam, m.ranges, m.area_factor, m.shoulders) == ("median", {"kernel": 7}, "asls", 1e6, ((1.0, 2.0), (3.0, 4.0)), 2.0, False)
    M.write_methods(rows, str(tmp_path / "out"))
    again = spark.read.schema(M.DOCUMENT).json(str(tmp_path / "out"))
    assert again.first() == rows.first()
    assert [tuple(r) for r in M.rt_table_of(spark, rows.first()).collect()] == [(0, "a", 1.0, 1.5, 2.0)]
    record = json.loads(M.processing_record(rows).first().record)
    assert record["smoothing"]["median_kernel"] == 7 and "shoulders" not in record and "offset" not in record["baseline"]


@pytest.mark.parametrize("change,say", [({"rf_unit": "what"}, "unit"), ({"smoothing": {"median_kernel": 2}}, "kernel"), ({"rt_matching": {"mode": 3}}, "mode"), ({"bands": [{"name": "b", "x_min": 2.0, "x_max": 1.0}]}, "band"), ({"peaks": {"enabled": True}}, "prominence")])
def test_methods_that_break_a_rule(spark, tmp_path, change, say):
    with pytest.raises(ValueError, match=f"fame.*{say}"):
        M.methods(spark, written(tmp_path, "m.json", {**METHOD, **change}))


def test_parameters_by_other_names():
    assert M.merged({"a": 1, "b": 2}, {"b": 3, "a": None}) == {"a": 1, "b": 3}
    assert M.renamed({"lam": 1, "name": "x"}) == {"lambda": 1} and M.renamed({"lambda": 1}, True) == {"lam": 1}
    assert M.normalised({"prominence": 5, "ranges": None}) == {"min_prominence": 5, "ranges": [], "breaks": [], "peak_prominence": 5}
    with pytest.raises(TypeError):
        M.merged(None, {})


def test_spectral_library_and_its_cache(spark, tmp_path):
    path = written(tmp_path, "lib.json", {"a": {"casno": "1", "mw": 2.0, "mz": [1.0, 2.0], "intensity": [3.0, 4.0]}, "b": {"formula": "C", "mz": [5.0], "intensity": [6.0]}})
    lib = tables.spectral_library(spark, path, str(tmp_path / "none"))
    assert [(r.id, r.name, r.mz, r.intensity) for r in lib.orderBy("id", "mz").collect()] == [(0, "a", 1.0, 3.0), (0, "a", 2.0, 4.0), (1, "b", 5.0, 6.0)]
    lib.write.parquet(str(tmp_path / "cache"))
    assert tables.spectral_library(spark, "missing", str(tmp_path / "cache")).count() == 3


def test_batch_results_by_sample(spark, tmp_path):
    a = written(tmp_path, "a x.json", {"sample_id": "other", "peaks": [{"peak_number": 1, "area": 2.0}, {"peak_number": 2}]})
    b = written(tmp_path, "b.json", {"sample_id": "b"})
    got = tables.batch_results(spark, {"S1": a, "S2": b}).orderBy("sample_id", "peak_number").collect()
    assert [(r.sample_id, r.peak_number, r.area) for r in got] == [("S1", 1, 2.0), ("S1", 2, None), ("S2", None, None)]


def test_containers(spark, tmp_path):
    written(tmp_path, "one.C/manifest.json", {"signal_type": "gc", "sample_id": "s1", "csv_columns": {"x": "t"}})
    got = tables.containers(spark, str(tmp_path)).first()
    assert got.folder.endswith("one.C") and (got.signal_type, got.sample_id, got.notebook, got.csv_columns) == ("gc", "s1", "", {"x": "t"})
    written(tmp_path, "two.C/manifest.json", {"sample_id": "s2"})
    with pytest.raises(ValueError, match="signal type"):
        tables.containers(spark, str(tmp_path)).count()


def test_runs_and_files(spark):
    runs = spark.createDataFrame([("s", {"method": "m"}, {"method": "x", "timestamp": "t"}), ("u", None, None)], "sample_id string, detector_metadata map<string,string>, directory_metadata map<string,string>")
    assert [tuple(r) for r in tables.run_metadata(runs).orderBy("sample_id").collect()] == [("s", "t", "m", "s"), ("u", "", "Unknown", "u")]
    paths = spark.createDataFrame([("/d/b.D",), ("/d/a.D",), ("/e/c.D",)], "path string")
    assert [(r.path, r.place, r.siblings) for r in tables.siblings(paths).orderBy("path").collect()] == [("/d/a.D", 0, 2), ("/d/b.D", 1, 2), ("/e/c.D", 0, 1)]
    files = spark.createDataFrame([(f"/f/{n}",) for n in ("r1.rsd", "r1.dbc.lsc", "r1.hdr", "r2.rsd", "r2.lsc", "other.dbc.lsc")], "path string")
    assert [(r.stem, r.files) for r in tables.file_groups(files).collect()] == [("r1", ["/f/r1.dbc.lsc", "/f/r1.hdr", "/f/r1.rsd"])]
    samples = spark.createDataFrame([("s", "FID"), ("s", "TIC"), ("s", "X")], "sample_id string, channel string")
    named = runs.withColumn("name", F.lit(None).cast("string")).withColumn("path", F.lit("/d/run.D/"))
    assert {(r.channel, r.title) for r in tables.export_signals(samples, named, ["FID", "TIC"]).collect()} == {("FID", "run.D"), ("TIC", "run.D")}


def block(ions):
    body = bytes(12) + struct.pack("<I", len(ions)) + b"".join(struct.pack("<IId", mz, 0, v) for mz, v in ions)
    return b"SD04" + struct.pack("<I", len(body) + 8) + body


def test_spectra_of_two_dimensional_runs(spark, tmp_path):
    scans = [[(41_500, 2.0), (42_500, 3.0), (42_499, 1.0)], [], [(100_000, 5.0)]]
    (tmp_path / "r.lsc").write_bytes(b"header" * 9 + b"".join(map(block, scans)) + block([(1, 1.0)])[:-3])
    ions = P.plane_ions(spark, str(tmp_path))
    assert [(r.sample_id, r.scan, r.tic) for r in P.plane_tic(ions).orderBy("scan").collect()] == [("r", 0, 6.0), ("r", 1, 0.0), ("r", 2, 5.0)]
    asked = spark.createDataFrame([("r", 0), ("r", 1), ("r", 9)], "sample_id string, scan long")
    assert {(r.scan, r.mz): r.intensity for r in P.plane_spectrum(ions, asked).collect()} == {(0, 42): 6.0}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.lsc").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no spectrum block"):
        P.plane_ions(spark, str(tmp_path / "bad")).count()


def test_writers_there_and_back(spark, tmp_path):
    peaks = spark.createDataFrame([("s", 1, "a", 2.0), ("s", 2, None, 3.0)], "sample_id string, peak_number int, compound_id string, area double")
    manifest = spark.createDataFrame([("s", "gc"), ("t", "gc")], "sample_id string, signal_type string")
    sinks.container_results(peaks, manifest, str(tmp_path / "c"))
    assert sorted(len(r.features or []) for r in spark.read.json(str(tmp_path / "c/features.json")).collect()) == [0, 2] and spark.read.option("header", True).csv(str(tmp_path / "c/features.csv")).count() == 2
    rt = spark.createDataFrame([(0, "a", 1.0, 1.5, 2.0), (1, "b", 3.0, 3.1, 4.0)], "seq long, compound string, start double, apex double, end double")
    for as_json, read in ((False, tables.rt_table), (True, tables.rt_table_json)):
        sinks.rt_table(rt, str(tmp_path / f"rt{as_json}"), as_json)
        assert [tuple(r)[1:] for r in read(spark, str(tmp_path / f"rt{as_json}")).orderBy("start").collect()] == [tuple(r)[1:] for r in rt.collect()]
    entries = spark.createDataFrame([("/a", 0.5, 1.0, "x"), ("/b", -1.0, 2.0, "y")], "path string, offset_min double, timestamp double, source string")
    sinks.sidecar(entries, str(tmp_path / "off"), "path")
    assert {(r.path, r.offset_min) for r in spark.read.text(str(tmp_path / "off")).select(F.explode(F.from_json("value", "map<string,struct<offset_min:double>>")).alias("path", "v")).select("path", "v.*").collect()} == {("/a", 0.5), ("/b", -1.0)}
    for form in ("json", "csv", "parquet"):
        sinks.export(peaks, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.export(peaks, "x", "xls")
    lib = spark.createDataFrame([("a", "50-00-0", "g", None, None, 1, 2, 1, 0, 0, "b")], "compound string, cas string, group1 string, group2 string, group3 string, c int, h int, o int, s int, n int, anchor string")
    sinks.library_table(lib, str(tmp_path / "lib"))
    back = tables.compounds(spark, str(tmp_path / "lib")).first()
    assert (back.compound, back.c, back.anchor, back.mw) == ("a", 1, "b", pytest.approx(12.0107 + 2 * 1.0079 + 15.9994))
    wide = sinks.aligned(spark.createDataFrame([("s", 0, 1.0, "A", 5.0), ("s", 0, 1.0, "B", float("nan"))], "sample_id string, i int, x double, channel string, y double"), ["A", "B", "C"]).first()
    assert (wide.A, wide.B, wide.C) == (5.0, None, None)


def test_records_times_and_distances(spark):
    row = spark.createDataFrame([("a", 1, 2.5, None, 7.0), (None, 2, 3.5, "c", None)], "compound_id string, peak_number int, retention_time double, casno string, qual double")
    got = row.select("peak_number", S.peak_record(row.columns).alias("j")).withColumn("back", S.peak_from_record(F.col("j"), "compound_id string, peak_number int, retention_time double, casno string, qual double"))
    for r, was in zip(got.orderBy("peak_number").collect(), row.orderBy("peak_number").collect(), strict=True):
        assert r.back == was and ("casno" in json.loads(r.j)) == (was.casno is not None) and "compound_id" in json.loads(r.j)
    t = spark.createDataFrame([("2024-01-02T03:04:05",), ("soon",)], "t string").select(S.timestamp_formatted(F.col("t"), "yyyy/MM/dd HH:mm").alias("t"))
    assert [r.t for r in t.collect()] == ["2024/01/02 03:04", "soon"]
    assert spark.range(1).select(S.apex_distance(F.lit(3), F.lit(0.5))).first()[0] == 16


def test_profiles(spark, tmp_path):
    assert R.profile("ftir").inverted_x and set(R.profile("gcms").stages) == set(R.STAGES)
    with pytest.raises(ValueError, match="there already"):
        R.register_profile(R.profile("gc"))
    with pytest.raises(ValueError, match="stages"):
        R.register_profile(R.Profile("new", None, "", "", ("fly",)))
    with pytest.raises(ValueError, match="unknown signal"):
        R.profile("none")
    with pytest.raises(ValueError, match="reader"):
        R.load(spark, "x", "gcms")
    assert R.load(spark, "x", "gcms", lambda s, p: s.range(3)).count() == 3
    written(tmp_path, "a.csv", "t,y\n1,2\n3,4\n")
    assert R.load(spark, str(tmp_path / "a.csv"), "gc").count() == 2


def test_sql_functions(spark):
    names = R.register_sql(spark)
    assert {"molecular_weight", "baseline", "signal_peaks"} <= set(names)
    assert spark.sql("select molecular_weight(1, 2, 1, 0, null) as w, rf_composition(6D, 2D) as c, rf_composition(6D, 0D) as z").first() == (pytest.approx(30.0259, abs=1e-3), 3.0, 0.0)
    y = "array(1D, 1D, 9D, 1D, 1D, 1D, 1.2D, 1D)"
    x = "array(0D, 1D, 2D, 3D, 4D, 5D, 6D, 7D)"
    assert spark.sql(f"select size(baseline({y}, 'asls', 100D)) as n, simpson_area({x}, {y}) as a, smoothed({y}, 'median')[2] as s").first().n == 8
    assert spark.sql(f"select * from signal_peaks({x}, {y}, 0.5D)").first().retention_time == 2.0
