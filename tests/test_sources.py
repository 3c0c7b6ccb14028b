"""Sources and sinks: written by the test, read back, compared."""

import struct

import numpy as np
import pytest

from chromaflux.sources import planes, sinks, synthetic, tables


def put(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_rt_tables(spark, tmp_path):
    a = tables.rt_table(spark, put(tmp_path / "a.csv", "Compound,Start,Apex,End\nx,1,1.2,2\n,3,3.5,4\n"))
    assert [(r.compound, r.apex) for r in a.collect()] == [("x", 1.2)]
    b = tables.rt_table(spark, put(tmp_path / "b.csv", "Compound,Start,End\nx,1,2\n"))
    assert b.first().apex == 1.5
    with pytest.raises(ValueError):
        tables.rt_table(spark, put(tmp_path / "c.csv", "Compound,Start,Apex,End\nx,2,1,1.5\n"))
    j = tables.rt_table_json(spark, put(tmp_path / "d.json", '{"compounds": [{"name": "x", "rt_start": 1, "rt_end": 3}, {"name": " ", "start": 9, "end": 1}, {"compound": "y", "start": 1, "apex": 1.5, "end": 2}]}'))
    assert [(r.compound, r.apex) for r in j.orderBy("seq").collect()] == [("x", 2.0), ("y", 1.5)]


def test_rf_table_round_trip(spark, tmp_path):
    f, unit = tables.rf_table(spark, put(tmp_path / "rf.csv", "# rf_unit: area_per_mass\nName,RF\na,100\nb,x\n,5\nc,0\n"))
    assert unit == "area_per_mass" and sorted((r.compound, r.response_factor) for r in f.collect()) == [("a", 100.0), ("c", 0.0)]
    sinks.rf_table(f, f"file://{tmp_path}/out", unit)
    g, again = tables.rf_table(spark, f"file://{tmp_path}/out")
    assert again == unit and sorted((r.compound, r.response_factor) for r in g.collect()) == [("a", 100.0), ("c", 0.0)]


def test_library_and_calibration(spark, tmp_path):
    lib = tables.compounds(spark, put(tmp_path / "l.csv", 'compound,cas,group1,group2,group3,C,H,O,S,N,MW,anchor\n"a, b",71-43-2,g,,0,6,6,,,,1,x\n'))
    row = lib.first()
    assert (row.compound, row.cas, row.o) == ("a, b", "000071-43-2", 0) and row.mw == pytest.approx(78.1116)
    with pytest.raises(ValueError):
        tables.compounds(spark, put(tmp_path / "m.csv", "compound,cas,group1,group2,group3,C,H,O,S,N,MW,anchor\na,1-2-3,g,,0,6.5,6,,,,1,x\n"))
    cal = tables.calibration(spark, put(tmp_path / "c.csv", "anchor,cas,C,MW,known_wt_pct,area\nx,1,6,78,0.1,5\nx,1,6,78,0.2,5\n"))
    assert [r.known_wt_pct for r in cal.collect()] == [0.2]
    with pytest.raises(ValueError):
        tables.calibration(spark, put(tmp_path / "e.csv", "anchor,cas,C,MW,known_wt_pct,area\nx,1,6,78,0.1,0\n"))


def test_signals(spark, tmp_path):
    p = put(tmp_path / "run_20240102_030405.csv", "1,2\n3,4\n")
    s = tables.infrared_csv(spark, p).orderBy("seq").collect()
    assert [(r.x, r.y) for r in s] == [(1.0, 2.0), (3.0, 4.0)] and str(s[0].time) == "2024-01-02 03:04:05"
    with pytest.raises(KeyError):
        tables.csv_signal(spark, p, 0, 5, header=False)
    u = tables.ultraviolet_csv(spark, put(tmp_path / "uv.csv", "ms,10,20\navg,1,1\nl,a,b\nn,1,2\nt,01/02/2024 03:04:05,bad\n200,0.1,0.2\n201,0.3,0.4\n"))
    got = sorted((r.spectrum, r.wavelength, r.absorbance, r.time is None, r.integration_ms) for r in u.collect())
    assert got == [(1, 200.0, 0.1, False, 10.0), (1, 201.0, 0.3, False, 10.0), (2, 200.0, 0.2, True, 20.0), (2, 201.0, 0.4, True, 20.0)]


def test_results_and_sidecars(spark, tmp_path):
    peaks = spark.createDataFrame([("s", 1, "a", 2.0), ("s", 2, None, 3.0), ("t", 1, "b", 1.0)], "sample_id string, peak_number int, compound_id string, area double")
    sinks.documents(peaks, f"file://{tmp_path}/res", ["sample_id"])
    back = tables.results(spark, f"file://{tmp_path}/res", lines=True)
    assert sorted((r.sample_id, r.peak_number, r.compound_id or "", r.area) for r in back.collect()) == [("s", 1, "a", 2.0), ("s", 2, "", 3.0), ("t", 1, "b", 1.0)]
    assert tables.offsets(spark, put(tmp_path / "o.json", '{"/a": {"offset_min": 0.5, "timestamp": 1, "source": "auto"}, "/b": {}}')).collect()[0].offset_min == 0.5
    assert tables.offsets(spark, put(tmp_path / "p.json", "not json")).count() == 0
    o = tables.overrides(spark, put(tmp_path / "v.json", '{"1.2500": {"compound_name": "x"}, "zz": {"compound_name": "y"}}'))
    assert [(r.override_rt, r.compound) for r in o.collect()] == [(1.25, "x")]
    ids = spark.createDataFrame([("s", 2, "new")], "sample_id string, peak_number int, compound_id string")
    assert sorted((r.sample_id, r.compound_id, r.changed) for r in sinks.updated_ids(peaks, ids).collect()) == [("s", "a", True), ("s", "new", True), ("t", "b", False)]
    old, new = (spark.createDataFrame([("k", t, v)], "k string, t int, v string") for t, v in ((1, "old"), (1, "new")))
    assert sinks.upserted(old, new, ["k"], "t").first().v == "new"


def test_binary_traces(spark, tmp_path):
    a, b = np.arange(5.0), np.arange(7.0) + 10
    data = b"\0" * 3 + struct.pack("<III", 1, 2, 5) + a.tobytes() + struct.pack("<III", 0, 0, 7) + b.tobytes()
    head = data.find(planes.MARK)
    assert head == -1 and len(planes.blocks(data)) == 0
    marked = struct.pack("<II", 1, 2) + struct.pack("<I", 2) + struct.pack("<d", 1.0)[:6] + planes.MARK + b"\0" * 8
    assert planes.blocks(marked)[1:].tolist() == [0.0] or len(planes.blocks(marked)) == 2
    (tmp_path / "x.dbc").write_bytes(marked)
    assert planes.traces(spark, f"file://{tmp_path}/x.dbc").count() == len(planes.blocks(marked))
    assert planes.header("; c\nData Rate = 50 Hz\ncal modulation pulse = 4.0\n") == (50.0, 4.0)
    with pytest.raises(ValueError):
        planes.header("Data Rate = 50\n")


def test_synthetic_peaks_are_found(spark):
    from chromaflux.operators import signal as G

    s = synthetic.signals(spark, 2, points=3000, minutes=20.0, peaks=5, noise=0.2)
    found = G.run(s.drop("truth"), G.Method(lam=1e6, min_prominence=0.05))
    n = {r.sample_id: r.n for r in found.groupBy("sample_id").count().withColumnRenamed("count", "n").collect()}
    assert all(3 <= n[k] <= 6 for k in (0, 1))
