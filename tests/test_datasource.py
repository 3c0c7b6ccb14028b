"""The data source over files of each kind, what filters open, and functions of groups and tables in SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_readers_to_peaks import METHOD, X, Y, block

from chromaflux import registry
from chromaflux.operators import kernels as K
from chromaflux.operators import signal as G
from chromaflux.sources import datasource


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    datasource.register(spark)


def lines(*columns):
    return "\n".join(",".join(str(v) for v in row) for row in zip(*columns, strict=True))


def folder(tmp_path, kind):
    for k, name in enumerate(("a", "b")):
        y = Y + k
        if kind == "gcxgc":
            (tmp_path / f"run-{name}.bin").write_bytes(block(y))
        elif kind == "uvvis":
            (tmp_path / f"run-{name}.csv").write_text("ms,10,20\navg,1,1\nl,a,b\nn,1,2\nt,x,y\n" + lines(X, y, 2 * y))
        elif kind == "container":
            data = tmp_path / f"run-{name}.C" / "data"
            data.mkdir(parents=True)
            (data.parent / "manifest.json").write_text(json.dumps({"signal_type": "gc", "csv_columns": {"x": "t", "y": "v"}}))
            (data / "signal.csv").write_text("extra,v,t\n" + lines(["no number"] * len(X), y, X))
        else:
            (tmp_path / f"run-{name}.csv").write_text(("time,signal\n" if kind == "gc" else "") + lines(X, y))
    return f"file://{tmp_path}"


@pytest.mark.parametrize("kind", list(datasource.KINDS))
def test_every_kind_from_folder_to_peaks(spark, tmp_path, kind):
    path = folder(tmp_path, kind)
    df = spark.read.format("chromaflux").option("kind", kind).load(path)
    assert df.schema.simpleString() == "struct<" + datasource.SCHEMA.replace(" ", ":").replace(",:", ",").replace("long", "bigint") + ">"
    got = df.filter("channel not in ('2')").toPandas().sort_values(["sample_id", "seq"])
    assert sorted(set(got["sample_id"])) == ["run-a", "run-b"] and len(got) == 800
    own = got[got["sample_id"] == "run-a"]
    shift = 34_998 if kind == "gcxgc" else 0
    assert own["y"].to_numpy() == pytest.approx(Y + shift) and own["x"].to_numpy() == pytest.approx(np.arange(400.0) if kind == "gcxgc" else X)
    assert df.rdd.getNumPartitions() == 2  # one a run
    peaks = G.run(df.filter("channel not in ('2')"), METHOD)
    assert {(r.sample_id, r.n) for r in peaks.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {("run-a", 2), ("run-b", 2)}


def test_a_filter_on_a_run_opens_one_file(spark, tmp_path):
    path = folder(tmp_path, "gc")
    (tmp_path / "run-c.csv").write_text("time,signal\n1,not a number\n")
    df = spark.read.format("chromaflux").load(path)
    with pytest.raises(Exception, match="not a number"):
        df.count()
    for chosen, n in (("sample_id = 'run-a'", 1), ("sample_id in ('run-a', 'run-b')", 2), ("sample_id <=> 'run-b' and y > 3", 1), ("sample_id like 'run-a%'", 1)):
        held = df.filter(chosen)
        assert held.rdd.getNumPartitions() == n and held.count() > 0
    assert df.filter("sample_id = 'run-z'").count() == 0 and df.filter("channel = 'other'").count() == 0
    assert df.filter("sample_id = 'run-a' and seq < 10 and y is not null").count() == 10
    assert spark.read.format("chromaflux").option("channel", "fid1").load(path).filter("channel = 'fid1' and sample_id = 'run-b'").select("channel").distinct().first()[0] == "fid1"


def test_spectra_that_are_not_asked_are_not_read(spark, tmp_path):
    path = folder(tmp_path, "uvvis")
    (tmp_path / "run-a.csv").write_text("ms,10,20\navg,1,1\nl,a,b\nn,1,2\nt,x,y\n" + lines(X, Y, ["spoilt"] * len(X)))
    df = spark.read.format("chromaflux").option("kind", "uvvis").load(path)
    assert df.filter("channel = '1'").count() == 800
    with pytest.raises(Exception, match="spoilt"):
        df.filter("channel = '2'").count()


def test_columns_and_mistakes(spark, tmp_path):
    path = folder(tmp_path, "gc")
    read = lambda **o: spark.read.format("chromaflux").options(**o)
    narrow = read().schema("y double, sample_id string").load(path)
    assert narrow.columns == ["y", "sample_id"] and narrow.agg(F.sum("y")).first()[0] == pytest.approx((2 * Y + 1).sum())
    swapped = read(x="signal", y="time").load(f"{path}/run-a.csv")
    assert [r.y for r in swapped.orderBy("seq").limit(3).collect()] == pytest.approx(X[:3].tolist())
    for options, message in (({"x": "none"}, "none"), ({"kind": "xls"}, "unknown kind"), ({"y": "7"}, "7")):
        with pytest.raises(Exception, match=message):
            read(**options).load(path).count()
    with pytest.raises(Exception, match="no columns"):
        read().schema("z double").load(path).count()
    with pytest.raises(Exception, match="none-there"):
        read().load(f"{path}/none-there").count()
    bare = tmp_path / "bare.C"
    bare.mkdir()
    (bare / "manifest.json").write_text("{}")
    with pytest.raises(Exception, match="signal type"):
        read(kind="container").load(f"file://{bare}").count()


def test_aggregates_and_table_functions_in_sql(spark):
    registry.register_sql(spark)
    rows = [(s, i, float(x), float(y) * (1 + s)) for s in range(3) for i, (x, y) in enumerate(zip(X, Y, strict=True))] + [(3, 0, 1.0, 1.0), (3, 1, None, 2.0), (4, 0, 1.0, None)]
    df = spark.createDataFrame(rows, "sample_id long, seq int, x double, y double").repartition(5)
    df.createOrReplaceTempView("samples_of_test")
    got = {r.sample_id: r for r in spark.sql("SELECT sample_id, simpson(x, y) AS area, noise_level(y) AS noise, asymmetry(x, y) AS skew FROM samples_of_test GROUP BY sample_id").collect()}
    for s in range(3):
        y = Y * (1 + s)
        assert got[s].area == pytest.approx(K.simpson(y, X)) and got[s].noise == pytest.approx(1.4826 * np.median(abs(y - np.median(y))))
    assert (got[3].area, got[4].area, got[4].noise, got[3].skew) == (0.0, 0.0, 0.0, None)
    query = "SELECT * FROM run_peaks(TABLE(samples_of_test) PARTITION BY (sample_id) ORDER BY (x), 0.2)"
    found = sorted((int(r.sample_id), r.peak_number, r.retention_time, r.area) for r in spark.sql(query).collect() if int(r.sample_id) < 3)
    want = [(s, p[2], p[3], p[6]) for s in range(3) for p in G.peaks_of(s, X, Y * (1 + s), G.Method(min_prominence=0.2))]
    assert [f[:2] for f in found] == [w[:2] for w in want] and [v for f in found for v in f[2:]] == pytest.approx([v for w in want for v in w[2:]])
    plan = spark.sql(query)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(" in plan
