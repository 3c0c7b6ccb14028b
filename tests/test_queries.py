"""Every query with SQL against DuckDB on the smallest tables, and the shape of the others."""

import math

import pytest

from chromaflux.plans import queries as relational
from chromaflux.plans import queries_more, queries_spectra  # noqa: F401
from chromaflux.plans import signal_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v) if isinstance(v, str) else "", 0 if v is None or isinstance(v, str) else v) for v in r))


@pytest.mark.parametrize("name", [*relational.SQL, *signal_queries.SQL])
def test_against_sql(spark, duck, name):
    df = {**relational.QUERIES, **signal_queries.QUERIES}[name](spark, SF)
    names = sorted(df.columns)
    got = duck.execute({**relational.SQL, **signal_queries.SQL}[name])
    there = [c[0] for c in got.description]
    assert sorted(there) == names
    want = [tuple(plain(r[there.index(c)]) for c in names) for r in got.fetchall()]
    assert ordered([tuple(plain(r[c]) for c in names) for r in df.collect()]) == ordered(want)


@pytest.mark.parametrize("name", [n for n in {**relational.QUERIES, **signal_queries.QUERIES} if n not in {**relational.SQL, **signal_queries.SQL}])
def test_queries_without_sql_run(spark, name):
    assert {**relational.QUERIES, **signal_queries.QUERIES}[name](spark, SF).count() > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """The smallest tables with events of whole values, so that many tops are flat."""
    import duckdb

    to = tmp_path_factory.mktemp("flat")
    c = duckdb.connect()
    c.execute(f"copy (select * replace (least(round(value / 12) * 12, 60.0) as value) from '{SF}/events.parquet') to '{to}/events.parquet'")
    c.execute(f"create view events as select * from '{to}/events.parquet'")
    return str(to), c


@pytest.mark.parametrize("name", ["component_filter", "merged_components", "sql_run_peaks", "fit_groups", "greedy_assign", "raw_peaks", "raw_areas"])
def test_flat_tops_as_in_sql(spark, flat, name):
    d, c = flat
    got = c.execute({**relational.SQL, **signal_queries.SQL}[name])
    there = [x[0] for x in got.description]
    want = [tuple(plain(v) for v in r) for r in got.fetchall()]
    df = {**relational.QUERIES, **signal_queries.QUERIES}[name](spark, d)
    assert ordered([tuple(plain(r[x]) for x in there) for r in df.collect()]) == ordered(want)


@pytest.mark.parametrize("name", ["nearest_scan", "direct_spectrum", "peak_quality", "axis_union", "gap_windows", "nan_fill", "inflection_bounds", "dbscan_1d"])
def test_no_frame_is_gone_through_anew_for_every_row(spark, name):
    plan = relational.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "").replace("unboundedpreceding, unboundedfollowing", "")


def test_peaks_over_the_same_scans_are_compared_once(spark, monkeypatch):
    from chromaflux.operators import extract as E
    from chromaflux.plans.queries_spectra import scans

    s = scans(spark, SF)
    one = spark.createDataFrame([(k % 3, k, 5.0 + k % 3 * 0.3, 1.0, 9.0) for k in range(60)], "sample_id long, peak long, rt double, start double, end double")
    asked = []
    real = E.W.top
    monkeypatch.setattr(E.W, "top", lambda rows, *a: asked.append(rows.select("sample_id", "peak").distinct().count()) or real(rows, *a))
    got = E.peak_quality(one, s).collect()
    assert asked[0] <= 3 and len(got) == 60
    for k in range(3):
        assert len({(r.coherence, r.coherent, r.is_convoluted) for r in got if r.sample_id == k}) == 1


@pytest.mark.parametrize("name", ["key_set_check", "group_rollup"])
def test_sums_and_keys_stay_in_many_tasks(spark, name):
    plan = relational.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # a number of parts that Spark does not bring down
