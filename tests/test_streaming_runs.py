"""Runs that arrive, restarts, failures of single runs, cancelling, and peaks closed online."""

import random
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle

from chromaflux.operators import batch as B
from chromaflux.operators import signal as G
from chromaflux.streaming import online, runs

X = np.linspace(0, 10, 300)
METHOD = G.Method(baseline=None, min_prominence=0.2)


def put(folder, name, centre=3.0, bad=False):
    y = 40 * np.exp(-((X - centre) ** 2) / 0.02) + 20 * np.exp(-((X - centre - 3) ** 2) / 0.02)
    lines = [f"{a},{b}" for a, b in zip(X, y, strict=True)]
    if bad:
        lines[7] = "1,oops"
    (folder / f"{name}.csv").write_text("\n".join(["x,y", *lines]))


def test_each_run_once_whatever_happens(spark, tmp_path, monkeypatch):
    folder, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    folder.mkdir()
    for i in range(4):
        put(folder, f"run{i}", 2 + i, bad=i == 2)
    start = lambda: runs.run_each(spark, f"file://{folder}", out, mark, METHOD, per_batch=2)
    # the first start breaks off after the second batch's peaks are written, before it is done
    real, seen = G.run_isolated, []

    def breaking(*a):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("power cut")
        return real(*a)

    monkeypatch.setattr(G, "run_isolated", breaking)
    with pytest.raises(Exception, match="power cut"):
        start().awaitTermination()
    assert {r.batch for r in runs.results(spark, out).select("batch").distinct().collect()} <= {0}
    monkeypatch.setattr(G, "run_isolated", real)
    start().awaitTermination()
    put(folder, "run9", 5)
    put(folder, "run0", 7)  # the same path again is no new run
    start().awaitTermination()
    start().awaitTermination()
    got = sorted((r.sample_id, r.peak_number, round(r.retention_time, 1)) for r in runs.results(spark, out).collect())
    assert got == [(f"run{i}", k, round(X[np.argmin(abs(X - c - 3 * (k - 1)))], 1)) for i, c in ((0, 2), (1, 3), (3, 5), (9, 5)) for k in (1, 2)]
    assert [(r.sample_id, r.error) for r in runs.results(spark, out, "failures").collect()] == [("run2", "no two numbers in line 8")]


def test_a_run_that_raises_holds_up_no_other(spark, monkeypatch):
    rows = [(k, i, float(a), float(40 * np.exp(-((a - 3) ** 2) / 0.02))) for k in ("good", "poisoned", "fine") for i, a in enumerate(X)]
    samples = spark.createDataFrame(rows, "sample_id string, seq long, x double, y double")
    peaks, failed = G.run_isolated(samples, G.Method(ms_range=(9.0, 1.0)))  # a method that no signal can take
    assert peaks.count() == 0 and {tuple(r) for r in failed.collect()} == {(k, "ValueError: range is reversed") for k in ("good", "poisoned", "fine")}
    real = G.peaks_of

    def poisoned(sample_id, *a):
        if sample_id == "poisoned":
            raise ZeroDivisionError("bad vial")
        return real(sample_id, *a)

    monkeypatch.setattr(G, "peaks_of", poisoned)
    cloudpickle.register_pickle_by_value(G)  # so that tasks get the patched one
    try:
        peaks, failed = G.run_isolated(samples, METHOD)
        assert sorted(r.sample_id for r in peaks.collect()) == ["fine", "good"]
        assert [tuple(r) for r in failed.collect()] == [("poisoned", "ZeroDivisionError: bad vial")]
        with pytest.raises(Exception, match="bad vial"):
            G.run(samples, METHOD).count()
    finally:
        cloudpickle.unregister_pickle_by_value(G)


def test_tagged_jobs_are_cancelled(spark):
    ended = []

    def slow():
        with B.tagged(spark, "slow-batch"):
            try:
                spark.range(4).mapInPandas(lambda it: (time.sleep(60) or p for p in it), "id long").count()
            except Exception as e:  # noqa: BLE001
                ended.append(str(e))

    thread = threading.Thread(target=slow)
    began = time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 50:
        time.sleep(1)
        B.cancel(spark, "slow-batch")
    thread.join(20)
    assert not thread.is_alive() and ended and time.time() - began < 55


def series(seed, samples=5, n=240):
    r = random.Random(seed)
    base = datetime(2024, 5, 1)
    rows = []
    for s in range(samples):
        for i in range(n):
            y = float(max(0.0, 10 * np.sin(i / 9 + s) + r.uniform(-3, 3))) if i % 37 else None
            rows.append((s, base + timedelta(seconds=10 * i, milliseconds=r.randrange(900)), y))
    return rows


SCHEMA = "sample_id long, time timestamp, y double"


def plain_peaks(rows, level):
    out = []
    for s in sorted({r[0] for r in rows}):
        run = []
        for _, t, y in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if y is not None and y > level:
                run.append((t, y))
            elif run:
                area = sum((b[0] - a[0]).total_seconds() / 60 * (a[1] + b[1]) / 2 for a, b in zip(run, run[1:], strict=False))
                top = max(run, key=lambda p: p[1])
                out.append((s, run[0][0], run[-1][0], top[0], top[1], area, len(run)))
                run = []
    return out


def rounded(rows):
    return sorted((r[0], r[1], r[2], r[3], round(r[4], 9), round(r[5], 9), r[6]) for r in rows)


def test_closed_peaks_by_plain_loop(spark):
    rows = series(1)
    got = online.closed_peaks(spark.createDataFrame(rows, SCHEMA), 4.0)
    assert rounded(tuple(r) for r in got.select("sample_id", "start", "end", "apex", "height", "area", "samples").collect()) == rounded(plain_peaks(rows, 4.0))


def test_online_peaks_are_those_of_the_batch(spark, tmp_path):
    online.with_state(spark)
    rows = series(2)
    r = random.Random(4)
    # a sample comes up to two minutes late, in files of a hundred or so; a far sample of its own moves the watermark past all
    order = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.uniform(0, 120)))
    parts = [order[i : i + 150] for i in range(0, len(order), 150)] + [[(99, datetime(2024, 5, 2), 0.0)], [(99, datetime(2024, 5, 3), 0.0)]]
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    # a restart between files goes on with the open peaks
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{source}/part={i:03}")
        if i % 4 == 3 or i == len(parts) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
            q = online.online_peaks(stream, 4.0, "3 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
            q.awaitTermination()
    got = spark.read.parquet(out).select("sample_id", "start", "end", "apex", "height", "area", "samples").collect()
    assert rounded(tuple(x) for x in got) == rounded(plain_peaks(rows, 4.0)) and len(got) > 20


def test_progress_of_streams(spark, tmp_path):
    seen = runs.Progress()
    spark.streams.addListener(seen)
    try:
        (tmp_path / "in").mkdir()
        for i in range(2):
            put(tmp_path / "in", f"r{i}")
        lines = runs.arriving_runs(spark, f"file://{tmp_path}/in", per_batch=1)
        lines.writeStream.queryName("watch").foreachBatch(lambda df, k: df.count()).option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        end = time.time() + 20
        while "watch" not in seen.ended and time.time() < end:
            time.sleep(0.2)
        assert seen.batches["watch"] == 2 and seen.rows["watch"] == 2 and seen.ended["watch"] is None and "watch" in seen.last
    finally:
        spark.streams.removeListener(seen)


def test_online_peaks_of_many_samples_share_states(spark, tmp_path):
    online.with_state(spark)
    begin = datetime(2024, 5, 1)
    rows = [(i, begin + timedelta(minutes=k), y) for i in range(3000) for k, y in enumerate((1.0, 9.0, 1.0))] + [(-1, begin + timedelta(days=1), 0.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/in")
    q = online.online_peaks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 4.0, "3 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    timers = sum(o.customMetrics["numRegisteredTimers"] for p in q.recentProgress for o in p.stateOperators)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000 and 0 < timers <= 2 * online.GROUPS
