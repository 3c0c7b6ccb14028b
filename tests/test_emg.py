"""Joint fits of overlapping curves, and chunks that cut through a peak."""

import numpy as np
import pytest

from chromaflux.operators import emg
from chromaflux.operators import kernels as K
from chromaflux.operators import windows as W

X = np.linspace(0, 8, 800)
CURVES = {
    "a": [(10, 1.5, 0.1, 0.05), (6, 1.9, 0.12, 0.08), (4, 5.0, 0.15, 0.1)],
    "b": [(10, 1.5, 0.1, 0.05), (9, 1.8, 0.1, 0.05), (8, 2.1, 0.1, 0.05), (7, 2.4, 0.1, 0.05), (6, 2.7, 0.1, 0.05), (5, 6.0, 0.2, 0.3)],
    "c": [(3, 4.0, 0.2, 0.1)],
}


def signal(curves):
    return sum(K.emg(X, *c) for c in curves)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, i, float(x), float(y)) for k, c in CURVES.items() for i, (x, y) in enumerate(zip(X, signal(c), strict=True))]
    return spark.createDataFrame(rows, "sample_id string, seq long, x double, y double").cache()


def apexes(spark, at=None):
    rows = [(k, int(i), float(signal(c)[i])) for k, c in CURVES.items() for i in (at or {}).get(k, K.find_peaks(signal(c), prominence=1e-3))]
    return spark.createDataFrame(rows, "sample_id string, seq long, y double")


def assert_planted(found, names, tolerance=0.01):
    got = {}
    for r in found:
        got.setdefault(r.sample_id, []).append((r.area, r.rt, r.sigma, r.tau))
    for k in names:
        assert len(got[k]) == len(CURVES[k])
        for have, want in zip(sorted(got[k], key=lambda c: c[1]), CURVES[k], strict=True):
            assert have == pytest.approx(want, rel=tolerance)


def test_planted_curves_come_back(spark, samples):
    found = emg.fitted(samples, apexes(spark), ["sample_id"], emg.Fit(most=5)).collect()
    assert_planted(found, "abc")
    assert all(r.r2 > 1 - 1e-6 and r.height > 0 for r in found)
    assert {(r.sample_id, r.group, r.component) for r in found if r.sample_id == "a"} == {("a", 0, 0), ("a", 0, 1), ("a", 1, 0)}


def test_with_noise(spark):
    r = np.random.default_rng(3)
    y = signal(CURVES["a"]) + r.normal(0, 0.05, len(X))
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(X, y, strict=True))]
    s = spark.createDataFrame(rows, "sample_id long, seq long, x double, y double")
    at = [int(np.argmax(y * (abs(X - c) < 0.2))) for c in (1.55, 1.97, 5.1)]
    got = sorted(emg.fitted(s, spark.createDataFrame([(1, i, float(y[i])) for i in at], "sample_id long, seq long, y double"), ["sample_id"]).collect(), key=lambda c: c.rt)
    for have, want in zip(got, CURVES["a"], strict=True):
        assert (have.area, have.rt) == (pytest.approx(want[0], rel=0.03), pytest.approx(want[1], abs=0.02))


def test_linear_areas_are_those_of_least_squares():
    q = np.array([[1.5, np.log(0.1), np.log(0.05)], [1.9, np.log(0.12), np.log(0.08)]])
    a = emg.curves(X, q)
    assert a == pytest.approx(np.stack([K.emg(X, 1.0, m, np.exp(s), np.exp(u)) for m, s, u in q], 1))
    areas, rest, _ = emg.areas_of(a, signal(CURVES["a"]))
    assert areas == pytest.approx(np.linalg.lstsq(a, signal(CURVES["a"]), rcond=None)[0]) and np.abs(a.T @ rest).max() < 1e-6
    negative, rest, _ = emg.areas_of(a, a @ [1.0, -0.5])
    assert negative[1] == 0 and negative[0] > 0 and rest == pytest.approx(a @ [1.0, -0.5] - a @ negative)


def test_seeds_that_are_none_go(monkeypatch):
    y = signal(CURVES["c"])
    # a seed without a peak: the leaner fit leaves as little
    found, _ = emg.joint(X[300:600], y[300:600], [4.05, 5.6])
    assert sum(c["area"] > 0.01 for c in found) == 1
    # a search that never converges drops the weakest seed each time, then gives up
    seen = []
    monkeypatch.setattr(emg, "searched", lambda t, y, start, *a: (seen.append(len(start)), (start, np.ones(len(start)), 0.0, False))[1])
    assert emg.joint(X, y, [1.0, 4.0, 5.0, 6.0]) == ([], np.inf) and seen == [4, 4, 3, 3, 2, 2]  # two starts each
    assert emg.joint(X, y, []) == ([], np.inf)


def test_the_fattest_goes_only_where_the_fit_stays_as_good():
    y = K.emg(X, 8, 3.0, 0.15, 0.1) + 0.3 * K.emg(X, 30, 4.0, 1.9, 0.1)
    both, _ = emg.joint(X, y, [3.05, 4.1])
    assert len(both) == 2  # the broad one is there
    narrow, _ = emg.joint(X, K.emg(X, 8, 3.0, 0.15, 0.1), [3.05, 5.5])
    assert len(narrow) == 1 or narrow[1]["area"] < 1e-6


def test_a_peak_on_a_cut_is_fitted_once_more(spark, samples):
    own = samples.filter("sample_id in ('a', 'c')")
    at = int(np.argmax(signal(CURVES["c"])))
    rows = [("a", 0, 0, 350), ("a", 1, 350, 799), ("c", 0, 100, at - 3), ("c", 1, at - 3, 650), ("c", 2, 651, 799)]
    chunks = spark.createDataFrame(rows, "sample_id string, chunk int, low long, high long")
    found, after = emg.refitted(own, apexes(spark).filter("sample_id <> 'b'"), chunks)
    assert_planted(found.collect(), "ac")
    assert {(r.sample_id, r.chunk, r.low, r.high) for r in after.collect()} == {("a", 0, 0, 350), ("a", 1, 350, 799), ("c", 0, 100, 650), ("c", 2, 651, 799)}
    first = emg.chunk_fit(own, apexes(spark), chunks).filter("sample_id = 'c'").collect()
    assert not first or abs(max(first, key=lambda r: r.area).area - 3) > 0.03  # the cut one was wrong
    untouched = {(r.rt, r.area) for r in emg.chunk_fit(own, apexes(spark), chunks).filter("sample_id = 'a'").collect()}
    assert untouched == {(r.rt, r.area) for r in found.filter("sample_id = 'a'").collect()}


def test_runs_of_cut_chunks_and_doubled_apexes(spark, samples):
    own = samples.filter("sample_id = 'c'")
    top = int(np.argmax(signal(CURVES["c"])))
    chunks = spark.createDataFrame([("c", k, a, b) for k, (a, b) in enumerate([(100, top - 12), (top - 12, top + 12), (top + 12, 700)])], "sample_id string, chunk int, low long, high long")
    marks = apexes(spark, {"c": [top - 1, top, top + 1]}).filter("sample_id = 'c'")
    found, after = emg.refitted(own, marks, chunks, rounds=3)
    assert [(r.chunk, r.low, r.high) for r in after.collect()] == [(0, 100, 700)]
    assert_planted(found.collect(), "c")


def test_apexes_closer_than_a_limit_count_once(spark):
    rows = spark.createDataFrame([(1, v) for v in (0.0, 0.015, 0.03, 0.5)], "sample_id int, x double")
    assert sorted(r.x for r in W.kept_apart(rows, ["sample_id"], "x", 0.02).collect()) == [0.0, 0.03, 0.5]


def test_groups_are_fitted_side_by_side(monkeypatch):
    """As one by one, in few calls: one group after another took the time of its many small steps."""
    r = np.random.default_rng(3)
    many = []
    for k in range(24):
        t = np.linspace(0, 8, 60 + 2 * k)
        middles = sorted((1 + 1.5 * (k % 3) + r.random() * 0.3 + 2.2 * i) for i in range(1 + k % 2))
        many.append((t, sum(K.emg(t, 5 + i, m, 0.2, 0.15) for i, m in enumerate(middles)), middles))
    alone, calls, beside = [emg.joint(*m) for m in many], [], emg.searched_beside
    monkeypatch.setattr(emg, "searched_beside", lambda many, rounds: (calls.append(len(many)), beside(many, rounds))[1])
    together = emg.joints(many)
    assert len(calls) <= 8 and max(calls) >= 12
    for (have, _), (want, _), (_, _, middles) in zip(together, alone, many, strict=True):
        assert len(have) == len(want) == len(middles)
        assert [c[k] for c in have for k in ("rt", "area")] == pytest.approx([c[k] for c in want for k in ("rt", "area")], rel=1e-4)
        assert sum(c["area"] for c in have) == pytest.approx(sum(5 + i for i in range(len(middles))), rel=1e-3)


def test_slopes_are_those_of_the_curves():
    t = np.linspace(0, 10, 50)
    for s, u in ((0.3, 0.2), (1.0, 0.001), (0.01, 2.0), (0.5, 0.04)):
        q = np.array([[4.0, np.log(s), np.log(u)]])
        for i in range(3):
            step = np.eye(3)[i] * 1e-5
            want = (emg.curves(t, q + step) - emg.curves(t, q - step))[:, 0] / 2e-5
            assert emg.slopes(t, q)[:, i] == pytest.approx(want, abs=1e-3 * np.abs(want).max())


#: A group of noise, one of whose curves comes to weigh next to nothing: x, y and the places of its apexes.
FAINT = (
    [9071.4113722, 9229.8976633, 9329.937558633334, 11160.620794133334, 12310.111377733334, 12839.6241833, 15350.828844583333, 16005.064297133333, 16864.4727395, 17181.6899913, 17920.37512005, 18334.6848688, 18423.508443416667, 18912.392842183333, 19903.0553623, 20585.363602333335, 20739.112578416665],
    [5.76, 13.72, 49.16, 51.93, 13.17, 77.6, 49.97, 118.27, 62.06, 72.48, 0.9, 35.54, 11.44, 22.23, 16.28, 1.87, 43.76],
    [5, 7, 9],
)


def faint(spark):
    """That group as a signal, and its apexes."""
    x, y, at = FAINT
    samples = spark.createDataFrame([("f", i, *p) for i, p in enumerate(zip(x, y, strict=True))], "sample_id string, seq long, x double, y double")
    return samples, spark.createDataFrame([("f", i, y[i]) for i in at], "sample_id string, seq long, y double")


def test_a_curve_of_next_to_no_weight_does_not_end_the_refit(spark, samples):
    """It did, with "Singular matrix", and with it the whole job."""
    own, tops = faint(spark)
    chunks = spark.createDataFrame([("f", 0, 0, 16), ("c", 0, 100, 700)], "sample_id string, chunk int, low long, high long")
    found, _ = emg.refitted(samples.filter("sample_id = 'c'").unionByName(own), apexes(spark).filter("sample_id = 'c'").unionByName(tops), chunks)
    rows = found.collect()
    assert_planted([r for r in rows if r.sample_id == "c"], "c")
    assert sum(r.sample_id == "f" for r in rows) in (2, 3)
    assert all(np.isfinite([r.rt, r.area, r.sigma, r.tau, r.height]).all() and 0 < r.r2 <= 1 for r in rows)


def test_systems_of_any_scale_are_solved():
    r = np.random.default_rng(5)
    a = r.normal(size=(6, 9, 4))
    a = np.swapaxes(a, 1, 2) @ a
    b = r.normal(size=(6, 4))
    want = np.linalg.solve(a, b[..., None])[..., 0]
    assert (emg.solved(a, b) == want).all()
    scale = np.ones((6, 4))
    scale[2] = [1, 1e-160, 1, 1e-155]  # their squares vanish, all but a few bits
    scale[4] = [1e-30, 1, 1e3, 1e-28]
    got = emg.solved(a * scale[:, :, None] * scale[:, None], b * scale) * scale
    assert np.isfinite(got).all() and (got[[0, 1, 3, 5]] == want[[0, 1, 3, 5]]).all()
    assert got[4] == pytest.approx(want[4])
    a[3] = 1.0  # equal parameters share the step, the other systems are as they were
    assert emg.solved(a, np.ones((6, 4)))[3] == pytest.approx(0.25) and (emg.solved(a, b)[0] == want[0]).all()


def test_a_curve_of_next_to_no_weight_does_not_end_the_fit(spark, samples):
    own, tops = faint(spark)
    found = emg.fitted(samples.filter("sample_id <> 'b'").unionByName(own), apexes(spark).filter("sample_id <> 'b'").unionByName(tops), ["sample_id"]).collect()
    assert_planted([r for r in found if r.sample_id != "f"], "ac")
    assert [(r.group, r.component) for r in found if r.sample_id == "f"][:2] == [(0, 0), (0, 1)]
    x, y, at = FAINT
    alone, rss = emg.joint(np.array(x), np.array(y), [x[i] for i in at])
    assert alone and 0 < rss < np.square(np.array(y) - np.mean(y)).sum()


NARROW = [(0.2, 2.013, 0.006, 0.003), (0.3, 2.085, 0.006, 0.003), (10, 5.0, 0.3, 0.2)]


def narrow(spark, noise=0.0):
    """A signal of 4,801 samples in one group, two of whose curves are a few samples wide; its apexes, x and y."""
    x = np.linspace(0, 8, 4801)
    y = sum(K.emg(x, *c) for c in NARROW) + np.random.default_rng(7).normal(0, noise, len(x))
    samples = spark.createDataFrame([("n", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id string, seq long, x double, y double")
    at = [int(np.argmax(y * (np.abs(x - c[1] - 0.02) < 0.03))) for c in NARROW[:2]] + [int(np.argmax(y * (x > 3)))]
    return samples, spark.createDataFrame([("n", i, float(y[i])) for i in at], "sample_id string, seq long, y double"), x, y


def test_a_fit_uses_every_sample_of_its_group(spark):
    """240 of them were used, in which narrow curves were lost, and R2 set their residual against all samples."""
    samples, tops, x, y = narrow(spark, 0.01)
    found = sorted(emg.fitted(samples, tops, ["sample_id"], emg.Fit(share=-1.0)).collect(), key=lambda r: r.rt)
    assert {r.group for r in found} == {0} and len(found) == 3
    for have, want in zip(found, NARROW, strict=True):
        assert (have.area, have.rt, have.sigma) == (pytest.approx(want[0], rel=0.01), pytest.approx(want[1], abs=1e-3), pytest.approx(want[2], rel=0.05))
    rest = y - sum(K.emg(x, r.area, r.rt, r.sigma, r.tau) for r in found)
    assert 1 - found[0].r2 == pytest.approx((rest**2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-3)


def test_merged_chunks_are_fitted_by_every_sample(spark):
    samples, tops, _, _ = narrow(spark)
    chunks = spark.createDataFrame([("n", 0, 0, 3100), ("n", 1, 3101, 4800)], "sample_id string, chunk int, low long, high long")
    found, after = emg.refitted(samples, tops, chunks, emg.Fit(share=-1.0))
    assert [(r.low, r.high) for r in after.collect()] == [(0, 4800)]  # the cut went through the broad curve
    rows = sorted(found.collect(), key=lambda r: r.rt)
    assert len(rows) == 3
    for have, want in zip(rows, NARROW, strict=True):
        assert (have.area, have.rt, have.sigma, have.tau) == pytest.approx(want, rel=1e-3)
