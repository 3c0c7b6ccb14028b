"""Kernels against closed forms."""

import numpy as np
import pytest

from chromaflux.operators import kernels as K


@pytest.mark.parametrize("n", [3, 4, 7, 8])
def test_simpson_is_exact_on_quadratics(n):
    x = np.sort(np.random.default_rng(n).uniform(0, 5, n))
    y = 2 * x**2 - 3 * x + 1
    whole = lambda t: 2 * t**3 / 3 - 3 * t**2 / 2 + t
    assert K.simpson(y, x) == pytest.approx(whole(x[-1]) - whole(x[0]))


def test_simpson_of_two_and_one():
    assert K.simpson(np.array([1.0, 3.0]), np.array([0.0, 2.0])) == 4.0
    assert K.simpson(np.array([1.0]), np.array([0.0])) == 0.0


def test_maxima_take_plateaus_once_and_no_edges():
    assert K.maxima(np.array([3, 1, 2, 2, 2, 1, 5.0])).tolist() == [3]
    assert K.maxima(np.array([1.0, 2.0])).tolist() == []


def test_prominence_and_width_of_a_triangle():
    y = np.array([0, 1, 2, 3, 2, 1, 0.0])
    p = K.maxima(y)
    assert K.prominences(y, p)[0].tolist() == [3.0]
    assert K.widths(y, p, 0.5)[0].tolist() == [3.0]


def test_distance_keeps_the_tallest():
    y = np.array([0, 2, 0, 3, 0, 1, 0.0])
    assert K.find_peaks(y, distance=3).tolist() == [3]


def test_savgol_reproduces_its_polynomial_and_derivative():
    x = np.arange(20.0)
    y = 1 + 2 * x - 0.5 * x**2
    assert K.savgol(y, 5, 2) == pytest.approx(y)
    assert K.savgol(y, 5, 2, 1) == pytest.approx(2 - x)
    assert K.savgol(np.eye(5)[2] * 35, 5, 2)[2] == pytest.approx(17)


def test_median_filter_pads_with_zero():
    assert K.median_filter(np.array([5.0, 5, 5]), 3).tolist() == [5, 5, 5]
    assert K.median_filter(np.array([5.0, 6.0]), 5).tolist() == [0, 0]


def test_whittaker_solves_its_equations():
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=40), rng.uniform(0.1, 1, 40)
    for order in (1, 2):
        d = np.diff(np.eye(40), order, axis=0)
        assert K.smooth_whittaker(y, w, 7.0, order) == pytest.approx(np.linalg.solve(np.diag(w) + 7 * d.T @ d, w * y))


@pytest.mark.parametrize("method,limit", [("arpls", 0.3), ("airpls", 1.0), ("asls", 1.5), ("modpoly", 1.0), ("imodpoly", 1.0), ("snip", 1.0), ("irsqr", 0.5), ("mixture_model", 0.5), ("fastchrom", 0.5)])
def test_baselines_follow_a_slope_under_a_peak(method, limit):
    x = np.linspace(0, 10, 400)
    slope = 2 + 0.3 * x
    y = slope + 10 * np.exp(-((x - 5) ** 2) / 0.08) + np.random.default_rng(0).normal(0, 0.05, 400)
    base = K.baseline(y, method, lam=1e5 if method != "arpls" else 1e4, half=40, degree=1)
    assert np.abs(base - slope).max() < limit


@pytest.mark.parametrize("n", [4, 7, 50])
def test_spline_rows_sum_to_one(n):
    assert K.spline_basis(n, 6).sum(1) == pytest.approx(np.ones(n))


@pytest.mark.parametrize("method", ["irsqr", "mixture_model", "fastchrom"])
def test_baselines_of_flat_and_short_signals(method):
    for n in (4, 9, 60):
        assert K.baseline(np.full(n, 3.0), method, lam=1e3) == pytest.approx(np.full(n, 3.0), abs=1e-3)
    assert len(K.baseline(np.array([1.0, 2.0]), method)) == 2


def test_emg_integrates_to_its_area():
    t = np.linspace(-20, 200, 44001)
    for sigma, tau in ((1.0, 2.0), (0.5, 0.01), (2.0, 8.0)):
        assert K.trapezoid(K.emg(t, 7.0, 3.0, sigma, tau), t) == pytest.approx(7.0, rel=1e-4)


def test_nnls_and_hungarian():
    rng = np.random.default_rng(3)
    a = rng.uniform(size=(30, 4))
    assert K.nnls(a, a @ np.array([1.0, 0, 2.0, 0])) == pytest.approx([1, 0, 2, 0], abs=1e-8)
    from itertools import permutations

    for shape in ((4, 4), (3, 5), (5, 3)):
        c = rng.uniform(size=shape)
        n, m = min(shape), max(shape)
        big = c if shape[0] <= shape[1] else c.T
        assert sum(c[i, j] for i, j in K.hungarian(c)) == pytest.approx(min(sum(big[i, p[i]] for i in range(n)) for p in permutations(range(m), n)))


def test_shapes_and_lag():
    x = np.linspace(0, 1, 50)
    y = np.exp(-((x - 0.5) ** 2) / 0.01)
    assert K.shape_angle(x, y, x, 3 * y) == pytest.approx(0, abs=1e-3)
    assert K.shape_angle(x, y, x, 0 * y) == 90
    assert not K.is_shared(y) and K.is_shared(np.array([1, 5, 1, 5, 1.0])) and K.is_shared(x + 0.1)
    t = np.linspace(0, 10, 1000)
    g = lambda c: np.exp(-((t - c) ** 2) / 0.02)
    assert K.lag(t, g(5.0), t, g(5.05), 0.1) == pytest.approx(0.05, abs=0.002)
    assert K.lag(t, g(5.0), t, 0 * t, 0.1) == 0.0


def test_golden_weight_percent(spark):
    from chromaflux.operators.quant import broadcast_factors

    peaks = spark.createDataFrame([("s", "x", 20810783.0)], "sample_id string, compound string, area double")
    lib = spark.createDataFrame([(0, "x", 6.0, 78.1113, "a")], "seq int, compound string, c double, mw double, anchor string")
    anchors = spark.createDataFrame([(0, "a", 6.0, 78.1113, 0.044043310013, 28848616.5)], "seq int, anchor string, c double, mw double, known_wt_pct double, area double")
    samples = spark.createDataFrame([("s", 0.0631, 0.727)], "sample_id string, sample_mass_g double, solvent_mass_g double")
    row = broadcast_factors(peaks, lib, anchors, samples).first()
    assert row.wt_percent == pytest.approx(20810783 * 0.044043310013 / 28848616.5 * (0.0631 + 0.727) / 0.0631)


@pytest.mark.parametrize("order", [1, 2])
def test_long_baselines_are_those_of_the_plain_band(order):
    import time

    rng = np.random.default_rng(3)
    y, w, lengths = rng.normal(50, 9, (3, 3000)), rng.uniform(1e-6, 1, (3, 3000)), np.array([3000, 2999, 2410])
    got = K.whittaker_many(y, w, lengths, 1e4, order)
    for z, a, b, n in zip(got, y, w, lengths, strict=True):
        np.testing.assert_allclose(z[:n], K.smooth_whittaker(a[:n], b[:n], 1e4, order), rtol=1e-7)
    long = [rng.normal(50, 9, 40_000)]
    begin = time.process_time()
    K.baselines(long, "arpls", 1e3)
    assert time.process_time() - begin < 8  # one place after another took some 20 s and more


def test_prominences_of_long_signals_are_those_of_each_peak_alone():
    import time

    def alone(y, p):
        higher = np.nonzero(y[:p] > y[p])[0]
        low = higher[-1] if len(higher) else 0
        higher = np.nonzero(y[p + 1 :] > y[p])[0]
        high = higher[0] + p + 1 if len(higher) else len(y) - 1
        left, right = p - int(np.argmin(y[low : p + 1][::-1])), p + int(np.argmin(y[p : high + 1]))
        return y[p] - max(y[left], y[right]), left, right

    rng = np.random.default_rng(4)
    for y in (rng.integers(0, 9, 400).astype(float), np.cumsum(rng.normal(size=500)), np.zeros(5), np.array([1.0, np.nan, 3, 2, 5, 1])):
        at = K.maxima(y)
        got = list(zip(*K.prominences(y, at), strict=True))
        np.testing.assert_array_equal(np.array(got).reshape(-1, 3), np.array([alone(y, p) for p in at]).reshape(-1, 3))
    y = rng.normal(size=100_000)
    begin = time.process_time()
    K.prominences(y, K.maxima(y))
    assert time.process_time() - begin < 2
