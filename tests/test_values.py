"""Values of the signal core against plain loops over the same signals, and of the operators SQL cannot say."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromaflux.operators import components as C
from chromaflux.operators import extract as E
from chromaflux.operators import kernels as K
from chromaflux.operators import signal as G
from chromaflux.operators import spectra as M
from chromaflux.operators import windows as W
from chromaflux.plans import signal_queries as Q
from chromaflux.plans.adapters import signals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark):
    """The driver's signals: sample_id -> (seq, x, y)."""
    p = signals(spark, SF).toPandas().sort_values(["sample_id", "seq"])
    return {k: (g["seq"].to_numpy(), g["x"].to_numpy(), g["y"].to_numpy()) for k, g in p.groupby("sample_id")}


def plain_maxima(y):
    return [i for i in range(1, len(y) - 1) if y[i - 1] < y[i] > y[i + 1]]


def plain_prominence(y, at):
    left = min(y[next((j for j in range(at, -1, -1) if y[j] > y[at]), 0) : at + 1])
    right = min(y[at : next((j for j in range(at, len(y)) if y[j] > y[at]), len(y) - 1) + 1])
    return y[at] - max(left, right)


def plain_simpson(x, y):
    """Parabolas through three neighbours, two intervals each; an interval left over lies under that of the last three."""
    if len(x) < 3:
        return float(np.trapezoid(y, x))

    def under(i, lo, hi):
        t = x[i : i + 3] - x[i]
        q = np.polynomial.Polynomial(np.linalg.solve(np.vander(t, 3, increasing=True), y[i : i + 3])).integ()
        return q(hi - x[i]) - q(lo - x[i])

    total = sum(under(i, x[i], x[i + 2]) for i in range(0, len(x) - 2, 2))
    return total + (under(len(x) - 3, x[-2], x[-1]) if len(x) % 2 == 0 else 0.0)


@pytest.mark.parametrize("method", ["asls", "arpls", "airpls"])
def test_baselines_solved_together_are_those_solved_alone(held, method):
    many = [y for _, _, y in held.values()] + [np.array([1.0, 2.0]), np.zeros(30), np.arange(40.0)]
    for y, z in zip(many, K.baselines(many, method, 1e3), strict=True):
        assert z == pytest.approx(K.baseline(y, method, 1e3), rel=1e-6, abs=1e-6)


def test_whittaker_is_the_dense_solution():
    r = np.random.default_rng(1)
    for n, order in ((12, 1), (25, 2)):
        y, w = r.normal(size=n), r.random(n) + 0.1
        d = np.diff(np.eye(n), order, axis=0)
        assert K.smooth_whittaker(y, w, 50.0, order) == pytest.approx(np.linalg.solve(np.diag(w) + 50.0 * d.T @ d, w * y))


def test_a_signal_never_splits(spark, held, monkeypatch):
    monkeypatch.setattr(G, "TOGETHER", 10)
    got = G.processed(signals(spark, SF), Q.METHOD).toPandas()
    assert len(got) == sum(len(y) for _, _, y in held.values())
    for k, g in got.groupby("sample_id"):
        g = g.sort_values("seq")
        base = K.baseline(held[k][2], "arpls", 1e3)
        assert g["baseline_y"].to_numpy() == pytest.approx(base, rel=1e-6, abs=1e-6) and g["corrected_y"].to_numpy() == pytest.approx(held[k][2] - base, rel=1e-6, abs=1e-6)


def test_detected_and_integrated_peaks(spark, held):
    m = G.Method(baseline=None, min_prominence=0.2)
    apexes = {(r.sample_id, r.seq) for r in G.detect(G.processed(signals(spark, SF), m), m).collect()}
    want = {(k, int(seq[i])) for k, (seq, _, y) in held.items() for i in plain_maxima(y) if plain_prominence(y, i) >= 0.2 * (y.max() - y.min())}
    assert apexes == want
    peaks = G.run(signals(spark, SF), m).toPandas()
    assert len(peaks) == len(want)
    for k, g in peaks.groupby("sample_id"):
        _, x, y = held[k]
        tops = [i for i in plain_maxima(y) if plain_prominence(y, i) >= 0.2 * (y.max() - y.min())]
        for (row, (n, a)) in zip(g.sort_values("peak_number").itertuples(), enumerate(tops), strict=True):
            lo, hi = row.start_index, row.end_index
            assert row.retention_time == x[a] and lo <= a <= hi and row.start_time == x[lo] and row.end_time == x[hi]
            assert (n == 0 or lo >= tops[n - 1]) and (n + 1 == len(tops) or hi <= tops[n + 1])
            assert row.area == pytest.approx(abs(plain_simpson(x[lo : hi + 1], y[lo : hi + 1])), rel=1e-6, abs=1e-6)


def test_simpson_is_exact_for_parabolas():
    x = np.sort(np.random.default_rng(2).random(9))
    assert K.simpson(3 * x**2 - x + 1, x) == pytest.approx((x[-1] ** 3 - x[-1] ** 2 / 2 + x[-1]) - (x[0] ** 3 - x[0] ** 2 / 2 + x[0]))


def test_greedy_assignment_by_hand(spark):
    r = np.random.default_rng(3)
    rows = [(s, int(p), int(c), float(abs(r.normal())), float(r.integers(5))) for s in range(4) for p in range(5) for c in range(6)]
    got = {(x.sample_id, x.peak, x.component) for x in M.assign_greedy(spark.createDataFrame(rows, "sample_id long, peak long, component long, distance double, total double"), 1.0).collect()}
    want = set()
    for s in range(4):
        used_p, used_c = set(), set()
        for _, p, c, d, _ in sorted((x for x in rows if x[0] == s), key=lambda x: (x[3], -x[4], x[1], x[2])):
            if d <= 1.0 and p not in used_p and c not in used_c:
                used_p.add(p)
                used_c.add(c)
                want.add((s, p, c))
    assert got == want


def test_optimal_assignment_has_the_least_cost():
    r = np.random.default_rng(4)
    for n in (3, 5, 6):
        cost = r.random((n, n))
        assert sum(cost[i, j] for i, j in K.hungarian(cost)) == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_windows_hold_their_peaks(spark, held):
    for k, g in G.chunked(signals(spark, SF)).toPandas().groupby("sample_id"):
        _, x, y = held[k]
        g = g.sort_values("chunk")
        assert (g["start"] < g["end"]).all() and (g["start"].to_numpy()[1:] >= g["end"].to_numpy()[:-1]).all()
        floor = max(3 * np.sort(np.abs(y))[: max(1, len(y) // 4)].std(), 1e-10)
        tops = [x[i] for i in plain_maxima(y) if plain_prominence(y, i) >= 5 * floor]
        inside = sum(((g["start"] <= t) & (t <= g["end"])).any() for t in tops)
        assert inside >= 0.9 * len(tops)


def test_geometric_parts_share_out_the_area(spark, held):
    got = G.split_geometric(signals(spark, SF)).toPandas()
    for k, g in got.groupby("sample_id"):
        _, x, y = held[k]
        g = g.sort_values("component")
        whole = sum((x[i + 1] - x[i]) * (max(y[i + 1], 0) + max(y[i], 0)) / 2 for i in range(len(x) - 1))
        assert g["area"].sum() == pytest.approx(whole, rel=1e-9) and g["left"].iloc[0] == x[0] and g["right"].iloc[-1] == x[-1]
        assert (g["left"].to_numpy()[1:] == g["right"].to_numpy()[:-1]).all() and ((g["left"] <= g["rt"]) & (g["rt"] <= g["right"])).all()


def test_tracked_peaks_of_the_plane(spark):
    y = np.zeros((6, 12))
    for mod, height in ((1, 5.0), (2, 9.0), (3, 4.0)):
        y[mod, 3 + (mod == 3)] = height
    y[4, 9] = 7.0  # alone: too few
    plane = spark.createDataFrame([(1, m, s, float(y[m, s])) for m in range(6) for s in range(12)], "sample_id long, mod long, scan long, y double")
    got = M.peaks_2d(plane, 2, 2).collect()
    assert [(r.apex_mod, r.apex_scan, r.n_sub_peaks, r.mod_start, r.mod_end, r.volume) for r in got] == [(2, 3.0, 3, 1, 3, 18.0)]
    assert got[0].mod_centre == pytest.approx((5 + 18 + 12) / 18)


def test_emg_fit_finds_its_own_curve(spark):
    x = np.linspace(0, 10, 200)
    rows = [(s, i, float(x[i]), float(v)) for s, q in ((1, (8.0, 4.0, 0.3, 0.5)), (2, (3.0, 5.0, 0.2, 0.1))) for i, v in enumerate(K.emg(x, *q))]
    got = {r.sample_id: r for r in G.fit_emg(spark.createDataFrame(rows, "sample_id long, seq long, x double, y double")).collect()}
    assert (got[1].area, got[1].mu) == (pytest.approx(8, rel=0.02), pytest.approx(4, abs=0.05)) and got[1].r2 > 0.999 and got[2].area == pytest.approx(3, rel=0.05)


def test_alignment_finds_the_lag(spark):
    x = np.linspace(0, 10, 400)
    bump = lambda c: np.exp(-((x - c) ** 2) / 0.1)
    rows = [(1, i, float(x[i]), float(v), ch) for ch, y in (("a", bump(5.0)), ("b", bump(5.02))) for i, v in enumerate(y)]
    lag = G.aligned(spark.createDataFrame(rows, "sample_id long, seq long, x double, y double, channel string"), 6.0, 2000).first().lag_min
    assert abs(abs(lag) - 0.02) < 0.006


def test_components_of_a_mixture(spark):
    rt = np.linspace(0, 1, 201)
    shape = lambda c: np.exp(-((rt - c) ** 2) / (2 * 0.02**2))
    spectra = {0.40: {10: 1.0, 20: 0.5, 30: 0.3}, 0.47: {15: 1.0, 20: 0.4, 40: 0.6}}
    rows = []
    for mz in (10, 15, 20, 30, 40):
        y = sum(s.get(mz, 0.0) * shape(c) for c, s in spectra.items()) * 1e5
        rows += [(1, i, float(rt[i]), mz, float(v)) for i, v in enumerate(y)]
    scans = spark.createDataFrame(rows, "sample_id long, scan int, rt double, mz int, intensity double")
    peaks = spark.createDataFrame([(1, 1, 0.40, 0.35, 0.44), (1, 2, 0.47, 0.44, 0.52), (1, 3, 0.9, 0.88, 0.92)], "sample_id long, peak long, rt double, start double, end double")
    found = E.windowed_deconvolution(peaks, scans, 0.05, 0.02, 0.5, eps=0.01, height=200.0, prominence=1000.0).toPandas()
    for peak, centre in ((1, 0.40), (2, 0.47)):
        own = found[found["peak"] == peak].set_index("mz")["intensity"]
        for mz, v in spectra[centre].items():
            if mz != 20:
                assert own[mz] == pytest.approx(v * 1e5, rel=0.1)


def test_split_at_largest_gaps():
    def plain(rts, most):
        if len(rts) <= most:
            return [rts]
        at = max(range(len(rts) - 1), key=lambda i: (rts[i + 1] - rts[i], -i)) + 1
        return plain(rts[:at], most) + plain(rts[at:], most)

    r = np.random.default_rng(5)
    for most in (1, 3, 10):
        rts = sorted(r.random(23).round(2).tolist())
        parts = E.split_largest(rts, most)
        assert [[x for x, p in zip(rts, parts, strict=True) if p == k] for k in range(parts[-1] + 1)] == plain(rts, most)


def test_windows_of_neighbours(spark):
    rows = [(1, i, t, t - 0.1, t + 0.1) for i, t in enumerate([1.0, 1.15, 1.3, 1.9, 2.05, 5.0])]
    got = {r.peak: r for r in E.deconvolution_windows(spark.createDataFrame(rows, "sample_id long, peak long, rt double, start double, end double"), 0.5, 0.5, 3).collect()}
    assert [got[i].window for i in range(6)] == [1, 1, 1, 2, 2, 3]
    assert got[0].w_low == pytest.approx(0.9 - 0.25) and got[0].w_high == pytest.approx(1.4 + 0.25) and got[5].w_high == pytest.approx(5.1 + 0.1)


def test_shared_bounds_chain_from_left_to_right(spark):
    rows = [(1, 7, 1.0, 0.9, 1.1), (1, 7, 1.2, 1.1, 1.3), (1, 7, 1.4, 1.31, 1.5), (1, 7, 9.0, 8.9, 9.1), (1, 8, 1.2, 1.1, 1.3)]
    got = {(r.mz, r.rt_apex): (r.left, r.right) for r in E.shared_bounds(spark.createDataFrame(rows, "sample_id long, mz int, rt_apex double, left double, right double"), ["sample_id"]).collect()}
    want = {}
    for mz in (7, 8):
        own = [list(r[2:]) for r in rows if r[1] == mz]
        for a, b in zip(own, own[1:], strict=False):
            width = (a[2] - a[1]) + (b[2] - b[1])
            if width > 0 and b[2] - a[1] < 1.1 * width:
                a[2], b[1] = b[2], a[1]
        want |= {(mz, t): (lo, hi) for t, lo, hi in own}
    assert got == want


def test_merges_of_neighbours(spark):
    x = [float(i) for i in range(20)]
    y = [float((i * 7) % 5) for i in range(20)]
    samples = spark.createDataFrame([(1, i, x[i], y[i]) for i in range(20)], "sample_id long, seq long, x double, y double")
    comps = [(1, 2.0, 1.0, 5.0, 1, 3), (1, 3.0, 1.0, 9.0, 3, 5), (1, 3.9, 1.0, 2.0, 5, 8), (1, 10.0, 1.0, 2.0, 9, 12)]
    got = C.merged_geometric(spark.createDataFrame(comps, "sample_id long, rt double, area double, height double, left long, right long"), samples, 1.5).orderBy("rt").collect()
    area = sum((max(y[i], 0) + max(y[i + 1], 0)) / 2 for i in range(1, 8))
    assert [(r.rt, r.height, r.left, r.right) for r in got] == [(3.0, 9.0, 1, 8), (10.0, 2.0, 9, 12)] and got[0].area == pytest.approx(area) and got[1].area == 1.0
    emg = [(1, 2.0, 10.0, 0.5, 0.2, 5.0), (1, 2.4, 4.0, 0.3, 0.2, 3.0), (1, 9.0, 1.0, 0.5, 0.2, 1.0)]
    got = C.merged_emg(spark.createDataFrame(emg, "sample_id long, rt double, area double, sigma double, tau double, height double")).orderBy("rt").collect()
    assert [(r.rt, r.area, r.sigma) for r in got] == [(2.0, 14.0, 0.5), (9.0, 1.0, 0.5)] and got[0].height > 5.0


def test_peaks_of_emg_components(spark):
    x = np.linspace(0, 20, 401)
    samples = spark.createDataFrame([(1, i, float(v), None) for i, v in enumerate(x)], "sample_id long, seq long, x double, baseline_y double")
    got = C.emg_peaks(spark.createDataFrame([(1, 6.0, 12.0, 0.4, 0.3)], "sample_id long, rt double, area double, sigma double, tau double"), samples, 2.0).first()
    curve = K.emg(x, 12.0, 6.0, 0.4, 0.3)
    inside = x[curve >= 0.001 * curve.max()]
    assert (got.area, got.retention_time, got.start_time, got.end_time, got.base) == (24.0, x[curve.argmax()], inside[0], inside[-1], 0.0)


def test_shoulder_bounds_and_score(spark):
    x = np.linspace(0, 10, 201)
    y = np.exp(-((x - 4) ** 2) / 0.5) + 0.4 * np.exp(-((x - 5.4) ** 2) / 0.3)
    kind = ["peak" if i == 80 else "shoulder" if i == 108 else None for i in range(201)]
    got = C.shoulder_bounds(spark.createDataFrame([(1, i, float(x[i]), float(y[i]), kind[i]) for i in range(201)], "sample_id long, seq long, x double, y double, kind string"), 11).first()
    assert 80 < got.left < 108 < got.right < 140
    assert C.shoulder_score(x, y) > C.shoulder_score(x, np.exp(-((x - 4) ** 2) / 0.5)) and C.shoulder_score(x[:5], y[:5]) == 0


def test_ion_baselines_are_each_ion_s_own(spark):
    r = np.random.default_rng(6)
    rows = [(s, k, mz, float(50 * (mz == 3) + (1 if mz == 3 else 1000) * abs(r.normal()))) for s in (1, 2) for mz in (2, 3) for k in range(40)]
    got = E.ion_baselines(spark.createDataFrame(rows, "sample_id long, scan int, mz int, intensity double"), "arpls", 1e3).toPandas()
    for (s, mz), g in got.groupby(["sample_id", "mz"]):
        y = np.array([v for a, _, m, v in rows if (a, m) == (s, mz)])
        want = np.maximum(y - K.baseline(y, "arpls", 1e3), 0) if y.max() >= 100 else y
        assert g.sort_values("scan")["intensity"].to_numpy() == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_plane_baseline_leaves_the_peak():
    i, j = np.mgrid[0:20, 0:24]
    smooth = 5 + 0.1 * i + 0.05 * j
    peak = 50 * np.exp(-((i - 10) ** 2 + (j - 12) ** 2) / 4)
    z = E.plane_baseline(smooth + peak + 0.2 * np.random.default_rng(0).normal(size=peak.shape), 1e3)
    assert np.abs(z - smooth).max() < 0.3 and (smooth + peak - z)[10, 12] > 49


def test_preselected_search_finds_what_the_full_one_finds(spark):
    from chromaflux.plans.queries_spectra import preselected_topk
    from chromaflux.plans.adapters import spectra

    got = {(r.query, r.hit) for r in preselected_topk(spark, SF).collect()}
    s = spectra(spark, SF)
    full = {(r["query"], r.hit) for r in M.search(s.filter("id % 50 = 0"), s, 5).collect()}
    assert got == full
    near = {(r.query, r.hit) for r in E.preselected(s.filter("id % 50 = 0").select("id", "mz", "intensity"), s.select("id", "mz", "intensity"), 64, 8, 7, exact=False).collect()}
    assert len(near & full) >= 0.9 * len(full)


def test_large_tables_meet_by_buckets(spark, monkeypatch):
    from chromaflux.operators import joins as J

    r = np.random.default_rng(7)
    table = spark.createDataFrame([(i, f"c{i}", float(a), float(a + w / 2), float(a + w)) for i, (a, w) in enumerate(zip(r.random(60) * 50, r.random(60) * 4 + 0.1, strict=True))], "seq long, compound string, start double, apex double, end double")
    peaks = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.random(300) * 55)] + [(900, None)], "peak long, rt double")
    every = lambda: [sorted((x.peak, str(x.compound)) for x in f.collect()) for f in (J.match_window(peaks, table), J.match_apex(peaks, table, 0.5), J.match_weighted(peaks, table), J.identify(peaks, table, 0.4).fillna(""))]
    small = every()
    monkeypatch.setattr(J, "ARRAY_ROWS", 5)
    assert [[tuple(str(v) for v in x) for x in f] for f in every()] == [[tuple(str(v) for v in x) for x in f] for f in small]


def test_places_over_all_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.place == r.k + 1 for r in W.placed(rows, F.col("k").asc()).collect())


def test_a_batch_of_runs(spark):
    from chromaflux.operators.batch import batch, observed

    rt = np.linspace(0, 1, 201)
    shape = lambda c: np.exp(-((rt - c) ** 2) / (2 * 0.02**2))
    spectra = {0.3: {10: 1.0, 20: 0.5, 30: 0.3}, 0.7: {15: 1.0, 25: 0.4, 40: 0.6}}
    ys = {mz: sum(s.get(mz, 0.0) * shape(c) for c, s in spectra.items()) * 1e5 for mz in (10, 15, 20, 25, 30, 40)}
    scans = spark.createDataFrame([(1, i, float(rt[i]), mz, float(v)) for mz, y in ys.items() for i, v in enumerate(y)], "sample_id long, scan int, rt double, mz int, intensity double")
    total = sum(ys.values())
    rows = [(1, i, float(rt[i]), float(total[i])) for i in range(201)] + [(2, i, float(rt[i]), float(total[i])) for i in range(201)]  # the second run has no scans
    library = spark.createDataFrame([(k, mz, v) for k, s in enumerate(spectra.values()) for mz, v in s.items()] + [(9, 77, 1.0)], "id long, mz int, intensity double")
    names = spark.createDataFrame([(0, "first", "1"), (1, "second", "2"), (9, "other", None)], "id long, name string, casno string")
    out, seen = observed(batch(spark.createDataFrame(rows, "sample_id long, seq long, x double, y double"), scans, library, names, G.Method(baseline=None, min_prominence=0.1), 0.05, 0.02, eps=0.01))
    got = {(r.sample_id, r.peak): r for r in out.collect()}
    assert [(got[1, k].compound_id, got[1, k].casno, got[1, k].error) for k in (1, 2)] == [("first", "1", None), ("second", "2", None)] and got[1, 1].match_score > 0.99
    assert all(got[2, k].error == "no spectrum" and got[2, k].compound_id.startswith("Unknown") for k in (1, 2))
    assert seen.get == {"peaks": 4, "matched": 2, "errors": 2}


def test_shared_bounds_of_very_many_peaks(spark):
    r = np.random.default_rng(2)
    t = np.cumsum(r.uniform(0.1, 1, 20_000))
    lo, hi = t - r.uniform(0.01, 0.5, len(t)), t + r.uniform(0.01, 0.5, len(t))
    rows = spark.createDataFrame(pd.DataFrame({"sample_id": 1, "mz": 7, "rt_apex": t, "left": lo, "right": hi, "shared": True}))
    begin = time.perf_counter()
    got = E.shared_bounds(rows, ["sample_id"]).orderBy("rt_apex").toPandas()
    assert time.perf_counter() - begin < 20  # a fold that copies what is done took longer with the square of the peaks
    for k in range(1, len(t)):
        if hi[k] - lo[k - 1] < 1.1 * (hi[k - 1] - lo[k - 1] + hi[k] - lo[k]):
            hi[k - 1], lo[k] = hi[k], lo[k - 1]
    assert got["left"].tolist() == lo.tolist() and got["right"].tolist() == hi.tolist() and got["shared"].all()


def test_matches_of_several_modes_are_made_in_one_pass(spark):
    from chromaflux.operators import joins as J
    from chromaflux.plans.adapters import peaks, rt_table
    from chromaflux.plans.queries_more import rt_match_dispatch

    p, t = peaks(spark, SF).select("sample_id", "peak_number", "rt"), rt_table(spark, SF)
    want = {(m, *r) for m in (0, 1, 2, 7) for r in J.match(p, t, m, 0.1, 0.5).select("sample_id", "peak_number", "compound").collect()}
    plan = rt_match_dispatch(spark, SF)
    assert {tuple(r) for r in plan.collect()} == want and plan.count() == 4 * p.count()
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


def test_single_curves_are_fitted_side_by_side():
    r = np.random.default_rng(6)
    many, want = [], []
    for k in range(300):
        x = np.linspace(0, 10, 60 + k % 7)
        want.append((r.uniform(5, 50), r.uniform(3, 6), r.uniform(0.2, 0.5), r.uniform(0.2, 0.8)))
        many.append((x, K.emg(x, *want[-1])))
    begin = time.process_time()
    q, r2 = G.emg_fits(many)
    assert time.process_time() - begin < 3
    np.testing.assert_allclose(np.c_[q[:, :2], np.exp(q[:, 2:])], want, rtol=1e-3)
    np.testing.assert_allclose(G.emg_fits(many[7:8])[0], q[7:8], rtol=1e-4)
    assert (r2 > 0.9999).all()
