"""Library scores by plain loops, embeddings against exact scans, direct spectra and the candidate rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaflux.operators import kernels as K
from chromaflux.operators import library as L
from chromaflux.operators import spectra as M


def spectra_of(seed, n, ions=14):
    r = random.Random(seed)
    return {i: {m: round(r.uniform(0.1, 9), 3) for m in r.sample(range(30, 60), r.randrange(1, ions))} for i in range(n)}


def frame(spark, spectra):
    return spark.createDataFrame([(i, m, v) for i, s in spectra.items() for m, v in s.items()], "id long, mz int, intensity double")


def plain(q, v, s):
    mass, power = L.WEIGHTINGS[s.weighting]
    q = {m + s.shift: x for m, x in q.items()}
    shared = sorted(q.keys() & v.keys())
    if not shared:
        return None
    w = lambda m, x: m**mass * x**power
    mine = q if s.unmatched in ("keep_all", "keep_experimental") else {m: q[m] for m in shared}
    theirs = v if s.unmatched in ("keep_all", "keep_library") else {m: v[m] for m in shared}
    cos = sum(w(m, q[m]) * w(m, v[m]) for m in shared) / math.sqrt(sum(w(m, x) ** 2 for m, x in mine.items()) * sum(w(m, x) ** 2 for m, x in theirs.items()))
    if s.similarity == "cosine":
        return cos
    ratios = [v[b] / v[a] * q[a] / q[b] for a, b in zip(shared, shared[1:], strict=False)]
    mean = sum(min(x, 1 / x) for x in ratios) / len(shared)
    return (len(mine) * cos + len(shared) * mean) / (len(mine) + len(shared))


@pytest.mark.parametrize("unmatched", L.UNMATCHED)
@pytest.mark.parametrize("rest", [("cosine", "None", 0), ("composite", "NIST", 2), ("composite", "NIST_GC", -1)])
def test_scores_by_plain_loop(spark, unmatched, rest):
    s = L.Scoring(rest[0], rest[1], unmatched, rest[2])
    queries, library = spectra_of(1, 6), spectra_of(2, 25)
    got = {(r.query, r.hit): r.score for r in L.scores(frame(spark, queries), frame(spark, library), s).collect()}
    want = {(a, b): plain(q, v, s) for a, q in queries.items() for b, v in library.items() if plain(q, v, s) is not None}
    assert got.keys() == want.keys()
    assert got == {k: pytest.approx(x) for k, x in want.items()}


def test_a_spectrum_finds_itself_and_ties_go_by_number(spark):
    library = spectra_of(3, 12)
    library[40] = library[5]
    for similarity in L.SIMILARITIES:
        for r in L.vector_search(frame(spark, library), frame(spark, library), 1, L.Scoring(similarity)).collect():
            assert r.hit == (5 if r.query == 40 else r.query) and (similarity == "composite" or r.score == pytest.approx(1))
    with pytest.raises(ValueError):
        L.Scoring(unmatched="drop")
    with pytest.raises(ValueError):
        L.search(frame(spark, library), frame(spark, library), "nearest")
    with_zero = frame(spark, {1: {40: 0.0, 41: 1.0}, 2: {40: 0.0}})
    assert [(r.query, r.hit) for r in L.scores(with_zero, with_zero).collect()] == [(1, 1)]


def test_buckets_find_nearly_all_that_a_scan_finds(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 24))
    v = centres[r.integers(40, size=4000)] + 0.4 * r.normal(size=(4000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    library = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {}
    for x in L.near(library.filter("id % 50 = 0"), library, 10).collect():
        got.setdefault(x.query, []).append((x.rank, x.hit, x.score))
    hits = 0
    for q in range(0, 4000, 50):
        exact = v @ v[q]
        order = np.lexsort((np.arange(4000), -np.round(exact, 9)))[:10]
        hits += len(set(order.tolist()) & {h for _, h, _ in got[q]})
        assert all(s == pytest.approx(exact[h]) for _, h, s in got[q])
    assert hits >= 0.9 * 80 * 10


def test_embedding_search_recall_against_the_scan(spark):
    r = random.Random(5)
    families = [r.sample(range(30, 200), 8) for _ in range(15)]
    library = {i: {**{m: r.uniform(1, 9) for m in r.sample(families[i % 15], 6)}, r.randrange(30, 200): 0.5} for i in range(900)}
    table = frame(spark, library)
    vectors = L.ion_vectors(table, 16).cache()
    assert {x.mz for x in vectors.collect()} == {m for s in library.values() for m in s}
    whole = {x.id: np.array(x.vector) for x in L.embedded(table, vectors).collect()}
    known = {x.mz: np.array(x.vector) for x in vectors.collect()}
    for i in (0, 17):
        plain_sum = sum(known[m] * x**0.6 for m, x in library[i].items())
        assert whole[i] == pytest.approx(plain_sum / np.linalg.norm(plain_sum))
    queries = table.filter("id % 50 = 0")
    found = {}
    for x in L.embedding_search(queries, table, vectors, 5).collect():
        found.setdefault(x.query, set()).add(x.hit)
    ids = np.array(sorted(whole))
    every = np.stack([whole[i] for i in ids])
    right = sum(len(found[q] & set(ids[np.lexsort((ids, -np.round(every @ whole[q], 9)))[:5]].tolist())) for q in found)
    assert len(found) == 18 and right >= 0.9 * 18 * 5
    # ions that stand together are alike: a spectrum's neighbours are mostly of its family
    assert sum(h % 15 == q % 15 for q, hs in found.items() for h in hs) >= 0.8 * 18 * 5
    hybrid = L.search(queries, table, "hybrid", 3, vectors=vectors).filter("rank = 1").collect()
    assert {x.query: x.hit for x in hybrid} == {q: q for q in found}
    assert L.near(L.embedded(queries, vectors), L.embedded(table.limit(0), vectors)).count() == 0


def plain_sharpness(y, left, right):
    """The rule in words: slopes to the top over points above a quarter of its height over the line between the bounds."""
    at = max(range(left, right + 1), key=lambda i: (y[i], -i))
    line = lambda i: y[left] + (y[right] - y[left]) * (i - left) / (right - left)
    if left == right or y[at] <= 0 or y[at] <= line(at):
        return -1.0
    quarter = line(at) + 0.25 * (y[at] - line(at))
    up = sorted((y[at] - y[i]) / (at - i) for i in range(left, at) if y[i] >= quarter)
    down = sorted((y[i] - y[at]) / (i - at) for i in range(at + 1, right + 1) if y[i] >= quarter)
    middle = lambda s: (s[len(s) // 2] + s[(len(s) - 1) // 2]) / 2
    if not up and not down:
        return -1.0
    return middle(up) if not down else middle(down) if not up else (middle(up) - middle(down)) / 2


def test_sharpness_by_its_rule():
    r = np.random.default_rng(2)
    for _ in range(300):
        y = np.round(r.uniform(0, 50, r.integers(1, 12)), 2)
        a, b = sorted(r.integers(0, len(y), 2))
        assert K.sharpness(y, a, b) == pytest.approx(plain_sharpness(y.tolist(), a, b))
    assert K.sharpness(np.array([0.0, 9.0, 10.0, 0.0]), 0, 3) == 1.0  # one side only
    assert K.sharpness(np.zeros(5), 0, 4) == -1.0


def test_shared():
    assert not K.is_shared(np.zeros(6)) and not K.is_shared(np.array([5.0])) and not K.is_shared(np.array([]))
    assert K.is_shared(np.array([1, 9, 4, 8, 1.0])) and K.is_shared(np.array([1, 9, 9, 4, 8, 8, 1.0]))
    assert not K.is_shared(np.array([1, 5, 5, 9, 9, 2, 1.0])) and K.is_shared(np.array([3, 9, 1.0])) and K.is_shared(np.array([1, 9, 5.0]))


def runs(spark, names=("a", "b")):
    """Each run: a clean pair of ions at 0.2, and at 0.4 two ions whose peaks stand on a slope, so none can be a model."""
    rows = []
    for k, run in enumerate(names):
        for i in range(60):
            bell = lambda c, w=3.0: math.exp(-((i - c) ** 2) / (2 * w * w))  # noqa: B023, E731
            rows += [(run, i, i / 100, 57, 9000 * bell(20) + 5), (run, i, i / 100, 71, 6000 * bell(20) + 5)]
            rows += [(run, i, i / 100, m, 4000 * bell(40) * (1 + k) + 150.0 * i) for m in (43, 99)]
            rows += [(run, i, i / 100, 85, 3000 * bell(40, 6.0) + 5)]
    return spark.createDataFrame(rows, "sample_id string, scan int, rt double, mz int, intensity double")


def test_a_cluster_without_candidate_has_the_direct_spectrum(spark):
    scans = runs(spark)
    peaks = M.ion_peaks(scans, 200.0, 1000.0).cache()
    found = M.deconvolved(peaks, eps=0.02, min_sharpness=1.0, excluded=(43.0, 85.0, 99.0)).collect()
    first = {r.mz: r.intensity for r in found if r.sample_id == "a" and r.component == 0}
    assert set(first) == {57, 71} and first[57] == pytest.approx(9005, rel=0.05)
    second = [r for r in found if r.sample_id == "a" and r.component == 1]
    at, held = second[0].rt, {(r.mz, r.rt): r.intensity for r in scans.filter("sample_id = 'a'").collect()}
    # every ion with a peak around the model's time has its own trace's value there, whatever its shape
    around = {r.mz for r in peaks.filter("sample_id = 'a'").collect() if r.left <= at <= r.right}
    assert {r.mz for r in second} == around >= {43, 85, 99}
    assert {r.mz: r.intensity for r in second} == {m: pytest.approx(held[m, at]) for m in around}
    low = M.deconvolved(peaks, eps=0.02, min_sharpness=1.0, min_intensity=8000.0).filter("sample_id = 'a'").select("mz").distinct().collect()
    assert 57 in {r.mz for r in low}
    with pytest.raises(KeyError):
        M.deconvolved(peaks, choice="width")


def test_direct_spectrum_between_samples(spark):
    scans = spark.createDataFrame([(1, m, t, v) for m, p in ((50, [(0.0, 1.0), (1.0, 3.0), (2.0, 1.0)]), (60, [(0.5, 4.0), (1.5, 8.0)])) for t, v in p], "sample_id int, mz int, rt double, intensity double")
    peaks = spark.createDataFrame([(1, 50, 1.0, 0.0, 2.0), (1, 50, 1.2, 0.5, 2.0), (1, 60, 1.0, 0.4, 1.6), (1, 70, 9.0, 8.0, 9.5)], "sample_id int, mz int, rt_apex double, left double, right double")
    models = spark.createDataFrame([(1, 0, 0.25), (1, 1, 1.0), (1, 2, 1.55), (1, 3, 7.0)], "sample_id int, model int, rt double")
    got = {(r.model, r.mz): r.intensity for r in L.direct_spectrum(models, peaks, scans, ["sample_id"]).collect()}
    assert got == {(0, 50): 1.5, (1, 50): 3.0, (1, 60): 6.0, (2, 50): pytest.approx(1.9), (2, 60): 8.0}
    assert L.direct_spectrum(models, peaks.limit(0), scans, ["sample_id"]).filter(F.lit(True)).count() == 0


@pytest.mark.parametrize("scoring", [L.Scoring(), L.Scoring("cosine", "NIST", "keep_library"), L.Scoring("composite", "NIST", "remove_all", 1), L.Scoring("composite", "None", "keep_experimental")])
def test_search_in_blocks_is_the_search_through_all_pairs(spark, monkeypatch, scoring):
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "ASKED", 5)
    monkeypatch.setattr(L, "CELLS", 60)
    library = spectra_of(4, 60)
    library |= {i + 100: library[i] for i in range(0, 60, 3)}
    table, queries = frame(spark, library), frame(spark, spectra_of(9, 12) | {50: library[7]})
    found = L.vector_search(queries, table, 4, scoring)
    pick = lambda df: {(r.query, r.rank): (r.hit, pytest.approx(r.score), r.shared) for r in df.collect()}
    assert pick(found) == pick(L.best(L.scores(queries, table, scoring), 4))
    # pairs stay numbers in a task: no join of the ions, and no more rows than n of a block for each query
    met = L.in_blocks(L.whole(L._sides(queries, table, scoring)[0], "query", "u", "iu"), L.whole(L._sides(queries, table, scoring)[1], "hit", "v", "iv"), 4, L.block_scores(scoring), extra="shared long")
    assert met.count() <= 13 * 4 * -(-80 // 7) and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_is_the_scan(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 50)
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    library = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {(x.query, x.rank): x.hit for x in L.near(library.filter("id % 10 = 0"), library, 6).collect()}
    for q in range(0, 300, 10):
        assert [got[q, k] for k in range(1, 7)] == np.lexsort((np.arange(300), -np.round(v @ v[q], 9)))[:6].tolist()
    some = L.near(library.filter("id % 10 = 0"), library, 6, L.Buckets()).count()
    assert some == 180
