"""op12 against plain numpy on whole matrices."""

import math

import numpy as np
import pytest

from chromaflux.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)


def plain(rows, k=8):
    """Everything by one dense matrix, deviations in whole numbers."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n = len(x)
    total = [sum(int(c) for c in col) for col in x.T]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    centred = x - np.array(total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in rows], n, deviation, centred @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


@pytest.mark.parametrize("n,d,width,height", [(300, 12, 5, 37), (500, 64, 32, 4096), (40, 9, 32, 1)])
def test_by_one_dense_matrix(spark, monkeypatch, n, d, width, height):
    monkeypatch.setattr(whitening, "WIDTH", width)
    monkeypatch.setattr(whitening, "ROWS", height)
    r = np.random.default_rng(n)
    mixed = r.normal(size=(n, d)) * np.linspace(0.05, 0.6, d) @ np.linalg.qr(r.normal(size=(d, d)))[0] + r.normal(size=d)
    rows = [(i // 2, v.tolist()) for i, v in enumerate(mixed)] + [(7, mixed[0].tolist())] * 20
    rows += [(1, None), (2, [*[0.5] * (d - 1), None]), (3, [*[0.5] * (d - 1), float("nan")]), (4, [float("inf"), *[0.5] * (d - 1)]), (None, mixed[1].tolist())]
    ids, count, deviation, white, explained = plain(rows)
    got = whitening.op12_whitening(frame(spark, rows)).collect()
    k = min(8, d)
    assert len(got) == len(ids) * k and {x.n for x in got} == {count}
    errors = {x.identity_error for x in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    by_row = {}
    for x in got:
        by_row.setdefault((x.vec_id, x.deviation, x.component), []).append((x.whitened, x.explained))
    signs = {}
    for i, dev, z in zip(ids, deviation, white, strict=True):
        for c in range(k):
            found = by_row[i, dev, c + 1]
            assert all(abs(e - explained[c]) < 1e-9 * explained[c] for _, e in found)
            match = [s for s in (1, -1) if any(abs(w - s * z[c]) < 1e-6 * (1 + abs(z[c])) for w, _ in found)]
            signs.setdefault(c, set(match)).intersection_update(match)
    assert all(signs.values())  # one sign for all rows of a component


def test_awkward_tables(spark):
    assert whitening.op12_whitening(frame(spark, [])).count() == 0
    assert whitening.op12_whitening(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.op12_whitening(frame(spark, [(1, [])])).count() == 0
    one = whitening.op12_whitening(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitening.op12_whitening(frame(spark, [(i, [float(i), 0.0]) for i in range(3)])).collect()
    assert sorted(round(x.whitened, 9) for x in line if x.component == 1) == pytest.approx([-1.5**0.5, 0, 1.5**0.5])
    assert {(x.whitened, x.explained) for x in line if x.component == 2} == {(None, 0.0)}
    uneven = whitening.op12_whitening(frame(spark, [(1, [1.0]), (2, [0.0, 1.0]), (3, [])])).collect()
    assert {(x.vec_id, x.deviation) for x in uneven} == {(1, 2048**2 + 1024**2), (2, 1024**2 + 2048**2), (3, 2 * 1024**2)}
    far = whitening.op12_whitening(frame(spark, [(1, [3e38]), (2, [0.0])])).collect()
    assert {x.deviation for x in far} == {None} and {round(abs(x.whitened), 9) for x in far} == {1.0}


def test_exact_where_longs_are_narrow(spark):
    rows = [(i, [3e5 * i, -2e5 * i * i]) for i in range(5)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((5 * c - s) ** 2 for c, s in zip(v, total, strict=True)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.op12_whitening(frame(spark, rows)).collect()}
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)} and None in got.values() or max(want) < 2**63
