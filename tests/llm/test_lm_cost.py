"""op1: what keeps its CPU seconds down gives the same numbers as the plain way."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chromaflux.llm import gru, lm


@pytest.mark.parametrize("many", [1, 7, 8, 9, 65, 4096])
@pytest.mark.parametrize("distinct", [1, 3, 1089])
def test_rows_of_equal_ids_are_summed(many, distinct):
    rng = np.random.default_rng(many)
    ids = np.minimum(rng.zipf(1.3, many), distinct) - 1
    rows = rng.standard_normal((many, 48)).astype(np.float32)
    want = np.zeros((distinct, 48))
    np.add.at(want, ids, rows)
    found, sums = gru.summed(rows, ids, gru.Space())
    assert sorted(found.tolist()) == sorted(set(ids.tolist()))
    assert sums == pytest.approx(want[found], abs=1e-3)


def test_windows_use_memory_again():
    """Training took fresh memory for every array of a window, and pages that are touched for the first time are dear."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1088, 64).astype(np.int16) for _ in range(gru.LANES)]
    learner = gru.Learner(gru.initial(np.full(1088, 1 / 1088)))
    most, begin = [], gru.Run.window

    def window(self, *args):
        now, _ = tracemalloc.get_traced_memory()
        out = begin(self, *args)
        most.append(tracemalloc.get_traced_memory()[1] - now)
        tracemalloc.reset_peak()
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(gru.Run, "window", window)
        tracemalloc.start()
        try:
            learner.learn(texts)
        finally:
            tracemalloc.stop()
    # a figure holds what the window itself took and what learning from the one before it did
    assert len(most) == 4 and max(most[2:]) < 1 << 20


def test_words_of_a_part_are_looked_up_together():
    words = [b"", *(f"w{i}".encode() for i in range(3000)), b"\xc3\xa4", b"x"]
    counts = {w: 1 + 10 * (i % 700) for i, w in enumerate(words)}
    prefixes: dict[bytes, tuple[int, int]] = {}
    for w, n in counts.items():
        a, b = prefixes.get(w[:2], (0, 0))
        prefixes[w[:2]] = a + n, b + 1
    for size in (0, 1, 900, len(words)):
        head = list(counts.items())[:size]
        v = lm.Vocabulary(head, prefixes, sum(counts.values()), len(words))
        ask = [*words, b"never", b"w", b"\xff"]
        outputs, at = v.numbers(pa.array(ask, pa.binary()))
        place = {w: i for i, (w, _) in enumerate(head)}
        assert at.tolist() == [place.get(w, -1) for w in ask]
        # outside of the head a word is in its prefix' bucket, whatever its count
        assert outputs.tolist() == [v.number(w) if w in place else v.bucket.get(w[:2], lm.OUTPUTS - 1) for w in ask]
