"""Overlapping peaks as sums of exponentially modified Gaussians, fitted together group by group.

Groups of neighbouring apexes come from :func:`.components.fit_groups`; Spark deals their samples, a task fits many groups.
In a fit the areas are linear and solved for at each step (non-negative least squares), so only times and widths are
searched, by damped least squares within bounds (variable projection).
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from . import kernels as K
from . import windows as W
from .components import apex_groups, group_spans
from .joins import interval_join
from .signal import Signal, filled, repeated, together, typed


@dataclass(frozen=True)
class Fit:
    """Parameters of a joint fit; iterations take the place of time limits, so results don't depend on the machine."""

    share: float = 0.48
    most: int = 4
    reach: float = 1.5
    fat: float = 0.5
    retries: int = 2
    rounds: int = 120


#: A component must have so much area and height.
LEAST = 1e-10


#: Values of moved curves that are worked out together, and how much longer than the shortest a signal beside it may be.
CELLS, LIKE = 400_000, 3.0


def curves(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A column of area one for each row (time, log sigma, log tau) of ``q``; both may be stacked."""
    sigma, tau = np.exp(q[..., None, :, 1]), np.exp(q[..., None, :, 2])
    z = (t[..., None] - q[..., None, :, 0]) / sigma
    return np.exp(-z * z / 2) * K.erfcx((sigma / tau - z) / np.sqrt(2)) / (2 * tau)


def slopes(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The slopes of :func:`curves` by time, log sigma and log tau: three columns for each row of ``q``.

    What is left of 1 - sqrt(pi) u erfcx(u) is taken by its series where the difference would cancel.
    """
    sigma, tau = np.exp(q[..., None, :, 1]), np.exp(q[..., None, :, 2])
    z, ratio = (t[..., None] - q[..., None, :, 0]) / sigma, sigma / tau
    u = (ratio - z) / np.sqrt(2)
    g = np.exp(-z * z / 2) / (2 * tau)
    f = g * K.erfcx(u)
    v = 1 / (2 * np.maximum(u, 7.0) ** 2)
    rest = np.where(u > 7, g * v * (1 - v * (3 - v * (15 - v * (105 - 945 * v)))), g - np.sqrt(np.pi) * u * f) * np.sqrt(2 / np.pi)
    out = np.stack([(z * f - rest) / sigma, z * z * f - (ratio + z) * rest, ratio * rest - f], -1)
    return out.reshape(*out.shape[:-2], -1)


def areas_of(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(areas, residual, orthonormal base of the curves in use) of the best non-negative sum of columns."""
    areas, r, base = areas_beside(a[None], y[None])
    return areas[0], r[0], base[0]


def areas_beside(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(areas, residuals, orthonormal bases of the curves in use) of the best non-negative sums of columns, signal by signal."""
    top = np.abs(a).max(1)
    scale = np.where(top > 1e-200, top, np.inf)  # a curve between two places is nowhere
    scaled = a / scale[:, None]
    base, r = np.linalg.qr(scaled)
    goal = (y[:, None] @ base)[:, 0]
    areas = _least(r, goal)
    wrong = np.nonzero((areas < 0).any(1))[0]
    if len(wrong):
        areas[wrong] = _positive(r[wrong], goal[wrong])
        used = areas[wrong] > 0
        order = np.argsort(~used, axis=1, kind="stable")  # curves in use come first, so that the first vectors span them
        own = np.linalg.qr(np.take_along_axis(scaled[wrong], order[:, None], 2))[0]
        base[wrong] = own * (np.arange(base.shape[2]) < used.sum(1)[:, None])[:, None]
    areas = areas / scale
    return areas, y - (a @ areas[..., None])[..., 0], base


def _least(r: np.ndarray, goal: np.ndarray) -> np.ndarray:
    return (np.linalg.pinv(r, rcond=max(r.shape[1:]) * np.finfo(float).eps) @ goal[..., None])[..., 0]


def _positive(r: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Non-negative least squares of small square systems: of the subsets of columns whose solution is positive the best."""
    n = r.shape[2]
    if n > 4:
        return np.stack([K.nnls(x, g) for x, g in zip(r, goal, strict=True)])
    out, best = np.zeros((len(r), n)), (goal * goal).sum(1)
    for k in range(1, 2**n - 1):
        own = [i for i in range(n) if k >> i & 1]
        x = _least(r[:, :, own], goal)
        rss = ((goal - (r[:, :, own] @ x[..., None])[..., 0]) ** 2).sum(1)
        better = (x > 0).all(1) & (rss < best)
        best[better] = rss[better]
        full = np.zeros((int(better.sum()), n))
        full[:, own] = x[better]
        out[better] = full
    return out


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of square systems with positive diagonals, one for each row of ``b``.

    Where a curve has next to no weight in the signal, its slopes are so much smaller than the others' that a system is singular
    to the last place as it stands. Such a system is solved by itself, all its parameters brought to the same scale.
    """
    try:
        out = np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:  # one of them, it doesn't say which
        if len(a) > 1:
            half = len(a) // 2
            return np.concatenate([solved(a[:half], b[:half]), solved(a[half:], b[half:])])
        out = np.full(b.shape, np.nan)
    lost = np.nonzero(np.isnan(out).any(1))[0]
    if len(lost):
        scale = np.sqrt(np.diagonal(a[lost], axis1=1, axis2=2))
        out[lost] = _least(a[lost] / scale[:, :, None] / scale[:, None], b[lost] / scale) / scale
    return out


@dataclass
class Search:
    """A search for times and log widths from ``start`` within bounds, over a signal."""

    t: np.ndarray
    y: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


Found = tuple[np.ndarray, np.ndarray, float, bool]


def searched(t: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int) -> Found:
    """:func:`searched_beside` for one search."""
    return searched_beside([Search(t, y, start, low, high)], rounds)[0]


def searched_beside(many: list[Search], rounds: int) -> list[Found]:
    """(times and log widths, areas, residual sum of squares, converged) of damped steps, for searches with as many curves each.

    The slope of the residual is that of the curves at fixed areas, projected off the curves (Kaufman's form). The searches go
    side by side; each takes its own steps and stops by its own rule, and slopes are worked out once for a place, in closed form.
    """
    lengths = np.array([len(m.t) for m in many])
    wide = max(int(lengths.max()), len(many[0].start))  # no fewer rows than curves
    t, y = (np.stack([np.pad(v, (0, wide - len(v)), mode=mode) for v in side]) for side, mode in (([m.t for m in many], "edge"), ([m.y for m in many], "constant")))
    real = (np.arange(wide) < lengths[:, None])[..., None]
    start, low, high = (np.stack([getattr(m, c) for m in many]) for c in ("start", "low", "high"))
    n, count = start.shape[1], len(many)
    size = 3 * n
    q = np.clip(start, low, high)
    areas, r, base = areas_beside(np.where(real, curves(t, q), 0.0), y)
    rss = (r * r).sum(1)
    goal, damp, idle, turns = 1e-20 * (y * y).sum(1), np.full(count, 1e-2), np.zeros(count, int), np.zeros(count, int)
    a, g, free = np.zeros((count, size, size)), np.zeros((count, size)), np.zeros((count, size), bool)
    done, fresh, left = np.zeros(count, bool), np.ones(count, bool), np.arange(count)
    diagonal = np.arange(size)
    while True:
        new = left[fresh[left]]
        done[new] = (turns[new] < rounds) & (rss[new] <= goal[new])
        turns[new] += 1
        left = left[~done[left] & (turns[left] <= rounds)]
        new = left[fresh[left]]
        if len(new):
            slope = np.where(real[new], slopes(t[new], q[new]), 0.0) * np.repeat(areas[new], 3, 1)[:, None]
            jac = base[new] @ (np.swapaxes(base[new], 1, 2) @ slope) - slope
            a[new] = np.swapaxes(jac, 1, 2) @ jac
            g[new] = (r[new][:, None] @ jac)[:, 0]
            # a parameter at a bound that the slope pushes outward stays there
            flat, lo, hi = (v[new].reshape(-1, size) for v in (q, low, high))
            free[new] = ~(((flat <= lo) & (g[new] > 0)) | ((flat >= hi) & (g[new] < 0))) & (a[new][:, diagonal, diagonal] > 0)
            fresh[new] = False
            done[new] = ~free[new].any(1)
            left = left[~done[left]]
        if not len(left):
            break
        part = np.where(free[left][:, :, None] & free[left][:, None], a[left], 0.0)
        part[:, diagonal, diagonal] = np.where(free[left], part[:, diagonal, diagonal] * (1 + damp[left, None]), 1.0)
        move = -solved(part, np.where(free[left], g[left], 0.0))
        to = np.clip(q[left] + move.reshape(-1, n, 3), low[left], high[left])
        found = areas_beside(np.where(real[left], curves(t[left], to), 0.0), y[left])
        after = (found[1] ** 2).sum(1)
        better = after < rss[left]
        at, worse = left[better], left[~better]
        idle[at] = np.where(1 - after[better] / rss[at] < 1e-6, idle[at] + 1, 0)
        q[at], areas[at], r[at], base[at], rss[at] = to[better], found[0][better], found[1][better], found[2][better], after[better]
        damp[at] = np.maximum(damp[at] / 5, 1e-12)
        damp[worse] *= 4
        fresh[at] = True
        # two steps in a row that gained next to nothing, or no step that makes it better
        done[at[idle[at] == 2]] = True
        done[worse[damp[worse] >= 1e12]] = True
        left = left[~done[left]]
    return [(q[i], areas[i], float(rss[i]), bool(done[i])) for i in range(count)]


def joint(t: np.ndarray, y: np.ndarray, seeds: list[float], fit: Fit = Fit(), retries: int | None = None) -> tuple[list[dict], float]:
    """Curves (rt, area, sigma, tau) that together lie closest to ``y``, one for each seed that lasts, and their squared residual.

    A seed's time may move by ``reach`` guessed widths, widths go up to half the window. Where the search doesn't converge,
    the seed with the lowest signal goes, up to ``retries`` times. Where a curve is wider than ``fat`` of the window, the fit
    without it is taken if that leaves less than twice the residual.
    """
    plan, answer = _plan(t, y, seeds, fit, retries), None
    while True:
        try:
            s = plan.send(answer)
        except StopIteration as end:
            return end.value
        answer = searched(s.t, s.y, s.start, s.low, s.high, fit.rounds)


def joints(many: list[tuple[np.ndarray, np.ndarray, list[float]]], fit: Fit = Fit(), retries: int | None = None) -> list[tuple[list[dict], float]]:
    """:func:`joint` of many groups; the searches that they need next go side by side where they are alike in curves and length."""
    out: list[tuple[list[dict], float]] = [([], np.inf)] * len(many)
    plans = [_plan(t, y, seeds, fit, retries) for t, y, seeds in many]
    asked: dict[int, Search] = {}

    def on(i: int, answer: Found | None) -> None:
        try:
            asked[i] = plans[i].send(answer)
        except StopIteration as end:
            out[i] = end.value

    for i in range(len(many)):
        on(i, None)
    while asked:
        now, asked = asked, {}
        order = sorted(now, key=lambda i: (len(now[i].start), len(now[i].t)))
        at = 0
        while at < len(order):
            first = now[order[at]]
            n, room = len(first.start), LIKE * len(first.t) + 8
            most = max(1, int(CELLS / (room * 3 * n)))
            end = at + 1
            while end < len(order) and end - at < most and len(now[order[end]].start) == n and len(now[order[end]].t) <= room:
                end += 1
            for i, found in zip(order[at:end], searched_beside([now[i] for i in order[at:end]], fit.rounds), strict=True):
                on(i, found)
            at = end
    return out


def _plan(t: np.ndarray, y: np.ndarray, seeds: list[float], fit: Fit, retries: int | None) -> Generator[Search, Found, tuple[list[dict], float]]:
    """The fit of one group: it asks for searches and ends with what :func:`joint` returns."""
    left = fit.retries if retries is None else retries
    seeds, width = sorted(seeds), float(t[-1] - t[0])
    while seeds and width > 0:
        n = len(seeds)
        guess = width / (4 * n)
        narrow, wide = np.log(min(1e-4, width / 4)), np.log(width / 2)
        spaced = np.diff(seeds, prepend=-np.inf, append=np.inf)
        near = np.minimum(spaced[:-1], spaced[1:]) / 3  # apexes that stand apart have no wider curves
        start, low, high = [], [], []
        for s, apart in zip(seeds, near, strict=True):
            a, b = max(t[0], s - fit.reach * guess), min(t[-1], s + fit.reach * guess)
            own = min(_half_width(t, y, int(np.argmin(np.abs(t - s))), guess), max(apart, guess / 50))
            start.append((np.clip(s, a, b), np.log(own), np.log(own)))
            low.append((a, narrow, narrow))
            high.append((b, wide, wide))
        tries = []
        for tail in (0.3, 1.0):  # from short tails, then from long ones
            tries.append((yield Search(t, y, np.array(start) + [0, 0, np.log(tail)], np.array(low), np.array(high))))
            if tries[-1][3] and tries[-1][2] < 1e-6 * (y @ y):
                break
        q, areas, rss, done = min(tries, key=lambda f: (not f[3], f[2]))
        if not done:
            if left <= 0 or n == 1:
                return [], np.inf
            left -= 1
            seeds.pop(int(np.argmin([y[np.argmin(np.abs(t - s))] for s in seeds])))
            continue
        found = [{"rt": float(m), "area": float(v), "sigma": float(np.exp(s)), "tau": float(np.exp(u))} for v, (m, s, u) in zip(areas, q, strict=True)]
        widths = [2.355 * c["sigma"] + c["tau"] for c in found]
        fattest = int(np.argmax(widths))
        if n > 1 and widths[fattest] > fit.fat * width:
            leaner, other = yield from _plan(t, y, seeds[:fattest] + seeds[fattest + 1 :], fit, 0)
            if leaner and other < 2 * rss:
                return leaner, other
        return found, rss
    return [], np.inf


def _half_width(t: np.ndarray, y: np.ndarray, at: int, most: float) -> float:
    """A width from the nearer place at which the signal falls to half of its height at ``at``, no more than ``most``."""
    low = y < y[at] / 2
    before, after = np.nonzero(low[:at])[0], np.nonzero(low[at + 1 :])[0]
    down = t[at] - t[before[-1]] if len(before) else np.inf
    up = t[at + 1 + after[0]] - t[at] if len(after) else np.inf
    return float(np.clip(min(down, up) / 1.18, most / 50, most))


COMPONENT = "component int, rt double, area double, sigma double, tau double, height double, r2 double"


def fitted(samples: DataFrame, apexes: DataFrame, on: list[str], fit: Fit = Fit()) -> DataFrame:
    """Components of every group of apexes: keys, ``group``, ``component``, ``rt``, ``area``, ``sigma``, ``tau``, ``height``, ``r2``.

    samples: keys, seq, x, y; apexes: keys, seq, y. A group's samples meet it place by place in an equi-join and go to tasks
    by (keys, group): a signal with many groups is many units of work. ``r2`` is that of the whole group's fit, 1 where the
    signal is flat. Groups whose fit never converges give no component.
    """
    seeds = kept(apex_groups(samples, apexes, on, fit.share, fit.most))
    spans = group_spans(samples, seeds, on)
    inside = interval_join(samples.select(*on, "seq", "x", "y"), spans.select(*on, "group", "low", "high"), "seq", "low", "high", on, whole=True)
    marked = inside.join(seeds.select(*on, "group", F.col("apex").alias("seq"), F.lit(True).alias("seed")), [*on, "group", "seq"], "left")
    keys = (*on, "group")

    def many(signals: list[Signal]) -> dict[str, list]:
        rows: list[list[dict]] = []
        data = [(s["x"], filled(s["y"])) for s in signals]
        long = [i for i, (x, _) in enumerate(data) if len(x) >= 4]
        fits = dict(zip(long, joints([(*data[i], data[i][0][signals[i]["seed"]].tolist()) for i in long], fit), strict=True))
        for i, (x, y) in enumerate(data):
            curves, rss = fits.get(i, ([], 0.0))
            flat = float(((y - y.mean()) ** 2).sum())
            own = []
            for c in curves:
                c["height"] = float(K.emg(x, c["area"], c["rt"], c["sigma"], c["tau"]).max())
                if c["area"] >= LEAST and c["height"] >= LEAST:
                    own.append({**c, "component": len(own), "r2": 1 - min(rss / flat, 1.0) if flat > 0 else 1.0})
            rows.append(own)
        return {**repeated(signals, [len(r) for r in rows], *keys), **{c: [o[c] for r in rows for o in r] for c in ("component", "rt", "area", "sigma", "tau", "height", "r2")}}

    flagged = marked.select(*keys, "seq", "x", "y", F.coalesce("seed", F.lit(False)).alias("seed"))
    return together(flagged, ["x", "y", "seed"], many, f"{typed(flagged, *keys)}, {COMPONENT}", keys)


def chunk_fit(samples: DataFrame, apexes: DataFrame, chunks: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """:func:`fitted` within each chunk: ``sample_id``, ``chunk``, then as there.

    chunks: sample_id, chunk, low, high (places, both inside); a place that two chunks share counts for both.
    """
    on = ["sample_id", "chunk"]
    inside = kept(interval_join(samples.select("sample_id", "seq", "x", "y"), chunks.select(*on, "low", "high"), "seq", "low", "high", ["sample_id"], whole=True).select(*on, "seq", "x", "y"))
    marks = inside.join(apexes.select("sample_id", "seq"), ["sample_id", "seq"], "left_semi")
    return fitted(inside, marks.select(*on, "seq", "y"), on, fit)


def overflowing(components: DataFrame, chunks: DataFrame, samples: DataFrame, share: float = 0.2) -> DataFrame:
    """Chunks (sample_id, chunk) that belong together with the next one, as a component's body lies beyond the cut.

    A component's body is its time ± (2 sigma + tau); it overflows where more than ``share`` of it is outside its chunk.
    """
    place = lambda side, x: samples.select("sample_id", F.col("seq").alias(side), F.col("x").alias(x))
    ends = chunks.join(place("low", "t0"), ["sample_id", "low"]).join(place("high", "t1"), ["sample_id", "high"]).select("sample_id", "chunk", "t0", "t1")
    w = W.over(["sample_id"], "chunk")
    ends = ends.withColumn("before", F.lag("chunk").over(w)).withColumn("after", F.lead("chunk").over(w))
    held = components.join(ends, ["sample_id", "chunk"]).withColumn("__r", 2 * F.col("sigma") + F.col("tau"))
    left = held.filter(F.col("before").isNotNull() & (F.col("t0") - (F.col("rt") - F.col("__r")) > share * 2 * F.col("__r"))).select("sample_id", F.col("before").alias("chunk"))
    right = held.filter(F.col("after").isNotNull() & (F.col("rt") + F.col("__r") - F.col("t1") > share * 2 * F.col("__r"))).select("sample_id", "chunk")
    return left.unionByName(right).distinct()


def refitted(samples: DataFrame, apexes: DataFrame, chunks: DataFrame, fit: Fit = Fit(), share: float = 0.2, apart: float = 0.02, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(components, chunks) after chunks that cut through a component were merged with their neighbours and fitted once more.

    Runs of chunks that overflow into one another become one, numbered as its first; apexes in it count once where they are
    no more than ``apart`` from the last one kept. All other chunks keep their components. The merged chunks are looked
    at again, ``rounds`` times in all or until none overflows. samples, apexes and chunks as in :func:`chunk_fit`. Each
    round's tables are kept, so no fit is made twice.
    """
    found = kept(chunk_fit(samples, apexes, chunks, fit))
    for k in range(rounds):
        links = overflowing(found, chunks, samples, share).withColumn("linked", F.lit(True))
        if k and links.isEmpty():
            break
        w = W.over(["sample_id"], "chunk")
        joined = chunks.join(links, ["sample_id", "chunk"], "left")
        fresh = F.when(F.coalesce(F.lag("linked").over(w), F.lit(False)), 0).otherwise(1)
        runs = joined.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        merged = kept(runs.groupBy("sample_id", "__run").agg(F.min("chunk").alias("chunk"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).drop("__run"))
        again = merged.filter("n > 1").drop("n")
        seeds = interval_join(apexes.join(samples.select("sample_id", "seq", "x"), ["sample_id", "seq"]), again, "seq", "low", "high", ["sample_id"], whole=True)
        single = W.kept_apart(seeds, ["sample_id", "chunk"], "x", apart)
        own = seeds.join(single, ["sample_id", "chunk", "x"], "left_semi").select("sample_id", "seq").distinct()
        found = kept(found.join(merged.filter("n = 1").select("sample_id", "chunk"), ["sample_id", "chunk"], "left_semi").unionByName(chunk_fit(samples, own, again, fit)))
        chunks = merged.drop("n")
    return found, chunks
