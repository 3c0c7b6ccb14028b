"""Components of split peaks: bounds of shoulders, grouping for a fit, filters, merges of neighbours, and back to peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import windows as W
from .joins import interval_join
from .signal import Signal, filled, own_ids, spread, together


def shoulder_span(s: np.ndarray, d2: np.ndarray, at: int, peaks: np.ndarray) -> tuple[int, int]:
    """Bounds of a shoulder: toward its parent peak where the curvature changes sign, outward down to 2 % of its height.

    Without a change of sign the largest curvature counts, close to the parent the middle. Outward a valley or half the way
    to the next peak ends it as well.
    """
    parent = int(peaks[np.argmin(np.abs(peaks - at))]) if len(peaks) else 0
    a, b = sorted((parent, at))
    inner = (a + b) // 2
    if b - a > 2:
        turns = a + np.nonzero(d2[a : b - 1] * d2[a + 1 : b] < 0)[0]
        # the change of sign nearest the shoulder
        inner = int(turns[-1] if parent < at else turns[0]) if len(turns) else a + int(np.argmax(d2[a:b]))
    step = 1 if parent < at else -1
    ahead = peaks[peaks * step > at * step]
    half = None if not len(ahead) else (at + int(ahead[0] if step > 0 else ahead[-1])) // 2
    outer = at
    for j in range(at + step, len(s) if step > 0 else -1, step):
        outer = j
        if (half is not None and (j - half) * step >= 0) or s[j] <= 0.02 * s[at]:
            break
        if abs(j - at) > 2 and s[j] > s[j - step] < s[j - 2 * step]:
            outer = j - step
            break
    return (inner, outer) if step > 0 else (outer, inner)


def shoulder_bounds(samples: DataFrame, window: int = 41, order: int = 3) -> DataFrame:
    """``left`` and ``right`` of each shoulder; samples: sample_id, seq, x, y and ``kind`` (``peak``, ``shoulder`` or null)."""
    def many(signals: list[Signal]) -> dict[str, list]:
        rows = []
        for one in signals:
            x, y, n = one["x"], filled(one["y"]), len(one["y"])
            size = (min(n - 1, 41) - (min(n - 1, 41) % 2 == 0)) if window >= n else window | 1
            marks = one["kind"]
            peaks, at = np.nonzero(marks == "peak")[0], np.nonzero(marks == "shoulder")[0]
            if not len(at) or size < 3:
                continue
            s, d2 = K.savgol(y, size, min(order, size - 1)), K.savgol(y, size, min(order, size - 1), 2, float(np.median(np.diff(x))) or 1.0)
            rows += [(one.sample_id, int(one["seq"][i]), *(int(one["seq"][k]) for k in shoulder_span(s, d2, int(i), peaks))) for i in at]
        return {c: [r[i] for r in rows] for i, c in enumerate(("sample_id", "seq", "left", "right"))}

    return together(samples, ["x", "y", "kind"], many, "sample_id long, seq long, left long, right long")


def shoulder_score(x: np.ndarray, y: np.ndarray, window: int = 7) -> float:
    """How much a peak looks like more than one: depth of the curvature's inner minima against its largest value, at most 1."""
    if len(y) < 10:
        return 0.0
    d2 = K.savgol(np.asarray(y, float), min(window, len(y) - 1 + len(y) % 2), 3, 2, float(np.median(np.diff(x))) or 1.0)
    most = float(np.abs(d2).max())
    dips = K.find_peaks(-d2)
    side = [-d2[k] for k in dips if abs(k - int(np.argmax(y))) > 2 and d2[k] < 0]
    return float(min(max(side, default=0.0) / most, 1.0)) if most > 0 else 0.0


def prominent(components: DataFrame, samples: DataFrame, least: float) -> DataFrame:
    """Components (sample_id, height) as high as ``least``: below 1 a share of the signal's range, else a height; 0 or less keeps all."""
    if least <= 0:
        return components
    if least >= 1:
        return components.filter(F.col("height") >= least)
    span = samples.groupBy("sample_id").agg((least * (F.max("y") - F.min("y"))).alias("__least"))
    return components.join(span, "sample_id").filter(F.col("height") >= F.col("__least")).drop("__least")


def apex_groups(samples: DataFrame, apexes: DataFrame, on: list[str], share: float = 0.48, most: int = 4) -> DataFrame:
    """Each apex (keys, ``apex``) with the ``group`` it is fitted in: neighbours join while the valley between them stays above ``share`` of the shorter; a run of more than ``most`` is cut by count."""
    valley = W.valleys(samples, apexes, on).join(samples.select(*on, F.col("seq").alias("valley"), F.col("y").alias("depth")), [*on, "valley"])
    own = apexes.select(*on, F.col("seq").alias("apex"), "y")
    held = own.join(valley.select(*on, F.col("next_apex").alias("apex"), "depth"), [*on, "apex"], "left")
    w = W.over(on, "apex")
    apart = F.col("depth").isNull() | (F.col("depth") <= share * F.least(F.col("y"), F.lag("y").over(w)))
    run = held.withColumn("__run", F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.floor((F.row_number().over(Window.partitionBy(*on, "__run").orderBy("apex")) - 1) / most)
    return run.withColumn("__part", part).withColumn("group", F.dense_rank().over(W.over(on, "__run", "__part")) - 1).drop("__run", "__part")


def group_spans(samples: DataFrame, grouped: DataFrame, on: list[str]) -> DataFrame:
    """``low`` and ``high`` of each group of :func:`apex_groups`: its outermost apexes' middles to the next group, a sixth of the group's width further out; at the ends of the signal its first and last sample."""
    spans = grouped.groupBy(*on, "group").agg(F.min("apex").alias("first"), F.max("apex").alias("last"), F.count("*").alias("n"))
    ends = samples.groupBy(*on).agg(F.min("seq").alias("__low"), F.max("seq").alias("__high"))
    g = W.over(on, "group")
    middle_low, middle_high = (F.lag("last").over(g) + F.col("first")) / 2, (F.col("last") + F.lead("first").over(g)) / 2
    low, high = F.coalesce(middle_low, F.col("__low").cast("double")), F.coalesce(middle_high, F.col("__high").cast("double"))
    spans = spans.join(ends, on).withColumn("low", low).withColumn("high", high)
    pad = (F.col("high") - F.col("low")) / 6
    return spans.select(*on, "group", "first", "last", "n", F.greatest(F.floor(F.col("low") - pad), F.col("__low")).alias("low"), F.least(F.ceil(F.col("high") + pad), F.col("__high")).alias("high"))


def fit_groups(samples: DataFrame, apexes: DataFrame, on: list[str], share: float = 0.48, most: int = 4) -> DataFrame:
    """Groups of apexes that are fitted together (:func:`apex_groups`) with ``first``, ``last``, ``n``, ``low`` and ``high``."""
    return group_spans(samples, apex_groups(samples, apexes, on, share, most), on)


def _fold(rows: DataFrame, on: list[str], order: str, near, merge) -> DataFrame:
    """Rows in ``order``, each merged into the last one kept where ``near``; inside Catalyst, as what is kept may move."""
    names = [c for c in rows.columns if c not in on]
    own = rows.select(*on, F.struct(order, *(c for c in names if c != order)).alias("r"))
    kind = own.schema["r"].dataType.simpleString()

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & near(last, r), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merge(last, r)))).otherwise(F.concat(done, F.array(r)))

    folded = F.aggregate(F.sort_array(F.collect_list("r")), F.array().cast(f"array<{kind}>"), step)
    return own.groupBy(*on).agg(folded.alias("rs")).select(*on, F.explode("rs").alias("r")).select(*on, *(f"r.{c}" for c in names))


def merged_geometric(components: DataFrame, samples: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Neighbours closer than ``tolerance`` become one: joint bounds, area between them, apex of the taller.

    components: sample_id, rt, area, height, left, right (seq). The area above zero comes from running sums at the bounds.
    """
    w = W.over(["sample_id"], "seq")
    top = F.greatest(F.col("y"), F.lit(0.0))
    strip = F.coalesce((F.col("x") - F.lag("x").over(w)) * (top + F.lag(top).over(w)) / 2, F.lit(0.0))
    sums = samples.withColumn("__s", strip).select("sample_id", "seq", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    of = lambda side: sums.select("sample_id", F.col("seq").alias(side), F.col("sum").alias(f"s_{side}"))
    held = components.join(of("left"), ["sample_id", "left"]).join(of("right"), ["sample_id", "right"])
    held = held.select("sample_id", "rt", "area", "height", "left", "right", "s_left", "s_right")

    def merge(a: Column, b: Column) -> Column:
        first, last = a["left"] <= b["left"], a["right"] >= b["right"]
        s_left, s_right = F.when(first, a["s_left"]).otherwise(b["s_left"]), F.when(last, a["s_right"]).otherwise(b["s_right"])
        taller = b["height"] > a["height"]
        pick = lambda c: F.when(taller, b[c]).otherwise(a[c]).alias(c)
        return F.struct(pick("rt"), (s_right - s_left).alias("area"), pick("height"), F.least(a["left"], b["left"]).alias("left"), F.greatest(a["right"], b["right"]).alias("right"), s_left.alias("s_left"), s_right.alias("s_right"))

    return _fold(held, ["sample_id"], "rt", lambda a, b: F.abs(b["rt"] - a["rt"]) < tolerance, merge).drop("s_left", "s_right")


def merged_emg(components: DataFrame, factor: float = 1.32) -> DataFrame:
    """Neighbours closer than ``factor`` of the wider sigma become one: areas add, the taller keeps its shape.

    components: sample_id, rt, area, sigma, tau, height; the merged height is that of both curves together.
    """
    def one(p: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for c in p.sort_values("rt", kind="stable").to_dict("records"):
            last = kept[-1] if kept else None
            if last is None or abs(c["rt"] - last["rt"]) >= factor * max(c["sigma"], last["sigma"]):
                kept.append(c)
                continue
            a, b = (c, last) if c["height"] > last["height"] else (last, c)
            t = np.linspace(min(a["rt"], b["rt"]) - 5 * a["sigma"], max(a["rt"], b["rt"]) + 5 * (a["sigma"] + a["tau"]), 401)
            both = K.emg(t, a["area"], a["rt"], a["sigma"], a["tau"]) + K.emg(t, b["area"], b["rt"], b["sigma"], b["tau"])
            kept[-1] = {**a, "area": a["area"] + b["area"], "height": float(both.max())}
        return pd.DataFrame(kept)[["sample_id", "rt", "area", "sigma", "tau", "height"]]

    return spread(components, "sample_id").groupBy("sample_id").applyInPandas(one, own_ids("sample_id long, rt double, area double, sigma double, tau double, height double", components))


def emg_peaks(components: DataFrame, samples: DataFrame, factor: float = 1.0, share: float = 0.001) -> DataFrame:
    """Components of an EMG fit as peaks: bounds where the curve is down to ``share`` of its height, area times ``factor``, numbered by time.

    components: sample_id, rt, area, sigma, tau; samples: sample_id, seq, x, baseline_y (NaN and null count as 0).
    """
    def one(key, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("seq")
        x, base = s["x"].to_numpy(float), np.nan_to_num(s["baseline_y"].to_numpy(float))
        rows = []
        for r in c.sort_values("rt", kind="stable").itertuples():
            curve = K.emg(x, r.area, r.rt, r.sigma, r.tau)
            at = int(np.argmax(curve)) if len(curve) else 0
            inside = np.nonzero(curve >= share * curve[at])[0] if len(curve) and curve[at] > 0 else np.array([], int)
            if len(inside):
                a, b = int(inside[0]), int(inside[-1])
                rows.append((key[0], len(rows) + 1, float(x[at]), float(r.area) * factor, float(x[a]), float(x[b]), float(x[b] - x[a]), float(curve[at]), float(base[at])))
        return pd.DataFrame(rows, columns=["sample_id", "peak_number", "retention_time", "area", "start_time", "end_time", "width", "height", "base"])

    schema = "sample_id long, peak_number int, retention_time double, area double, start_time double, end_time double, width double, height double, base double"
    return components.groupBy("sample_id").cogroup(samples.groupBy("sample_id")).applyInPandas(one, own_ids(schema, components))


def traces(samples: DataFrame, peaks: DataFrame, points: int = 256) -> DataFrame:
    """Each peak's signal between ``left`` and ``right`` (seq) on ``points`` even places, scaled to 0..1; a flat or single-point one is 0.

    peaks: sample_id, peak, left, right. Returns sample_id, peak, i, v.
    """
    ends = lambda side, x: samples.select("sample_id", F.col("seq").alias(side), F.col("x").alias(x))
    spans = peaks.join(ends("left", "x0"), ["sample_id", "left"]).join(ends("right", "x1"), ["sample_id", "right"])
    grid = spans.select("sample_id", "peak", "x0", "x1", "left", "right", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("t", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / (points - 1))
    # each place meets the last sample at or before it by window, over the peak's own samples
    own = interval_join(samples.select("sample_id", "seq", "x", "y"), peaks, "seq", "left", "right", ["sample_id"], whole=True)
    nxt = Window.partitionBy("sample_id", "peak").orderBy("seq")
    own = own.select("sample_id", "peak", F.col("x").alias("t"), F.struct("x", "y", F.lead("x").over(nxt).alias("xn"), F.lead("y").over(nxt).alias("yn")).alias("s"), F.lit(None).cast("int").alias("i"))
    both = own.unionByName(grid.select("sample_id", "peak", "t", F.lit(None).cast(own.schema["s"].dataType).alias("s"), "i"))
    order = Window.partitionBy("sample_id", "peak").orderBy("t", F.col("i").isNotNull(), "i").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).filter("i is not null")
    value = F.when(F.col("s.xn").isNull() | (F.col("s.xn") == F.col("s.x")), F.col("s.y")).otherwise(F.col("s.y") + (F.col("s.yn") - F.col("s.y")) * (F.col("t") - F.col("s.x")) / (F.col("s.xn") - F.col("s.x")))
    w = Window.partitionBy("sample_id", "peak")
    held = at.withColumn("v", value).withColumn("__lo", F.min("v").over(w)).withColumn("__hi", F.max("v").over(w))
    return held.select("sample_id", "peak", "i", F.when(F.col("__hi") - F.col("__lo") <= 1e-12, 0.0).otherwise((F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).alias("v"))
