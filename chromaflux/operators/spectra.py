"""Mass spectra: extraction, library search, chromatograms of single ions, deconvolution, matching, and the 2-D plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from . import kernels as K
from .library import Scoring, best, block_scores, direct_spectrum, in_blocks, whole
from .signal import own_ids, spread, typed
from .windows import dbscan_1d


def tic(scans: DataFrame, on: list[str]) -> DataFrame:
    """Total ion current of each scan."""
    return scans.groupBy(*on, "scan").agg(F.sum("intensity").alias("tic"))


def top_ions(scans: DataFrame, on: list[str], n: int = 10) -> DataFrame:
    return scans.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("intensity"), "mz"))).filter(F.col("rank") <= n)


def weighted_spectrum(scans: DataFrame, on: list[str]) -> DataFrame:
    """Mean intensity of each ion, weighted by the scans' total current."""
    w = F.sum("intensity").over(Window.partitionBy(*on, "scan"))
    held = scans.withColumn("w", w)
    return held.groupBy(*on, "mz").agg(F.try_divide(F.sum(F.col("w") * F.col("intensity")), F.sum("w")).alias("intensity"))


def relative_filter(scans: DataFrame, on: list[str], fraction: float) -> DataFrame:
    """Intensities strictly above ``fraction`` of their scan's highest; a fraction of 0 or less keeps all."""
    if fraction <= 0:
        return scans
    return scans.withColumn("__m", F.max("intensity").over(Window.partitionBy(*on))).filter(F.col("intensity") > fraction * F.col("__m")).drop("__m")


def excluded(scans: DataFrame, masses: list[float], tolerance: float = 0.5) -> DataFrame:
    return scans.filter(~F.exists(F.array(*(F.lit(float(m)) for m in masses)), lambda m: F.abs(F.col("mz") - m) <= tolerance)) if masses else scans


def search(queries: DataFrame, library: DataFrame, n: int = 5, mass_power: float = 0.0, power: float = 1.0) -> DataFrame:
    """The ``n`` library spectra of highest cosine for each query; both long: id, mz, intensity.

    Ions weigh mz^mass_power * intensity^power. Pairs are compared block by block (:func:`.library.in_blocks`); one that
    shares no ion is no hit.
    """
    weigh = F.pow(F.col("mz").cast("double"), mass_power) * F.pow("intensity", power)
    side = lambda df, key, w: whole(df.filter("intensity > 0").select(F.col("id").alias(key), "mz", weigh.alias(w), F.col("intensity").alias(f"i{w}")), key, w, f"i{w}")
    return best(in_blocks(side(queries, "query", "u"), side(library, "hit", "v"), n, block_scores(Scoring("cosine", "None"))), n)


def ion_peaks(scans: DataFrame, height: float = 200.0, prominence: float = 1000.0, on: list[str] | None = None) -> DataFrame:
    """Peaks of each ion's chromatogram, bounded at half height; ions that never reach ``height`` are left out first.

    A chromatogram is one run's, or that of the keys ``on``.
    """
    keys = [*(on or ["sample_id"]), "mz"]
    strong = scans.withColumn("__m", F.max("intensity").over(Window.partitionBy(*keys))).filter(F.col("__m") >= height).drop("__m")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("scan")
        rt, y = p["rt"].to_numpy(), p["intensity"].to_numpy()
        at = K.find_peaks(y, prominence=prominence, height=height)
        _, left, right = K.widths(y, at, 0.5)
        a, b = np.floor(left).astype(int), np.minimum(np.ceil(right).astype(int), len(y) - 1)
        return pd.DataFrame({
            **{k: p[k].iloc[0] for k in keys}, "rt_apex": rt[at], "left": rt[a], "right": rt[b], "height": y[at],
            "sharpness": [K.sharpness(y, i, j) for i, j in zip(a, b, strict=True)],
            "shared": [K.is_shared(y[i : j + 1]) for i, j in zip(a, b, strict=True)],
            "rts": pd.Series([rt[i : j + 1] for i, j in zip(a, b, strict=True)], dtype=object), "ys": pd.Series([y[i : j + 1] for i, j in zip(a, b, strict=True)], dtype=object),
        })

    schema = typed(scans, *keys) + ", rt_apex double, left double, right double, height double, sharpness double, shared boolean, rts array<double>, ys array<double>"
    return spread(strong, *keys).groupBy(*keys).applyInPandas(one, schema)


def complete_linkage(distance: np.ndarray, limit: float) -> np.ndarray:
    """Cluster numbers: clusters merge by their furthest pair while that is at most ``limit``."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    while n > 1:
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = divmod(int(np.argmin(masked)), n)
        if masked[i, j] > limit:
            break
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


#: How a cluster's model peak is chosen: the largest of this column.
CHOICES = {"sharpness": "sharpness", "intensity": "height", "mz": "mz"}


def deconvolved(
    peaks: DataFrame, eps: float = 0.005, least: int = 2, min_sharpness: float = 10.0, angle: float = 30.0, on: list[str] | None = None,
    excluded: tuple[float, ...] = (), tolerance: float = 0.5, min_intensity: float = 200.0, choice: str = "sharpness",
) -> DataFrame:
    """Components of each cluster of ion peaks: model peaks by shape, other ions shared out by non-negative least squares.

    ``peaks`` is what :func:`ion_peaks` returns. Peaks are clustered by their times first (:func:`.windows.dbscan_1d`), and
    a cluster is a group of its own, so a long run is many tasks; one whose highest peak is below ``min_intensity`` is
    left out. Candidates for models are sharp, unshared and not within ``tolerance`` of an ``excluded`` mass. A cluster
    without any has its best peak by ``choice`` as model and the direct spectrum of the whole run at its time
    (:func:`.library.direct_spectrum`). Components are numbered by cluster.
    """
    keys, best = on or ["sample_id"], CHOICES[choice]
    peaks = kept(peaks)  # traces are read once for the clusters and once for direct spectra
    clustered = dbscan_1d(peaks, keys, "rt_apex", eps, least, "mz").filter("cluster is not null")
    clustered = clustered.withColumn("__top", F.max("height").over(Window.partitionBy(*keys, "cluster"))).filter(F.col("__top") >= min_intensity).drop("__top")

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["rt_apex", "mz"]).reset_index(drop=True)
        key = [own[k].iloc[0] for k in (*keys, "cluster")]
        names = [*keys, "cluster", "of_cluster", "rt", "model_mz", "mz", "intensity"]
        barred = own["mz"].map(lambda m: any(abs(m - e) <= tolerance for e in excluded)).astype(bool)
        good = own[(~own["shared"]) & (own["sharpness"] >= min_sharpness) & ~barred]
        if len(good) == 0:
            model = own.loc[own[best].idxmax()]
            return pd.DataFrame([(*key, -1, model["rt_apex"], model["mz"], model["mz"], 0.0)], columns=names)
        m = len(good)
        rts, shapes = good["rts"].tolist(), [y / h for y, h in zip(good["ys"], good["height"], strict=True)]
        dist = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                dist[i, j] = dist[j, i] = K.shape_angle(rts[i], shapes[i], rts[j], shapes[j])
        label = complete_linkage(dist, angle)
        models = good.loc[[good.index[label == s][np.argmax(good[best].to_numpy()[label == s])] for s in np.unique(label)]]
        model_rt, model_x = models["rt_apex"].tolist(), models["rts"].tolist()
        model_y = [y / h for y, h in zip(models["ys"], models["height"], strict=True)]
        spectra: list[dict[float, float]] = [{} for _ in model_rt]
        for q in own.itertuples():
            inside = [i for i, t in enumerate(model_rt) if q.left <= t <= q.right]
            if not inside:
                continue
            axis = np.unique(np.concatenate([q.rts, *(model_x[i] for i in inside)]))
            a = np.stack([np.interp(axis, model_x[i], model_y[i], 0, 0) for i in inside], 1)
            for i, v in zip(inside, K.nnls(a, np.interp(axis, q.rts, q.ys / q.height, 0, 0)), strict=True):
                if v > 0:
                    spectra[i][q.mz] = spectra[i].get(q.mz, 0.0) + v * q.height
        rows = [(*key, i, model_rt[i], models["mz"].iloc[i], mz, v) for i, s in enumerate(spectra) for mz, v in sorted(s.items())]
        return pd.DataFrame(rows, columns=names)

    mass = peaks.schema["mz"].dataType.simpleString()
    schema = typed(peaks, *keys) + f", cluster long, of_cluster int, rt double, model_mz {mass}, mz {mass}, intensity double"
    found = kept(spread(clustered, *keys, "cluster").groupBy(*keys, "cluster").applyInPandas(one, schema))
    # clusters without a candidate, which have one row
    bare = found.filter("of_cluster < 0")
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("cluster", "of_cluster")) - 1
    result = [*keys, number.alias("component"), "rt", "model_mz", "mz", "intensity"]
    if bare.isEmpty():
        return found.select(*result)
    traces = peaks.join(bare.select(*keys).distinct(), keys, "left_semi").select(*keys, "mz", F.explode(F.arrays_zip("rts", "ys")).alias("p")).select(*keys, "mz", F.col("p.rts").alias("rt"), F.col("p.ys").alias("intensity"))
    direct = direct_spectrum(bare.select(*keys, F.col("cluster").alias("model"), "rt"), peaks, traces, keys)
    whole = bare.select(*keys, "cluster", "of_cluster", "rt", "model_mz").join(direct.select(*keys, F.col("model").alias("cluster"), "mz", "intensity"), [*keys, "cluster"])
    both = found.filter("of_cluster >= 0").unionByName(whole)
    return both.select(*result)


def assign_greedy(pairs: DataFrame, tolerance: float, on: list[str] | None = None) -> DataFrame:
    """One-to-one, nearest first (then strongest component, then ids); pairs: sample_id (or ``on``), peak, component, distance, total."""
    keys = on or ["sample_id"]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(weak=-p["total"]).sort_values(["distance", "weak", "peak", "component"])
        used_p, used_c, rows = set(), set(), []
        key = [p[k].iloc[0] for k in keys]
        for r in p.itertuples():
            if r.peak not in used_p and r.component not in used_c:
                used_p.add(r.peak)
                used_c.add(r.component)
                rows.append((*key, r.peak, r.component, r.distance))
        return pd.DataFrame(rows, columns=[*keys, "peak", "component", "distance"])

    schema = typed(pairs, *keys) + ", peak long, component long, distance double"
    return spread(pairs.filter(F.col("distance") <= tolerance), *keys).groupBy(*keys).applyInPandas(one, schema)


def match_optimal(truth: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """Least total distance one-to-one within ``most``: hits, misses (found null) and phantoms (truth null); sample_id, number, rt."""

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = a.sort_values(["rt", "number"]), b.sort_values(["rt", "number"])
        cost = np.abs(x["rt"].to_numpy()[:, None] - y["rt"].to_numpy()[None, :])
        pairs = [(i, j) for i, j in K.hungarian(np.where(cost <= most, cost, 1e6)) if cost[i, j] <= most] if len(x) and len(y) else []
        t, f = x["number"].tolist(), y["number"].tolist()
        rows = [(key[0], t[i], f[j], float(cost[i, j])) for i, j in pairs]
        hit, got = {i for i, _ in pairs}, {j for _, j in pairs}
        rows += [(key[0], t[i], None, None) for i in range(len(t)) if i not in hit] + [(key[0], None, f[j], None) for j in range(len(f)) if j not in got]
        return pd.DataFrame(rows, columns=["sample_id", "truth", "found", "distance"]).astype({"truth": "Int64", "found": "Int64", "distance": "Float64"})

    return truth.groupBy("sample_id").cogroup(found.groupBy("sample_id")).applyInPandas(one, own_ids("sample_id long, truth long, found long, distance double", truth))


def folded(samples: DataFrame, per_modulation: int) -> DataFrame:
    """A 1-D trace as a plane (``mod``, ``scan``); the incomplete last modulation goes."""
    n = F.count("*").over(Window.partitionBy("sample_id"))
    plane = samples.withColumn("mod", F.floor(F.col("seq") / per_modulation).cast("long")).withColumn("scan", F.pmod("seq", F.lit(per_modulation)).cast("long")).withColumn("__n", n)
    return plane.filter(F.col("mod") < F.floor(F.col("__n") / per_modulation)).drop("__n")


def rolled(plane: DataFrame, phase: int, per_modulation: int) -> DataFrame:
    """Scans turned round within each modulation."""
    return plane.withColumn("scan", F.pmod(F.col("scan") + phase, F.lit(per_modulation)))


def peaks_2d(plane: DataFrame, tolerance: int = 2, least: int = 2, prominence: float = 0.0) -> DataFrame:
    """Peaks of the plane: sub-peaks of each modulation, tracked over consecutive modulations, with volume and centre."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        active: list[dict] = []
        done: list[dict] = []
        last = None
        for mod, part in p.sort_values(["mod", "scan"]).groupby("mod"):
            y = part["y"].to_numpy()
            at = K.find_peaks(y, prominence=prominence)
            _, left, right = K.prominences(y, at)
            if last is not None and mod != last + 1:
                done += active
                active = []
            free, still = dict(enumerate(at.tolist())), []
            for g in active:
                k = min((k for k in free if abs(free[k] - g["scan"]) <= tolerance), key=lambda k: (abs(free[k] - g["scan"]), k), default=None)
                if k is None:
                    done.append(g)
                    continue
                g["scan"] = free.pop(k)
                g["rows"].append((mod, g["scan"], y[g["scan"]], np.trapezoid(y[left[k] : right[k] + 1])))
                still.append(g)
            active = still + [{"scan": s, "rows": [(mod, s, y[s], np.trapezoid(y[left[k] : right[k] + 1]))]} for k, s in free.items()]
            last = mod
        rows = []
        for g in done + active:
            if len(g["rows"]) >= least:
                r = np.array(g["rows"], float)
                top = int(np.argmax(r[:, 2]))
                centre = float((r[:, 0] * r[:, 2]).sum() / r[:, 2].sum()) if r[:, 2].sum() else float(r[top, 0])
                rows.append((p["sample_id"].iloc[0], centre, r[top, 1], float(r[:, 3].sum()), len(r), int(r[:, 0].min()), int(r[:, 0].max()), int(r[top, 0])))
        out = pd.DataFrame(rows, columns=["sample_id", "mod_centre", "apex_scan", "volume", "n_sub_peaks", "mod_start", "mod_end", "apex_mod"]).sort_values(["mod_centre", "apex_scan"])
        return out.assign(number=range(1, len(out) + 1))

    schema = "sample_id long, mod_centre double, apex_scan double, volume double, n_sub_peaks int, mod_start int, mod_end int, apex_mod int, number int"
    return spread(plane, "sample_id").groupBy("sample_id").applyInPandas(one, own_ids(schema, plane))


def volumes(plane: DataFrame, on: list[str]) -> DataFrame:
    """Volume (trapezoids within each modulation), intensity-weighted modulation and highest sample of each key; plane: mod, seq, y."""
    strip = (F.col("y") + F.lag("y").over(Window.partitionBy(*on, "mod").orderBy("seq"))) / 2
    held = plane.withColumn("__strip", strip)
    return held.groupBy(*on).agg(F.sum("__strip").alias("volume"), F.try_divide(F.sum(F.col("mod") * F.col("y")), F.sum("y")).alias("mod_centre"), F.max_by("seq", F.struct("y", -F.col("seq"))).alias("apex"))


def saturation(scans: DataFrame, on: list[str], scan: str, limit: float) -> DataFrame:
    """First scan whose highest ion reaches ``limit``, the last scan before it, and the highest level."""
    tops = scans.groupBy(*on, scan).agg(F.max("intensity").alias("__top"))
    first = tops.groupBy(*on).agg(F.min(F.when(F.col("__top") >= limit, F.col(scan))).alias("first_saturated"))
    return tops.join(first, on).groupBy(*on, "first_saturated").agg(F.max(F.when(F.col(scan) < F.col("first_saturated"), F.col(scan))).alias("use_scan"), F.max("__top").alias("level"))


def current_totals(scans: DataFrame, scan: str, trace: list[str]) -> DataFrame:
    """Total current of each scan as it is, corrected and of the baseline, which is the lowest value of each ion's trace."""
    held = scans.withColumn("__base", F.min("intensity").over(Window.partitionBy(*trace)))
    return held.groupBy(scan).agg(F.sum("intensity").alias("original"), F.sum(F.greatest(F.col("intensity") - F.col("__base"), F.lit(0.0))).alias("corrected"), F.sum("__base").alias("baseline"))


def ions_above(scans: DataFrame, on: list[str], least: float) -> DataFrame:
    """Distinct ions that reach ``least`` in some scan of their key."""
    return scans.filter(F.col("intensity") >= least).select(*on, "mz").distinct()
