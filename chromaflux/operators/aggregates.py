"""Areas, compositions, noise and reports as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import best_of, small
from .signal import spread
from .windows import over


def trapezoids(samples: DataFrame, on: list[str], x: str = "x", y: str | Column = "y", seq: str = "seq") -> DataFrame:
    """``samples`` with ``strip``, the area between each and the one before."""
    w = over(on, seq)
    value = F.col(y) if isinstance(y, str) else y
    held = samples.withColumn("__y", value)
    return held.withColumn("strip", (F.col(x) - F.lag(x).over(w)) * (F.col("__y") + F.lag("__y").over(w)) / 2).drop("__y")


def segment_area(samples: DataFrame, on: list[str]) -> DataFrame:
    """Area of what is above zero of each segment; areas under 1e-10 are dropped."""
    return trapezoids(samples, on, y=F.greatest(F.col("y"), F.lit(0.0))).groupBy(*on).agg(F.sum("strip").alias("area")).filter("area >= 1e-10")


def band_integrals(samples: DataFrame, bands: DataFrame, on: list[str]) -> DataFrame:
    """Per signal and band (seq, name, x_min, x_max): trapezoid area, highest value and its place; empty bands have area 0."""
    named = small(bands.withColumnRenamed("seq", "band"))
    listed = bands.agg(F.collect_list(F.struct(F.col("seq").alias("band"), *(c for c in bands.columns if c != "seq"))).alias("bands"))
    every = samples.select(*on).distinct().join(listed, F.lit(True)).select(*on, F.inline("bands"))  # keys times the method's few bands
    inside = samples.join(named, F.col("x").between(F.col("x_min"), F.col("x_max")))
    strips = trapezoids(inside, [*on, "name"])
    found = strips.groupBy(*on, "name").agg(F.abs(F.sum("strip")).alias("area"), F.max("y").alias("peak"), F.max_by("x", F.struct("y", -F.col("seq"))).alias("peak_x"), F.count("*").alias("points"))
    return every.join(found, [*on, "name"], "left").select(*on, "band", "name", F.coalesce("area", F.lit(0.0)).alias("area"), "peak", "peak_x", F.coalesce("points", F.lit(0)).alias("points"))


def peak_groups(peaks: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Peaks claimed by the first group (seq, g_low, g_high) that holds them are summed; the others stay; all renumbered. Equal peaks are separate ones."""
    table = groups.select("seq", "g_low", "g_high", F.struct("seq", "g_low", "g_high").alias("g"), F.lit("Group").alias("compound"))
    claimed = best_of(peaks, table, lambda t: (t["g_low"], t["g_high"]), lambda p, t: t["seq"], keep=("g",))
    grouped = claimed.filter("g is not null").groupBy(*on, "g").agg(F.sum("area").alias("area"), F.count("*").alias("members"))
    a = grouped.select(*on, F.col("g.g_low").alias("rt"), "area", "members", F.lit("Group").alias("compound_id"))
    b = claimed.filter("g is null").select(*on, "rt", "area", F.lit(1).cast("long").alias("members"), F.lit("peak").alias("compound_id"))
    both = a.unionByName(b)
    return both.withColumn("number", F.row_number().over(over(on, "rt", "area")))


def shares(rows: DataFrame, on: list[str], values: dict[str, str]) -> DataFrame:
    """Each value as a percentage of its total; nothing is written where any total is not positive."""
    w = Window.partitionBy(*on)
    held = rows
    for v in values:
        held = held.withColumn(f"__t_{v}", F.sum(v).over(w))
    ok = F.lit(True)
    for v in values:
        ok = ok & (F.col(f"__t_{v}") > 0)
    for v, name in values.items():
        held = held.withColumn(name, F.when(ok, 100 * F.col(v) / F.col(f"__t_{v}")))
    return held.drop(*(f"__t_{v}" for v in values))


def rolled_up(peaks: DataFrame, on: list[str], groups: list[str], value: str) -> DataFrame:
    """Sum of ``value`` by every group a row names (blank and ``0`` aside; a name twice counts twice), and a total row."""
    peaks = spread(peaks.select(*dict.fromkeys([*on, value, *groups])), *on)  # sums stay in as many tasks as the session shuffles to
    parts = peaks.select(*on, value, F.explode(F.array(*groups)).alias("group")).filter("group is not null and trim(group) <> '' and group <> '0'")
    by = parts.groupBy(*on, "group").agg(F.sum(value).alias(value))
    total = peaks.groupBy(*on).agg(F.sum(value).alias(value)).withColumn("group", F.lit("Total"))
    return by.unionByName(total)


def match_statistics(peaks: DataFrame, on: list[str]) -> DataFrame:
    area = F.sum("area")
    return peaks.groupBy(*on).agg(
        F.count("*").alias("peaks"),
        F.count_if("matched").alias("matched"),
        (100 * F.coalesce(F.sum(F.when(F.col("matched"), F.col("area"))), F.lit(0.0)) / F.when(area == 0, 1.0).otherwise(area)).alias("matched_area_percent"),
    )


def robust_noise(samples: DataFrame, on: list[str], y: str = "y", least: int = 20) -> DataFrame:
    """1.4826 x median absolute deviation of the samples under the lower quartile (of all, if there are ``least`` or fewer)."""
    q = samples.groupBy(*on).agg(F.percentile(y, F.lit(0.25)).alias("q"))
    low = samples.join(q, on).withColumn("low", F.col(y) < F.col("q"))
    use = low.withColumn("n", F.count_if("low").over(Window.partitionBy(*on))).filter((F.col("n") <= least) | F.col("low"))
    middle = use.groupBy(*on).agg(F.median(y).alias("m"))
    return use.join(middle, on).groupBy(*on).agg((1.4826 * F.median(F.abs(F.col(y) - F.col("m")))).alias("noise"))


def noise_floor(samples: DataFrame, on: list[str], y: str = "y", seq: str = "seq") -> DataFrame:
    """Three standard deviations of the lowest quarter (at least one) of the absolute values, 1e-10 at least."""
    held = samples.withColumn("a", F.abs(y)).withColumn("n", F.count("*").over(Window.partitionBy(*on)))
    low = held.withColumn("r", F.row_number().over(over(on, "a", seq))).filter(F.col("r") <= F.greatest(F.floor(F.col("n") / 4), F.lit(1)))
    return low.groupBy(*on).agg(F.greatest(3 * F.stddev_pop("a"), F.lit(1e-10)).alias("floor"))


def coherence(ions: DataFrame, on: list[str], ion: str, scan: str, value: str) -> DataFrame:
    """Mean correlation of all pairs of ions over the scans, and the share above 0.9; ions without variance don't count."""
    a = ions.select(*on, scan, F.col(ion).alias("i"), F.col(value).alias("u"))
    b = ions.select(*on, scan, F.col(ion).alias("j"), F.col(value).alias("v"))
    pairs = a.join(b, [*on, scan]).filter("i < j").groupBy(*on, "i", "j").agg(F.corr("u", "v").alias("r")).filter("r is not null and not isnan(r)")
    return pairs.groupBy(*on).agg(F.avg("r").alias("mean_r"), F.avg(F.when(F.col("r") > 0.9, 1.0).otherwise(0.0)).alias("share_high"), F.count("*").alias("pairs"))


def gap_tolerance(peaks: DataFrame, on: list[str], width: Column) -> DataFrame:
    """Half the median width, 0.3 where there are fewer than two peaks."""
    return peaks.groupBy(*on).agg(F.when(F.count("*") >= 2, 0.5 * F.median(width)).otherwise(0.3).alias("gap"))


def fit_quality(points: DataFrame, on: list[str], y: str, fitted: str, parameters: int = 3) -> DataFrame:
    """R² (of a constant signal: 1 if the fit is exact, else 0), AIC by n, and 1 - RMSE / standard deviation."""
    n, residual = F.count("*"), F.sum((F.col(y) - F.col(fitted)) * (F.col(y) - F.col(fitted)))
    total = F.var_pop(y) * n
    return points.groupBy(*on).agg(
        F.when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - residual / total).alias("r2"),
        F.when(residual > 0, (n * F.ln(residual / n) + 2 * parameters) / n).alias("aic"),
        F.when(total > 0, 1 - F.sqrt(residual / n) / F.stddev_pop(y)).alias("rmse_score"),
    )


def proportional_areas(curves: DataFrame, on: list[str]) -> DataFrame:
    """Area of each ``component``: its share of all curves at each x, times the signal above zero; x, curve, signal, seq."""
    w = Window.partitionBy(*on, "seq")
    shared = curves.withColumn("t", F.sum("curve").over(w))
    part = shared.withColumn("part", F.when(F.col("t") > 1e-12, F.col("curve") / F.col("t")).otherwise(0.0) * F.greatest(F.col("signal"), F.lit(0.0)))
    return trapezoids(part, [*on, "component"], y="part").groupBy(*on, "component").agg(F.sum("strip").alias("area"))


def confusion(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def detection_report(pairs: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Hits, misses, false alarms, precision, recall and F1."""
    hit, miss, false = F.count_if(truth & predicted), F.count_if(truth & ~predicted), F.count_if(~truth & predicted)
    return pairs.agg(
        hit.alias("hits"), miss.alias("misses"), false.alias("phantoms"),
        F.try_divide(hit, hit + false).alias("precision"), F.try_divide(hit, hit + miss).alias("recall"), F.try_divide(2 * hit, 2 * hit + miss + false).alias("f1"),
    )


def search_summary(rows: DataFrame, on: list[str], matched: Column, saturated: Column) -> DataFrame:
    """How many rows there are, how many matched and how many were saturated."""
    return rows.groupBy(*on).agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"), F.count_if(saturated).alias("saturated"))


def timing_report(rows: DataFrame, on: list[str], seconds: Column, optional: Column) -> DataFrame:
    """Files and mean seconds; the mean of an optional stage is over the files that went through it (not null)."""
    return rows.groupBy(*on).agg(F.count("*").alias("files"), F.avg(seconds).alias("mean_s"), F.avg(optional).alias("mean_optional_s"))


def skewness(rows: DataFrame, on: list[str], value: str) -> DataFrame:
    return rows.groupBy(*on).agg(F.skewness(value).alias("skew"))


def highest(rows: DataFrame, on: list[str], value: str, least: float) -> DataFrame:
    """Keys that reach ``least``, with their ``highest`` value."""
    return rows.groupBy(*on).agg(F.max(value).alias("highest")).filter(F.col("highest") >= least)
