"""Grids, interpolation and filters of signals and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ahead


def time_grid(samples: DataFrame, on: list[str], n: int) -> DataFrame:
    """``n`` even places over each key's range: ``i``, ``x``."""
    ends = samples.groupBy(*on).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*on, "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / max(n - 1, 1)).alias("x"))


def resampled(samples: DataFrame, grid: DataFrame, on: list[str], clamp: bool = False) -> DataFrame:
    """Linear interpolation of ``samples`` at the places of ``grid`` (``i``, ``x``); beyond the ends null, or the end if ``clamp``.

    Samples and grid are merged in order and each place sees the samples around it by window; no pairs are formed.
    """
    a = samples.select(*on, "x", F.col("y").alias("__y"), F.col("seq").cast("long").alias("__s"), F.lit(None).cast("int").alias("i"))
    g = grid.select(*on, "x", F.lit(None).cast("double").alias("__y"), F.lit(None).cast("long").alias("__s"), F.col("i").cast("int").alias("i"))
    known = F.when(F.col("i").isNull(), F.struct("x", F.col("__y").alias("y")))
    order = Window.partitionBy(*on).orderBy("x", F.col("i").isNotNull(), "__s")
    m = a.unionByName(g).withColumn("__k", known)
    m = m.withColumn("__b", F.last("__k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("__a", ahead(F.col("__k"), on, "x", F.col("i").isNull(), "__s", rows=0)).filter("i is not null")
    b, c = F.col("__b"), F.col("__a")
    lerp = F.when(b["x"] == c["x"], b["y"]).otherwise(b["y"] + (c["y"] - b["y"]) * (F.col("x") - b["x"]) / (c["x"] - b["x"]))
    outside = F.coalesce(b["y"], c["y"]) if clamp else F.lit(None).cast("double")
    return m.select(*on, "i", "x", F.when(b.isNull() | c.isNull(), outside).otherwise(lerp).alias("y"))


def interpolated(samples: DataFrame, on: list[str], n: int) -> DataFrame:
    """Each signal at ``n`` even places of its index, by an equi-join on the sample before and after."""
    held = samples.select(*on, "seq", "x", "y")
    size = held.groupBy(*on).agg(F.count("*").alias("__n"))
    p = size.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("p", F.col("i") * (F.col("__n") - 1) / max(n - 1, 1))
    p = p.withColumn("seq", F.floor("p").cast("long"))
    pair = held.withColumn("x2", F.lead("x").over(Window.partitionBy(*on).orderBy("seq"))).withColumn("y2", F.lead("y").over(Window.partitionBy(*on).orderBy("seq")))
    share = F.col("p") - F.floor("p")
    at = lambda u, v: F.col(u) + (F.coalesce(v, u) - F.col(u)) * share
    return p.join(pair, [*on, "seq"]).select(*on, "i", at("x", "x2").alias("x"), at("y", "y2").alias("y"))


def scaled(samples: DataFrame, on: list[str]) -> DataFrame:
    """``y`` between 0 and 1; a range of 1e-12 or less is all zero."""
    w = Window.partitionBy(*on)
    low, high = F.min("y").over(w), F.max("y").over(w)
    return samples.withColumn("y", F.when(high - low <= 1e-12, 0.0).otherwise((F.col("y") - low) / (high - low)))


def in_ranges(peaks: DataFrame, ranges: list[tuple[float, ...]], at: str = "rt") -> DataFrame:
    """Peaks inside any range; entries that are not pairs are ignored; no pair keeps all."""
    pairs = [r for r in ranges if len(r) == 2]
    keep = F.lit(not pairs)
    for a, b in pairs:
        keep = keep | F.col(at).between(a, b)
    return peaks.filter(keep)


def median_area_filter(peaks: DataFrame, on: list[str], fraction: float) -> DataFrame:
    middle = peaks.groupBy(*on).agg(F.median("area").alias("__m"))
    return peaks.join(middle, on).filter(F.col("area") >= fraction * F.col("__m")).drop("__m")


def shifted(rows: DataFrame, offset: float, x: str = "x") -> DataFrame:
    """The axis moved; a positive offset is later."""
    return rows.withColumn(x, F.col(x) + offset)


def axis_segments(samples: DataFrame, on: list[str], breaks: list[float], least: int = 10, x: str = "x") -> DataFrame:
    """Pieces of the axis between ``breaks``: number of samples, whether they are enough to be fitted, first and last of them."""
    at = F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(breaks))), lambda b: b <= F.col(x))) if breaks else F.lit(0)
    return samples.groupBy(*on, at.cast("long").alias("segment")).agg(F.count("*").alias("n"), (F.count("*") >= least).alias("fitted"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def positive_above(rows: DataFrame, on: list[str], value: str, fraction: float) -> DataFrame:
    """Values above zero and above ``fraction`` of their key's highest, which counts as 1 where it is not positive."""
    top = F.max(value).over(Window.partitionBy(*on))
    held = rows.withColumn("__top", top)
    return held.filter((F.col(value) > 0) & (F.col(value) > fraction * F.when(F.col("__top") <= 0, 1.0).otherwise(F.col("__top")))).drop("__top")


def report_fields(peaks: DataFrame, factor: Column, issues: Column) -> DataFrame:
    """A report's peaks: scaled absolute area, retention time to four places, issues as text."""
    from ..functions.scalars import scaled_area

    return peaks.withColumn("area", scaled_area(F.col("area"), factor)).withColumn("rt", F.round("rt", 4)).withColumn("quality", F.concat_ws(", ", issues))
