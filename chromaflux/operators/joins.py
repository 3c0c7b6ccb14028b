"""Retention-time, library and interval joins.

Tables of windows, factors and compounds belong to a method and are small. Up to ``ARRAY_ROWS`` rows, which is checked, such
a table goes to every peak as one array and nothing is shuffled; larger ones meet the peaks by buckets of the axis in an
equi-join. Other small sides are broadcast only when their size in rows is checked (:func:`small`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SENTINEL_CAS, cas_pad, is_unassigned, unknown_label
from .windows import ahead

#: Rows up to which a method table is broadcast.
BROADCAST_ROWS = 100_000
#: Rows up to which a method table is looked through for each peak.
ARRAY_ROWS = 1_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, marked for broadcast if it really is small; ``limit`` keeps the check itself cheap."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def bucketed(points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, width: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a range join with an equi-join key ``bucket``: a point has one, a range all that it touches.

    For two large sides: the join then shuffles by bucket instead of comparing every pair.
    """
    cut = lambda c: F.floor(c / F.lit(width))
    return points.withColumn("bucket", cut(at)), ranges.withColumn("bucket", F.explode(F.sequence(cut(low), cut(high))))


def match_window(peaks: DataFrame, table: DataFrame, expansion: float = 0.0) -> DataFrame:
    """``peaks`` (with ``rt``) and the ``compound`` of the narrowest window that holds it; ties by ``seq``; none is null.

    ``table``: seq, compound, start, apex, end.
    """
    return best_of(peaks, table, lambda t: (t["start"] - expansion, t["end"] + expansion), lambda p, t: t["end"] - t["start"])


def match_apex(peaks: DataFrame, table: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The compound whose apex is nearest within ``tolerance``."""
    near = lambda p, t: F.abs(t["apex"] - p["rt"])
    return best_of(peaks, table, lambda t: _around(t["apex"], tolerance), near, lambda p, t: near(p, t) <= tolerance)


def _around(at: Column, reach: float) -> tuple[Column, Column]:
    """Bounds a little wider than ``reach``: rounding must not lose a peak that the exact condition then keeps."""
    slack = F.lit(reach) + 1e-9 * (F.abs(at) + reach)
    return at - slack, at + slack


def match_weighted(peaks: DataFrame, table: DataFrame, weights: tuple[float, float, float] = (0.25, 0.5, 0.25)) -> DataFrame:
    """The compound of least weighted distance to start, apex and end.

    Refused beyond all windows by more than min(max(mean width, 5 % of their range), 1), or where the peak lies outside the
    winner's window by more than 0.75 of its width.
    """
    guard = table.agg(F.min("start").alias("g_low"), F.max("end").alias("g_high"), F.avg(F.col("end") - F.col("start")).alias("g_width"))
    margin = F.least(F.greatest(F.col("g_width"), 0.05 * (F.col("g_high") - F.col("g_low"))), F.lit(1.0))
    limits = guard.select((F.col("g_low") - margin).alias("g_low"), (F.col("g_high") + margin).alias("g_high"))
    ws, wa, we = weights
    score = lambda p, t: ws * F.abs(t["start"] - p["rt"]) + wa * F.abs(t["apex"] - p["rt"]) + we * F.abs(t["end"] - p["rt"])
    inside = peaks.join(F.broadcast(limits), F.lit(True)).withColumn("g_in", F.col("rt").between(F.col("g_low"), F.col("g_high"))).drop("g_low", "g_high")
    heaviest = max((("start", ws), ("apex", wa), ("end", we)), key=lambda c: c[1])
    found = best_of(inside, table, None, score, lambda p, t: p["g_in"], keep=("start", "end"), bound=heaviest)
    outside = F.greatest(F.col("start") - F.col("rt"), F.col("rt") - F.col("end"), F.lit(0.0))
    accepted = outside <= 0.75 * (F.col("end") - F.col("start"))
    return found.withColumn("compound", F.when(accepted, F.col("compound"))).drop("start", "end", "g_in")


def best_of(peaks: DataFrame, table: DataFrame, span, cost, holds=None, keep: tuple[str, ...] = (), bound: tuple[str, float] | None = None) -> DataFrame:
    """Each peak with ``compound`` (and ``keep``) of the row of ``table`` of least ``cost`` that ``holds``, ties by ``seq``.

    ``span`` gives the bounds of rt that a row can serve; without it every row may serve every peak, and ``bound`` names a
    column and a weight: no cost is less than the weight times the column's distance from rt.
    """
    fields = ["compound", *keep]
    within = lambda p, t: p["rt"].between(*span(t)) if span else F.lit(True)
    fits = (lambda p, t: within(p, t) & holds(p, t)) if holds else within
    rank = lambda p, t: F.struct(cost(p, t).alias("cost"), t["seq"].alias("seq"), *(t[f].alias(f) for f in fields))
    if table.limit(ARRAY_ROWS + 1).count() <= ARRAY_ROWS:
        rows = table.agg(F.collect_list(F.struct(*table.columns)).alias("__table"))
        held = peaks.join(F.broadcast(rows), F.lit(True))  # one row
        best = F.array_min(F.transform(F.filter("__table", lambda t: fits(held, t)), lambda t: rank(held, t)))
        return held.withColumn("__best", best).select(*peaks.columns, *(F.col(f"__best.{f}").alias(f) for f in fields))
    numbered = peaks.withColumn("__id", F.monotonically_increasing_id())
    if span:
        numbered, t = (x.alias(n) for x, n in zip(bucketed(numbered, F.col("rt"), table, *span(table), _width(table, span)), ("p", "t"), strict=True))
        condition = F.col("p.bucket") == F.col("t.bucket")
    else:
        numbered, t = (x.alias(n) for x, n in zip(_reached(numbered, table, cost, *bound), ("p", "t"), strict=True))
        condition = F.col("p.bucket") == F.col("t.bucket")
    tc, pc = {c: F.col(f"t.{c}") for c in table.columns}, {c: F.col(f"p.{c}") for c in peaks.columns}
    joined = numbered.join(t, condition & fits(pc, tc), "left")
    best = F.min(F.when(tc["seq"].isNotNull(), rank(pc, tc))).alias("__best")
    picked = joined.groupBy("__id").agg(F.first(F.struct(*pc.values())).alias("__peak"), best)
    return picked.select("__peak.*", *(F.col(f"__best.{f}").alias(f) for f in fields))


def _reached(peaks: DataFrame, table: DataFrame, cost, column: str, weight: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``bucket`` that meets each peak with every row that can be its best.

    The axis of ``column`` has as many buckets as the table has rows. The row nearest to the middle of a peak's bucket gives
    a cost; a better row's ``column`` lies no further from the peak than that cost over the ``weight``, so the peak goes to the
    buckets within this reach.
    """
    facts = table.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).first()
    width = (facts["hi"] - facts["lo"]) / facts["n"] or 1.0
    place = lambda c: F.floor((c - F.lit(facts["lo"])) / F.lit(width))
    last = int((facts["hi"] - facts["lo"]) / width)
    spark = table.sparkSession
    # the axis is cut into stretches that are looked up on their own: a bucket's row, or the nearest bucket's that has one
    middles = spark.range(last + 1).select(F.col("id").alias("b"), (F.lit(facts["lo"]) + (F.col("id") + 0.5) * width).alias("x"))
    one = table.groupBy(place(F.col(column)).alias("b")).agg(F.min_by(F.struct(*table.columns), "seq").alias("r"))
    w = Window.orderBy("b")  # a row a bucket: no more than the method's table has
    held = middles.join(one, "b", "left").withColumn("before", F.last("r", ignorenulls=True).over(w)).withColumn("after", ahead(F.col("r"), [], "b", rows=0))
    near = held.select(F.col("b").alias("__b"), F.coalesce("before", "after").alias("__near"))
    own = peaks.withColumn("__b", F.least(F.greatest(place(F.col("rt")), F.lit(0)), F.lit(last)))
    known = own.join(small(near), "__b", "left")
    reach = cost(known, {c: known["__near"][c] for c in table.columns}) / F.lit(weight)
    slack = reach + 1e-9 * (F.abs("rt") + reach)  # rounding must not lose the best
    low, high = F.greatest(place(F.col("rt") - slack), F.lit(0)), F.least(place(F.col("rt") + slack), F.lit(last))
    # a peak of no place, or beyond all rows, still stays one row
    spread = known.withColumn("bucket", F.explode_outer(F.when(low <= high, F.sequence(low, high)))).drop("__b", "__near")
    return spread, table.withColumn("bucket", place(F.col(column)))


def _width(table: DataFrame, span) -> float:
    """A bucket as wide as the mean span of the table's rows."""
    low, high = span(table)
    return table.agg(F.avg(high - low)).first()[0] or 1.0


def match(peaks: DataFrame, table: DataFrame, mode: int, tolerance: float = 0.1, expansion: float = 0.0, weights=(0.25, 0.5, 0.25)) -> DataFrame:
    """Dispatch by mode: 0 window, 1 apex, 2 weighted; any other mode, or an empty table, matches nothing."""
    if mode not in (0, 1, 2):
        return peaks.withColumn("compound", F.lit(None).cast("string"))
    return (lambda: match_window(peaks, table, expansion), lambda: match_apex(peaks, table, tolerance), lambda: match_weighted(peaks, table, weights))[mode]()


def match_modes(peaks: DataFrame, table: DataFrame, modes: tuple[int, ...], tolerance: float = 0.1, expansion: float = 0.0, weights=(0.25, 0.5, 0.25)) -> DataFrame:
    """:func:`match` by each of ``modes``: a row for each peak and ``mode`` (long). The peaks are read and worked out once for all of them."""
    found, own = peaks, peaks.columns
    for k, mode in enumerate(modes):
        found = match(found, table, mode, tolerance, expansion, weights).withColumnRenamed("compound", f"__compound_{k}")
    each = F.array(*(F.struct(F.lit(mode).cast("long").alias("mode"), F.col(f"__compound_{k}").alias("compound")) for k, mode in enumerate(modes)))
    return found.select(*own, F.inline(each))


def assign(peaks: DataFrame, high_priority: bool = False) -> DataFrame:
    """Applies matches (``compound``) to ``compound_id``: always with priority, else only where nothing is assigned.

    An applied match clears ``casno`` and ``qual`` and says so in ``source``; one that was not is kept in ``available``.
    """
    free = F.lit(True) if high_priority else is_unassigned(F.col("compound_id"))
    use = F.col("compound").isNotNull() & free
    out = peaks.withColumn("source", F.when(use, "RT (priority)" if high_priority else "RT")).withColumn("available", F.when(~use, F.col("compound")))
    for c in ("casno", "qual"):
        if c in peaks.columns:
            out = out.withColumn(c, F.when(~use, F.col(c)))
    return out.withColumn("compound_id", F.when(use, F.col("compound")).otherwise(F.col("compound_id"))).drop("compound")


def identify(peaks: DataFrame, table: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Nearest apex strictly within ``tolerance``, else ``Unknown (rt)``."""
    near = lambda p, t: F.abs(t["apex"] - p["rt"])
    found = best_of(peaks, table, lambda t: _around(t["apex"], tolerance), near, lambda p, t: near(p, t) < tolerance)
    return found.withColumn("compound", F.coalesce("compound", unknown_label(F.col("rt"))))


def library_lookup(peaks: DataFrame, library: DataFrame, record: list[str]) -> DataFrame:
    """Joins ``record`` columns by registry number, then exact name, then name in lower case; the last duplicate wins.

    ``peaks`` has casno and name, ``library`` seq, casno, name. The sentinel number is never looked up.
    """
    def last(key: Column, rows: DataFrame, name: str) -> DataFrame:
        kept = rows.withColumn("__k", key).filter("__k is not null and __k <> ''")
        return kept.groupBy("__k").agg(F.max_by(F.struct(*record), "seq").alias(name)).withColumnRenamed("__k", f"{name}_k")

    by_cas = last(cas_pad(F.col("casno")), library.filter(cas_pad(F.col("casno")) != SENTINEL_CAS), "r_cas")
    by_name = last(F.col("name"), library, "r_name")
    by_lower = last(F.lower("name"), library, "r_lower")
    out = (
        peaks.join(by_cas, cas_pad(peaks["casno"]) == F.col("r_cas_k"), "left")
        .join(by_name, peaks["name"] == F.col("r_name_k"), "left")
        .join(by_lower, F.lower(peaks["name"]) == F.col("r_lower_k"), "left")
    )
    found = F.coalesce("r_cas", "r_name", "r_lower")
    return out.select(*peaks.columns, *(found[c].alias(f"lib_{c}") for c in record), found.isNotNull().alias("matched"))


def missing_anchors(library: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors that the library names and the calibration lacks, and how often."""
    named = library.filter("trim(coalesce(anchor, '')) <> ''")
    return named.join(anchors.select("anchor").distinct(), "anchor", "left_anti").groupBy("anchor").agg(F.count("*").alias("n"))


def require_anchors(library: DataFrame, anchors: DataFrame) -> None:
    """Raises, with counts, if the library names anchors that the calibration lacks."""
    missing = missing_anchors(library, anchors).orderBy("anchor").limit(21).collect()
    if missing:
        raise ValueError("anchors without calibration: " + ", ".join(f"{r['anchor']} ({r['n']})" for r in missing[:20]) + (" ..." if len(missing) > 20 else ""))


def deduplicated_lookup(rows: DataFrame, table: DataFrame, key: str, seq: str, values: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``key`` with ``table``'s last row of each key."""
    last = table.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("__v"))
    return rows.join(last, key, how).select(*rows.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def override_interval(peaks: DataFrame, overrides: DataFrame, tolerance: float = 0.05, similarity=None, least: float = 0.7) -> DataFrame:
    """The first override (``seq``, ``override_rt``, ``compound``) within ``tolerance`` of a peak and, if given, alike enough.

    ``similarity``: a function of (peak, override) columns; where it is null the spectra don't decide.
    """
    holds = lambda p, t: F.abs(p["rt"] - t["override_rt"]) <= tolerance
    both = (lambda p, t: holds(p, t) & (F.coalesce(similarity(p, t), F.lit(1.0)) >= least)) if similarity else holds
    found = best_of(peaks, overrides, lambda t: _around(t["override_rt"], tolerance), lambda p, t: t["seq"], both)
    return found.withColumn("manual_assignment", F.col("compound").isNotNull()).withColumnRenamed("compound", "manual_compound").select(*peaks.columns, "manual_compound", "manual_assignment")


def across(rows: DataFrame, on: list[str], run: str, x: str, tolerance: float) -> DataFrame:
    """Rows of two runs (``run`` < ``other``) with equal keys and ``x`` within ``tolerance``.

    Both sides meet by the keys and a bucket of ``x`` as wide as the tolerance, so a key that many rows share is split along
    the axis; a row is sent to three buckets on one side only.
    """
    cut = F.floor(F.col(x) / F.lit(tolerance))
    a = rows.withColumn("__b", cut)
    b = rows.select(*on, F.col(run).alias("other"), F.col(x).alias("__x"), F.explode(F.sequence(cut - 1, cut + 1)).alias("__b"))
    near = (F.col(run) < F.col("other")) & (F.abs(F.col(x) - F.col("__x")) <= tolerance)
    return a.join(b, [*on, "__b"]).filter(near).drop("__b", "__x")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, on: list[str], how: str = "inner", whole: bool = False, width: float | None = None) -> DataFrame:
    """Points within intervals of the same keys ``on``; an equi-join, so both sides may be large.

    On an axis of whole numbers (``whole``) an interval meets its points place by place: what is compared is what comes out.
    Else both meet in buckets of ``width``, the mean length of the intervals if not given, so that a key with many points
    and intervals is no product of the two.
    """
    rest = [c for c in intervals.columns if c not in on]
    i = intervals.select(*(F.col(k).alias(f"__{k}") for k in on), *rest)
    condition = F.lit(True)
    for k in on:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    if whole:
        i = i.withColumn("__at", F.explode(F.when(F.col(low) <= F.col(high), F.sequence(F.col(low).cast("long"), F.col(high).cast("long")))))
        condition = condition & (F.col(at) == F.col("__at"))
    else:
        size = F.lit(width or intervals.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1.0)
        cut = lambda c: F.floor(F.col(c) / size)
        i = i.withColumn("__at", F.explode(F.when(F.col(low) <= F.col(high), F.sequence(cut(low), cut(high)))))
        condition = condition & (cut(at) == F.col("__at")) & F.col(at).between(F.col(low), F.col(high))
    joined = points.join(i, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("__at", *(f"__{k}" for k in on))


def nearest_scan(targets: DataFrame, scans: DataFrame, on: list[str], target: str, axis: str, scan: str) -> DataFrame:
    """For each target the scan nearest on the axis, the first of equals.

    Both sides are merged on the axis and looked up by window (the last scan before, the next one after): no pair is formed.
    """
    left = targets.select(*on, F.col(target).alias("__x"), F.lit(None).cast("long").alias("__scan"), F.struct(*targets.columns).alias("__t"))
    right = scans.select(*on, F.col(axis).alias("__x"), F.col(scan).cast("long").alias("__scan"), F.lit(None).cast(left.schema["__t"].dataType).alias("__t"))
    both = left.unionByName(right)
    order = Window.partitionBy(*on).orderBy("__x", F.col("__scan").isNull())
    hit = F.when(F.col("__scan").isNotNull(), F.struct(F.col("__x").alias("x"), F.col("__scan").alias("scan")))
    # of equal scans at the same place the first counts: rank them first
    first = F.row_number().over(Window.partitionBy(*on, "__x", F.col("__scan").isNull()).orderBy("__scan"))
    marked = both.withColumn("__first", first).withColumn("__hit", F.when(F.col("__first") == 1, hit))
    before = F.last("__hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = ahead(F.col("__hit"), on, "__x", F.col("__scan").isNull(), rows=0)
    near = marked.withColumn("__b", before).withColumn("__a", after).filter("__t is not null")
    x = F.col("__x")
    down, up = F.abs(x - F.col("__b.x")), F.abs(F.col("__a.x") - x)
    pick = F.when(F.col("__a").isNull() | (down < up), F.col("__b")).when(F.col("__b").isNull() | (up < down), F.col("__a")).when(F.col("__b.scan") <= F.col("__a.scan"), F.col("__b")).otherwise(F.col("__a"))
    return near.withColumn("__p", pick).select("__t.*", F.col("__p.scan").alias("nearest_scan"), F.col("__p.x").alias("nearest_x"))


def hybrid(classical: DataFrame, components: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Peaks outside the split windows and components, numbered by retention time within each key."""
    outside = classical.join(windows, [classical[k] == windows[k] for k in on] + [classical["rt"].between(windows["w_low"], windows["w_high"])], "left_anti")
    both = outside.withColumn("origin", F.lit("classical")).unionByName(components.withColumn("origin", F.lit("component")), allowMissingColumns=True)
    return both.withColumn("number", F.row_number().over(Window.partitionBy(*on).orderBy("rt", "origin", "area")))


def require_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises with both differences if the two tables don't have the same keys."""
    left, right = a.select(F.col(key).alias("k")).distinct(), b.select(F.col(key).alias("k")).distinct()
    only_a = [r.k for r in left.join(right, "k", "left_anti").orderBy("k").limit(20).collect()]
    only_b = [r.k for r in right.join(left, "k", "left_anti").orderBy("k").limit(20).collect()]
    if only_a or only_b:
        raise ValueError(f"keys differ: only left {only_a}, only right {only_b}")
