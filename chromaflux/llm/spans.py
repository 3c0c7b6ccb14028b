"""Positions of regular-expression matches as plain DataFrame expressions.

Spark has no function that returns the places of all matches. ``split`` gives the text between the matches and
``regexp_extract_all`` the matches; their running lengths give each place in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span. ``rank`` orders kinds that start at the same place.
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
EMPTY = f"array<{SPAN}>"


def find(text: Column, kind: str, rank: int, gate: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of ``pattern`` in ``text`` (leftmost, non-overlapping), without those whose match isn't ``valid``.

    ``gate`` is a cheaper pattern without which there can be no valid match; texts that fail it are read once.
    """
    between = F.split(text, F.lit(pattern), -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))

    def placed(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b)
        span = lambda e, x: F.struct((e - F.length(x["hit"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["hit"].alias("value"))
        return F.filter(F.zip_with(ends, xs, span).cast(EMPTY), lambda s: valid(s["value"]))

    return F.coalesce(F.when(text.rlike(gate), let(steps, placed)), F.array().cast(EMPTY))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda any other expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` (associative) makes of each element and all before it, in as many passes as doubling takes to reach the length."""
    passes = F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def further(a: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= step, op(F.get(a, i - step), x)).otherwise(x))

    return F.aggregate(passes, xs, further)


#: Code points of a part of a text that holds many spans.
PART = 4096


def pieces(text: Column, cuts: Column) -> Column:
    """``text`` between ``cuts``, an array of (begin, end) in code points, rising and disjoint.

    A place in a string is found by counting from its start; with more than a few cuts the text is first cut into parts.
    """
    plain = F.transform(cuts, lambda c: F.substring(text, c["begin"] + 1, c["end"] - c["begin"]))

    def by_part(all_parts: Column) -> Column:
        def one(c: Column) -> Column:
            first, last = F.floor(c["begin"] / PART).cast("int"), F.floor(c["end"] / PART).cast("int")
            head, tail = F.coalesce(F.get(all_parts, first), F.lit("")), F.coalesce(F.get(all_parts, last), F.lit(""))
            within = F.substring(head, c["begin"] % PART + 1, c["end"] - c["begin"])
            middle = F.array_join(F.slice(all_parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            across = F.concat(F.substring(head, c["begin"] % PART + 1, F.lit(PART)), middle, F.substring(tail, F.lit(1), c["end"] % PART))
            return F.when(first == last, within).otherwise(across)

        return F.transform(cuts, one)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return F.when(F.size(cuts) <= 16, plain).otherwise(let(parts, by_part))


def ordered(*spans: Column) -> Column:
    """All spans by start, then by the rank of their kind."""
    return F.array_sort(F.concat(*spans))


def said(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
