"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from chromaflux.functions import scalars as S
from chromaflux.operators import aggregates as A
from chromaflux.operators import joins as J
from chromaflux.operators import windows as W


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_carbon_count(spark):
    f = spark.createDataFrame([("C9H20",), ("CH3OH",), ("H2O",), ("HCl",), ("CaO",), ("CH3CH2OH",), (None,)], "f string")
    assert [r[0] for r in f.select(S.carbon_count(F.col("f"))).collect()] == [9, 1, None, 1, 1, 1, None]


def test_cas(spark):
    f = spark.createDataFrame([("71432",), ("",), (None,), ("1234567890",)], "f string")
    assert [r[0] for r in f.select(S.cas_format(F.col("f"))).collect()] == ["000071-43-2", "", "", "1234567-89-0"]
    g = spark.createDataFrame([("71-43-2 ",), ("x-1-2",), ("1-2",)], "f string")
    assert [tuple(r) for r in g.select(S.cas_pad(F.col("f")), S.cas_state(F.col("f"))).collect()] == [("000071-43-2", "valid"), ("x-1-2", "malformed"), ("1-2", "malformed")]


def test_windows_narrowest_wins_and_none_is_null(spark):
    t = spark.createDataFrame([(0, "wide", 1.0, 2.0, 3.0), (1, "narrow", 1.9, 2.0, 2.1)], "seq int, compound string, start double, apex double, end double")
    p = spark.createDataFrame([(1, 2.0), (2, 1.2), (3, 9.0), (3, 9.0)], "id int, rt double")
    assert values(J.match_window(p, t).select("id", "compound"), "id") == [(1, "narrow"), (2, "wide"), (3, None), (3, None)]
    assert values(J.match(p, t, 7).select("id", "compound"), "id")[0] == (1, None)
    assert values(J.match(p, t.limit(0), 0).select("id", "compound"), "id")[0] == (1, None)


def test_assign_priority(spark):
    p = spark.createDataFrame([("benzene", "x", "1-2-3", 5.0), ("Unknown (1.000)", "y", None, None), (None, None, "9", 1.0)], "compound_id string, compound string, casno string, qual double")
    assert sorted(map(tuple, J.assign(p).select("compound_id", "source", "available").collect()), key=str) == sorted([("benzene", None, "x"), ("y", "RT", None), (None, None, None)], key=str)
    assert {r.compound_id for r in J.assign(p, True).collect()} == {"x", "y", None}


def test_missing_anchor_and_keys_raise(spark):
    lib = spark.createDataFrame([("a",), ("b",), ("",)], "anchor string")
    with pytest.raises(ValueError, match="b"):
        J.require_anchors(lib, lib.filter("anchor = 'a'"))
    with pytest.raises(ValueError, match="only left"):
        J.require_same_keys(lib, lib.filter("anchor = 'a'"), "anchor")
    J.require_same_keys(lib, lib, "anchor")


def test_dilution_factor_raises(spark):
    with pytest.raises(Exception, match="sample mass"):
        spark.range(1).select(S.dilution_factor(F.lit(0.0), F.lit(1.0))).collect()


def test_nearest_scan_ties_go_to_the_first(spark):
    s = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 2.0), ("r", 2, 3.0)], "run string, scan int, rt double")
    t = spark.createDataFrame([("r", 1.5), ("r", 2.9), ("r", -4.0), ("r", 2.0)], "run string, at double")
    assert values(J.nearest_scan(t, s, ["run"], "at", "rt", "scan").select("at", "nearest_scan"), "at") == [(-4.0, 0), (1.5, 0), (2.0, 1), (2.9, 2)]


def test_plateau_and_islands(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 2.0, 2.0, 0.0, 5.0, 1.0])], "k string, seq int, y double")
    assert values(W.local_maxima(s, ["k"]).select("seq", "y"), "seq") == [(2, 2.0), (5, 5.0)]
    r = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 1.0, 2.0), ("a", 2, 10.5, 11.0), ("a", 3, 13.0, 14.0)], "k string, seq int, s double, e double")
    assert [x[0] for x in values(W.islands(r, ["k"], "s", "e", 1.0, "seq").select("island", "seq"), "seq")] == [1, 1, 1, 2]


def test_nan_fill_all_missing_is_zero(spark):
    s = spark.createDataFrame([("a", 0, None), ("a", 1, float("nan")), ("b", 0, None), ("b", 1, 3.0), ("b", 2, None)], "k string, seq int, y double")
    assert values(W.nan_filled(s, ["k"]).select("k", "seq", "y"), "k", "seq") == [("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 3.0), ("b", 1, 3.0), ("b", 2, 3.0)]


def test_shares_need_positive_totals(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -1.0)], "k string, v double")
    assert values(A.shares(p, ["k"], {"v": "p"}).select("k", "p"), "k", "p") == [("a", 25.0), ("a", 75.0), ("b", None)]


def test_groups_named_twice_count_twice(spark):
    p = spark.createDataFrame([("s", 2.0, "x", "x", "0"), ("s", 3.0, "y", "", None)], "k string, wt double, a string, b string, c string")
    assert values(A.rolled_up(p, ["k"], ["a", "b", "c"], "wt").select("group", "wt"), "group") == [("Total", 5.0), ("x", 4.0), ("y", 3.0)]
