"""Queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import quant as Q
from ..operators import spectra as M
from ..operators import windows as W
from ..operators.signal import spread
from .adapters import PEAKS, RT_TABLE, SIGNALS, SPECTRA, peaks, rt_table, signals, spectra, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- quantitation -----------------------------------------------------------------------------------------------------


@query(f"""WITH {PEAKS}, f AS (SELECT p_partkey AS part, p_retailprice AS rf FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT p.*, CASE WHEN rf IS NULL THEN NULL WHEN rf = 0 THEN 0 ELSE area / rf END AS raw FROM peaks p LEFT JOIN f USING (part)),
t AS (SELECT *, sum(raw) OVER (PARTITION BY sample_id) AS total FROM j)
SELECT sample_id, peak_number, round(raw, 6) AS raw_amount, round(CASE WHEN raw IS NULL THEN NULL WHEN total = 0 THEN 0 ELSE 100 * raw / total END, 6) AS composition_percent FROM t""")
def rf_composition(spark, d):
    factors = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("compound"), F.col("p_retailprice").alias("response_factor"))
    found = Q.by_response_factor(peaks(spark, d).withColumn("compound", F.col("part").cast("string")), factors, ["sample_id"], "area_per_mass")
    return found.select("sample_id", "peak_number", *r6("raw_amount", "composition_percent"))


IS_SQL = f"""WITH {PEAKS}, c AS (SELECT p_partkey AS part, p_partkey % 12 + 1 AS nc, 12.0 + p_size * 3 AS mw, p_partkey % 7 = 0 AS std FROM part),
j AS (SELECT p.*, nc, mw, std FROM peaks p JOIN c USING (part)),
s AS (SELECT sample_id, arg_min(area, peak_number) AS is_area, arg_min(10 * 1e-3 * 0.73 / mw * nc, peak_number) AS is_molc FROM j WHERE std GROUP BY 1),
q AS (SELECT j.*, CASE WHEN is_area > 0 AND is_molc > 0 THEN is_area / is_molc END AS rf FROM j LEFT JOIN s USING (sample_id)),
m AS (SELECT *, area / rf AS mol_c, area / rf / nc AS mol, area / rf / nc * mw * 1000 AS mass_mg FROM q)"""


@query(IS_SQL + """, t AS (SELECT *, sum(CASE WHEN NOT std THEN mol_c END) OVER w AS tc, sum(CASE WHEN NOT std THEN mol END) OVER w AS tm, sum(CASE WHEN NOT std THEN mass_mg END) OVER w AS tg FROM m WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, peak_number, round(mol_c, 9) AS mol_c, round(mass_mg, 6) AS mass_mg,
round(CASE WHEN NOT std AND tc > 0 AND tm > 0 AND tg > 0 THEN 100 * mol_c / tc END, 6) AS mol_c_percent, round(CASE WHEN NOT std AND tc > 0 AND tm > 0 AND tg > 0 THEN 100 * mass_mg / tg END, 6) AS wt_percent FROM t""")
def is_quantitation(spark, d):
    p = table(spark, d, "part")
    compounds = p.select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("part"), F.concat(F.lit("C"), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit("H4")).alias("formula"), (12.0 + F.col("p_size") * 3).alias("mw"))
    named = peaks(spark, d).withColumn("compound", F.when(F.col("part") % 7 == 0, F.lit(" Decane ")).otherwise(F.col("part").cast("string")))
    held = named.withColumn("key", F.col("part"))
    looked = J.deduplicated_lookup(held, compounds.withColumnRenamed("part", "key"), "key", "seq", ["formula", "mw"])
    # the standard's peaks keep their own formula here, so the lookup by compound is by a key that is unique per part
    ids = looked.withColumn("compound", F.when(F.col("part") % 7 == 0, F.lit("decane")).otherwise(F.col("compound")))
    out = Q.by_internal_standard_known(ids, ["sample_id"], "Decane", 10.0, 0.73)
    return out.select("sample_id", "peak_number", F.round("mol_c", 9).alias("mol_c"), *r6("mass_mg", "mol_c_percent", "wt_percent"))


BROADCAST_SQL = f"""WITH {PEAKS}, lib AS (SELECT p_partkey AS part, (p_partkey % 11)::DOUBLE AS c, 16.0 + p_size AS mw, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS anchor, p_brand, p_type, p_name FROM part WHERE p_partkey % 5 <> 0),
anc AS (SELECT * FROM (VALUES ('a', 6.0, 78.0, 0.04, 28848616.5), ('b', 7.0, 92.0, 0.05, 30000000.0)) t(anchor, ca, mwa, wt, aarea)),
smp AS (SELECT o_orderkey AS sample_id, 0.05 + o_orderkey % 10 * 0.01 AS sm, 0.7 AS sv FROM orders),
b AS (SELECT p.sample_id, peak_number, area, part, p_brand, p_type, p_name, coalesce(c > 0, false) AS matched,
 CASE WHEN c > 0 THEN wt / aarea * (ca / c) * (mw / mwa) END AS rf, c, mw, sm, sv FROM peaks p LEFT JOIN lib USING (part) LEFT JOIN anc USING (anchor) LEFT JOIN smp USING (sample_id)),
q AS (SELECT *, greatest(area, 0) * rf * ((sm + sv) / sm) AS wt_percent FROM b)"""


def _broadcast(spark, d):
    lib = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("compound"), (F.col("p_partkey") % 11).cast("double").alias("c"), (16.0 + F.col("p_size")).alias("mw"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("anchor"))
    anchors = spark.createDataFrame([(0, "a", 6.0, 78.0, 0.04, 28848616.5), (1, "b", 7.0, 92.0, 0.05, 30000000.0)], "seq int, anchor string, c double, mw double, known_wt_pct double, area double")
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (0.05 + F.col("o_orderkey") % 10 * 0.01).alias("sample_mass_g"), F.lit(0.7).alias("solvent_mass_g"))
    return Q.broadcast_factors(peaks(spark, d).withColumn("compound", F.col("part").cast("string")), lib, anchors, samples)


@query(BROADCAST_SQL + """ SELECT sample_id, peak_number, matched, round(wt_percent, 6) AS wt_percent, round(wt_percent / 100 * sm * 1000, 6) AS mass_mg,
round(wt_percent / 100 * sm / mw * c, 9) AS mol_c FROM q""")
def broadcast_quant(spark, d):
    return _broadcast(spark, d).select("sample_id", "peak_number", "matched", *r6("wt_percent", "mass_mg"), F.round("mol_c", 9).alias("mol_c"))


@query(BROADCAST_SQL + """, g AS (SELECT sample_id, wt_percent, unnest([p_brand, p_type, p_name]) AS "group" FROM q WHERE matched)
SELECT sample_id, "group", round(sum(wt_percent), 6) AS wt_percent FROM g WHERE "group" IS NOT NULL GROUP BY ALL
UNION ALL SELECT sample_id, 'Total', round(sum(wt_percent), 6) FROM q WHERE matched GROUP BY 1""")
def group_rollup(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand", "p_type", "p_name")
    held = _broadcast(spark, d).filter("matched").join(names, "part")
    return A.rolled_up(held, ["sample_id"], ["p_brand", "p_type", "p_name"], "wt_percent").select("sample_id", "group", *r6("wt_percent"))


@query(BROADCAST_SQL + """ SELECT sample_id, count(*) AS peaks, count(*) FILTER (WHERE matched) AS matched, round(100 * coalesce(sum(area) FILTER (WHERE matched), 0) / CASE WHEN sum(area) = 0 THEN 1 ELSE sum(area) END, 6) AS matched_area_percent FROM q GROUP BY 1""")
def match_stats(spark, d):
    return A.match_statistics(_broadcast(spark, d), ["sample_id"]).select("sample_id", "peaks", "matched", *r6("matched_area_percent"))


@query("""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '000000-00-0' WHEN 1 THEN '' WHEN 2 THEN 'abc-1-2' WHEN 3 THEN '71-43-2' WHEN 4 THEN '0-00-0' ELSE '1-2' END AS cas, c_custkey % 4 = 0 AS rec FROM customer)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rec THEN NULL WHEN cas IN ('abc-1-2', '1-2') THEN 'malformed_cas' WHEN cas IN ('000000-00-0', '0-00-0') THEN 'sentinel_cas' WHEN cas = '' THEN 'no_record' ELSE 'no_cas_match' END AS reason FROM c) GROUP BY 1""")
def unmatched_reasons(spark, d):
    k = F.col("c_custkey") % 6
    cas = F.when(k == 0, "000000-00-0").when(k == 1, "").when(k == 2, "abc-1-2").when(k == 3, "71-43-2").when(k == 4, "0-00-0").otherwise("1-2")
    return table(spark, d, "customer").select(S.unmatched_reason(cas, F.col("c_custkey") % 4 == 0).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(BROADCAST_SQL + """ SELECT coalesce(p_type, 'none') AS kind, round(sum(CASE WHEN sample_id % 3 = 0 THEN coalesce(wt_percent, 0) ELSE 0 END), 6) AS s0, round(sum(CASE WHEN sample_id % 3 = 1 THEN coalesce(wt_percent, 0) ELSE 0 END), 6) AS s1, round(sum(CASE WHEN sample_id % 3 = 2 THEN coalesce(wt_percent, 0) ELSE 0 END), 6) AS s2 FROM q GROUP BY 1""")
def weights_pivot(spark, d):
    names = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("part"), "p_type")
    held = _broadcast(spark, d).join(names, "part", "left").withColumn("kind", F.coalesce("p_type", F.lit("none"))).withColumn("s", F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string")))
    out = held.groupBy("kind").pivot("s", ["s0", "s1", "s2"]).agg(F.sum(F.coalesce("wt_percent", F.lit(0.0)))).na.fill(0.0)
    return out.select("kind", *r6("s0", "s1", "s2"))


# --- retention-time matching ------------------------------------------------------------------------------------------

RT_PEAKS = f"WITH {PEAKS}, {RT_TABLE}, p AS (SELECT sample_id, peak_number, rt + 0.125 AS rt FROM peaks)"


def _rt_peaks(spark, d):
    return peaks(spark, d).select("sample_id", "peak_number", (F.col("rt") + 0.125).alias("rt"))


@query(RT_PEAKS + """ SELECT sample_id, peak_number, arg_min(compound, (("end" - start) * 1e6 + seq)) AS compound FROM p LEFT JOIN rt_table ON rt BETWEEN start AND "end" GROUP BY ALL""")
def rt_window(spark, d):
    return J.match_window(_rt_peaks(spark, d), rt_table(spark, d)).select("sample_id", "peak_number", "compound")


@query(RT_PEAKS + """ SELECT sample_id, peak_number, arg_min(compound, abs(apex - rt) * 1e6 + seq) AS compound FROM p LEFT JOIN rt_table ON abs(apex - rt) <= 0.5 GROUP BY ALL""")
def rt_closest(spark, d):
    return J.match_apex(_rt_peaks(spark, d), rt_table(spark, d), 0.5).select("sample_id", "peak_number", "compound")


@query(RT_PEAKS + """, g AS (SELECT min(start) AS lo, max("end") AS hi, least(greatest(avg("end" - start), 0.05 * (max("end") - min(start))), 1.0) AS m FROM rt_table),
b AS (SELECT sample_id, peak_number, rt, arg_min(struct_pack(c := compound, s := start, e := "end"), (0.25 * abs(start - rt) + 0.5 * abs(apex - rt) + 0.25 * abs("end" - rt)) * 1e6 + seq) AS t FROM p LEFT JOIN rt_table ON (SELECT rt BETWEEN lo - m AND hi + m FROM g) GROUP BY ALL)
SELECT sample_id, peak_number, CASE WHEN greatest(t.s - rt, rt - t.e, 0) <= 0.75 * (t.e - t.s) THEN t.c END AS compound FROM b""")
def rt_weighted(spark, d):
    return J.match_weighted(_rt_peaks(spark, d), rt_table(spark, d)).select("sample_id", "peak_number", "compound")


@query(RT_PEAKS + """, m AS (SELECT sample_id, peak_number, arg_min(compound, (("end" - start) * 1e6 + seq)) AS compound FROM p LEFT JOIN rt_table ON rt BETWEEN start AND "end" GROUP BY ALL),
a AS (SELECT *, CASE peak_number % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown (1.250)' WHEN 2 THEN 'benzene' ELSE 'unknown' END AS old FROM m)
SELECT sample_id, peak_number, CASE WHEN compound IS NOT NULL AND peak_number % 4 <> 2 THEN compound ELSE old END AS compound_id, CASE WHEN compound IS NOT NULL AND peak_number % 4 <> 2 THEN 'RT' END AS source,
CASE WHEN peak_number % 4 = 2 THEN compound END AS available FROM a""")
def rt_assign(spark, d):
    k = F.col("peak_number") % 4
    old = F.when(k == 0, None).when(k == 1, "Unknown (1.250)").when(k == 2, "benzene").otherwise("unknown")
    return J.assign(J.match_window(_rt_peaks(spark, d), rt_table(spark, d)).withColumn("compound_id", old)).select("sample_id", "peak_number", "compound_id", "source", "available")


@query(RT_PEAKS + """ SELECT sample_id, peak_number, coalesce(arg_min(compound, abs(apex - rt) * 1e6 + seq), printf('Unknown (%.3f)', rt)) AS compound FROM p LEFT JOIN rt_table ON abs(apex - rt) < 0.3 GROUP BY sample_id, peak_number, rt""")
def identify_tolerance(spark, d):
    return J.identify(_rt_peaks(spark, d), rt_table(spark, d), 0.3).select("sample_id", "peak_number", "compound")


@query(RT_PEAKS + """, o AS (SELECT n_nationkey AS seq, n_nationkey * 2 + 0.15 AS ort, n_name AS c FROM nation)
SELECT sample_id, peak_number, arg_min(c, seq) AS manual_compound, count(c) > 0 AS manual_assignment FROM p LEFT JOIN o ON abs(rt - ort) <= 0.05 GROUP BY ALL""")
def manual_override(spark, d):
    o = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), (F.col("n_nationkey") * 2 + 0.15).alias("override_rt"), F.col("n_name").alias("compound"))
    return J.override_interval(_rt_peaks(spark, d), o).select("sample_id", "peak_number", "manual_compound", "manual_assignment")


@query("""WITH l AS (SELECT l_suppkey AS s, l_partkey AS part, l_quantity AS q, l_linenumber AS n FROM lineitem),
lib AS (SELECT p_partkey AS seq, printf('%d-%02d-1', p_partkey, p_size) AS cas, p_name AS name FROM part),
c AS (SELECT cas AS k, max(seq) AS r FROM lib GROUP BY 1), n AS (SELECT name AS k, max(seq) AS r FROM lib GROUP BY 1)
SELECT s, part, q, n, coalesce(c.r, n1.r, n2.r) AS lib_seq FROM (SELECT l.*, CASE WHEN part % 3 = 0 THEN printf('%d-%02d-1', part, p_size) ELSE 'none' END AS cas, CASE WHEN part % 3 = 1 THEN p_name WHEN part % 3 = 2 THEN upper(p_name) END AS nm FROM l JOIN part ON part = p_partkey) x
LEFT JOIN c ON x.cas = c.k LEFT JOIN n n1 ON x.nm = n1.k LEFT JOIN n n2 ON lower(x.nm) = n2.k""")
def library_lookup(spark, d):
    p = table(spark, d, "part")
    cas = F.format_string("%d-%02d-1", "p_partkey", "p_size")
    lib = p.select(F.col("p_partkey").alias("seq"), cas.alias("casno"), F.col("p_name").alias("name"))
    k = F.col("l_partkey") % 3
    q = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    q = q.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("n"), F.when(k == 0, cas).otherwise("none").alias("casno"), F.when(k == 1, F.col("p_name")).when(k == 2, F.upper("p_name")).alias("name"))
    return J.library_lookup(q, lib, ["seq"]).select("s", "part", "q", "n", "lib_seq")


# --- signals: windows -------------------------------------------------------------------------------------------------


@query(f"""WITH {SIGNALS}, c AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR lag(y) OVER w <> y THEN 1 ELSE 0 END AS f FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq)),
r AS (SELECT sample_id, sum(f) OVER (PARTITION BY sample_id ORDER BY seq) AS run, seq, y FROM c), g AS (SELECT sample_id, run, any_value(y) AS y, min(seq) AS a, max(seq) AS b FROM r GROUP BY ALL),
t AS (SELECT *, y > lag(y) OVER w AND y > lead(y) OVER w AS top FROM g WINDOW w AS (PARTITION BY sample_id ORDER BY run))
SELECT sample_id, ((a + b) // 2)::BIGINT AS seq, y FROM t WHERE top""")
def local_maxima(spark, d):
    return W.local_maxima(signals(spark, d), ["sample_id"])


MAXIMA = SQL["local_maxima"].replace("\nSELECT sample_id, ((a", ", apex AS (SELECT sample_id, ((a") + ")"


@query(MAXIMA + """, n AS (SELECT sample_id, seq AS apex, lead(seq) OVER (PARTITION BY sample_id ORDER BY seq) AS next_apex FROM apex)
SELECT n.sample_id, apex, next_apex, arg_min(s.seq, s.y * 1e6 + s.seq) AS valley FROM n JOIN signals s ON s.sample_id = n.sample_id AND s.seq > apex AND s.seq < next_apex GROUP BY ALL""")
def valley_bounds(spark, d):
    s = signals(spark, d)
    return W.valleys(s, W.local_maxima(s, ["sample_id"]), ["sample_id"])


@query(MAXIMA + """ SELECT a.sample_id, a.seq AS apex, coalesce(max(s.seq) FILTER (WHERE s.seq < a.seq AND s.y <= 0.1 * a.y), a.seq) AS "left", coalesce(min(s.seq) FILTER (WHERE s.seq > a.seq AND s.y <= 0.1 * a.y), a.seq) AS "right" FROM apex a JOIN signals s USING (sample_id) GROUP BY a.sample_id, a.seq""")
def bound_walk(spark, d):
    s = signals(spark, d)
    return W.bound_walk(s, W.local_maxima(s, ["sample_id"]), ["sample_id"], 0.1)


@query(MAXIMA + """, b AS (SELECT a.sample_id, a.seq AS apex, coalesce(max(s.seq) FILTER (WHERE s.seq < a.seq AND s.y <= 0.1 * a.y), a.seq) AS l, coalesce(min(s.seq) FILTER (WHERE s.seq > a.seq AND s.y <= 0.1 * a.y), a.seq) AS r FROM apex a JOIN signals s USING (sample_id) GROUP BY a.sample_id, a.seq),
n AS (SELECT *, lag(apex) OVER w AS p, lead(apex) OVER w AS q FROM b WINDOW w AS (PARTITION BY sample_id ORDER BY apex))
SELECT sample_id, apex, CASE WHEN l <= p THEN (p + apex) // 2 ELSE l END::BIGINT AS "left", CASE WHEN r >= q THEN (q + apex) // 2 ELSE r END::BIGINT AS "right" FROM n""")
def neighbour_clamp(spark, d):
    s = signals(spark, d)
    return W.neighbour_clamp(W.bound_walk(s, W.local_maxima(s, ["sample_id"]), ["sample_id"], 0.1), ["sample_id"])


@query(f"""WITH {SIGNALS}, w AS (SELECT *, x - lag(x) OVER v AS a, lead(x) OVER v - x AS b, lag(y) OVER v AS y0, lead(y) OVER v AS y2 FROM signals WINDOW v AS (PARTITION BY sample_id ORDER BY seq))
SELECT sample_id, seq, round(CASE WHEN a IS NULL THEN (y2 - y) / b WHEN b IS NULL THEN (y - y0) / a ELSE (a*a*y2 + (b*b - a*a)*y - b*b*y0) / (a*b*(a+b)) END, 6) AS gradient FROM w""")
def gradient(spark, d):
    return W.gradient(signals(spark, d), ["sample_id"]).select("sample_id", "seq", *r6("gradient"))


@query(f"""WITH {SIGNALS} SELECT sample_id, seq, round((-3*lag(y,2) OVER w + 12*lag(y) OVER w + 17*y + 12*lead(y) OVER w - 3*lead(y,2) OVER w) / 35, 6) AS smooth FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq)""")
def sg_smooth_interior(spark, d):
    return W.weighted_window(signals(spark, d), ["sample_id"], [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]).select("sample_id", "seq", *r6("smooth"))


@query(f"""WITH {SIGNALS} SELECT sample_id, seq, list_sort([coalesce(lag(y,2) OVER w, 0), coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0), coalesce(lead(y,2) OVER w, 0)])[3] AS smooth FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq)""")
def median_filter(spark, d):
    return W.median_filter(signals(spark, d), ["sample_id"]).select("sample_id", "seq", "smooth")


@query(f"""WITH {SIGNALS}, e AS (SELECT *, x + y AS xe FROM signals), f AS (SELECT *, max(xe) OVER (PARTITION BY sample_id ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR x - m > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY x, seq) AS island FROM f)
SELECT sample_id, island::BIGINT AS island, round(min(x) - 0.5 * greatest(max(xe) - min(x), 1e-6), 9) AS w_low, round(max(xe) + 0.5 * greatest(max(xe) - min(x), 1e-6), 9) AS w_high, count(*) AS n FROM i GROUP BY ALL""")
def gap_windows(spark, d):
    s = signals(spark, d).withColumn("xe", F.col("x") + F.col("y"))
    return W.windows_of(s, ["sample_id"], "x", "xe", 5.0, "seq").select("sample_id", F.col("island").cast("long").alias("island"), F.round("w_low", 9).alias("w_low"), F.round("w_high", 9).alias("w_high"), "n")


@query(f"""WITH {SIGNALS}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id ORDER BY x RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) >= 3 AS core FROM signals),
c AS (SELECT *, CASE WHEN core AND (lag(x) OVER (PARTITION BY sample_id, core ORDER BY x, seq) IS NULL OR x - lag(x) OVER (PARTITION BY sample_id, core ORDER BY x, seq) > 30) THEN 1 ELSE 0 END AS new FROM n),
k AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY x, seq) AS cl FROM c WHERE core),
j AS (SELECT n.sample_id, n.seq, arg_min(k.cl, abs(k.x - n.x) + CASE WHEN k.x > n.x THEN 1e-9 ELSE 0 END) AS cluster FROM n LEFT JOIN k ON n.sample_id = k.sample_id AND abs(k.x - n.x) <= 30 GROUP BY ALL)
SELECT sample_id, seq, cluster::BIGINT AS cluster FROM j""")
def dbscan_1d(spark, d):
    return W.dbscan_1d(signals(spark, d), ["sample_id"], "x", 30.0, 3, "seq").select("sample_id", "seq", F.col("cluster").cast("long").alias("cluster"))


@query(f"""WITH RECURSIVE {SIGNALS}, o AS (SELECT sample_id, x, row_number() OVER (PARTITION BY sample_id ORDER BY x, seq) AS i FROM signals),
k AS (SELECT sample_id, i, x, x AS last, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.sample_id, o.i, o.x, CASE WHEN o.x - k.last > 60 THEN o.x ELSE k.last END, o.x - k.last > 60 FROM k JOIN o ON o.sample_id = k.sample_id AND o.i = k.i + 1)
SELECT sample_id, round(x, 9) AS x FROM k WHERE keep""")
def dedup_last_kept(spark, d):
    return W.kept_apart(signals(spark, d), ["sample_id"], "x", 60.0).select("sample_id", F.round("x", 9).alias("x"))


@query(f"""WITH {SIGNALS}, g AS (SELECT *, CASE WHEN seq % 4 = 1 THEN NULL ELSE y END AS v FROM signals),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY sample_id ORDER BY seq) AS b, min(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g)
SELECT k.sample_id, k.seq, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN b IS NULL THEN ra.y WHEN a IS NULL THEN rb.y ELSE rb.y + (ra.y - rb.y) * ((k.seq - b) / (a - b)) END, 6) AS y FROM k LEFT JOIN signals rb ON rb.sample_id = k.sample_id AND rb.seq = b LEFT JOIN signals ra ON ra.sample_id = k.sample_id AND ra.seq = a""")
def nan_fill(spark, d):
    s = signals(spark, d).withColumn("y", F.when(F.col("seq") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("y")))
    return W.nan_filled(s, ["sample_id"]).select("sample_id", "seq", *r6("y"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prev_next_run(spark, d):
    return W.neighbours(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "previous", "next")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS number FROM orders""")
def renumber(spark, d):
    return W.renumbered(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.col("number").cast("long").alias("number"))


@query(f"""WITH {SIGNALS} SELECT sample_id, seq, round(sum(y) OVER w - first(y) OVER w, 6) AS drift FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_drift(spark, d):
    return W.cumulative(signals(spark, d), ["sample_id"], "y", "seq").select("sample_id", "seq", *r6("drift"))


@query(f"""WITH {SIGNALS}, z AS (SELECT sample_id, seq, y - 20 AS v, lead(y - 20) OVER (PARTITION BY sample_id ORDER BY seq) AS n FROM signals) SELECT sample_id, seq FROM z WHERE v * n < 0""")
def zero_crossings(spark, d):
    return W.zero_crossings(signals(spark, d).withColumn("v", F.col("y") - 20), ["sample_id"], "v").select("sample_id", "seq")


@query(f"""WITH {SIGNALS}, b AS (SELECT p.sample_id, p.seq, arg_max(s.seq, s.y * 1e6 - s.seq) AS snapped FROM signals p JOIN signals s ON s.sample_id = p.sample_id AND s.seq BETWEEN p.seq - 5 AND p.seq + 5 WHERE p.seq % 7 = 0 GROUP BY ALL) SELECT * FROM b""")
def apex_snap(spark, d):
    s = signals(spark, d)
    return W.snap(s, s.filter("seq % 7 = 0").select("sample_id", "seq"), ["sample_id"]).select("sample_id", "seq", "snapped")


@query(MAXIMA + """, v AS (SELECT *, y > lag(y) OVER w AND y > lead(y) OVER w AS m, max(seq) OVER (PARTITION BY sample_id) AS n FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq))
SELECT a.sample_id, a.seq AS apex, coalesce(max(v.seq) FILTER (WHERE m AND v.seq < a.seq), greatest(a.seq - 20, 0)) AS "left", coalesce(min(v.seq) FILTER (WHERE m AND v.seq > a.seq), least(a.seq + 20, any_value(n))) AS "right" FROM apex a JOIN v USING (sample_id) GROUP BY a.sample_id, a.seq""")
def inflection_bounds(spark, d):
    s = signals(spark, d)
    return W.curvature_bounds(s.withColumn("d2", F.col("y")), W.local_maxima(s, ["sample_id"]), ["sample_id"])


# --- areas, noise, groups ---------------------------------------------------------------------------------------------


@query(f"""WITH {SIGNALS}, b AS (SELECT * FROM (VALUES (0, 'low', 0.0, 10000.0), (1, 'mid', 10000.0, 20000.0), (2, 'none', -5.0, -1.0)) t(band, name, lo, hi)),
i AS (SELECT s.*, name FROM signals s JOIN b ON x BETWEEN lo AND hi), t AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS strip FROM i WINDOW w AS (PARTITION BY sample_id, name ORDER BY seq)),
g AS (SELECT sample_id, name, abs(sum(strip)) AS area, max(y) AS peak, arg_max(x, y * 1e7 - seq) AS peak_x, count(*) AS points FROM t GROUP BY ALL)
SELECT s.sample_id, b.band, b.name, round(coalesce(area, 0), 6) AS area, peak, round(peak_x, 6) AS peak_x, coalesce(points, 0) AS points FROM (SELECT DISTINCT sample_id FROM signals) s CROSS JOIN b LEFT JOIN g ON g.sample_id = s.sample_id AND g.name = b.name""")
def band_area(spark, d):
    bands = spark.createDataFrame([(0, "low", 0.0, 10000.0), (1, "mid", 10000.0, 20000.0), (2, "none", -5.0, -1.0)], "seq int, name string, x_min double, x_max double")
    return A.band_integrals(signals(spark, d), bands, ["sample_id"]).select("sample_id", "band", "name", *r6("area"), "peak", *r6("peak_x"), "points")


@query(f"""WITH {SIGNALS}, t AS (SELECT *, (x - lag(x) OVER w) * (greatest(y - 20, 0) + greatest(lag(y) OVER w - 20, 0)) / 2 AS strip FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY seq)) SELECT sample_id, round(sum(strip), 6) AS area FROM t GROUP BY 1 HAVING sum(strip) >= 1e-10""")
def segment_area(spark, d):
    return A.segment_area(signals(spark, d).withColumn("y", F.col("y") - 20), ["sample_id"]).select("sample_id", *r6("area"))


@query(f"""WITH {PEAKS}, g AS (SELECT * FROM (VALUES (0, 5.0, 12.0), (1, 10.0, 20.0)) t(seq, lo, hi)), c AS (SELECT p.*, min(g.seq) AS s FROM peaks p LEFT JOIN g ON rt BETWEEN lo AND hi GROUP BY ALL),
u AS (SELECT sample_id, CASE s WHEN 0 THEN 5.0 ELSE 10.0 END AS rt, sum(area) AS area, count(*) AS members, 'Group' AS compound_id FROM c WHERE s IS NOT NULL GROUP BY sample_id, s UNION ALL SELECT sample_id, rt, area, 1, 'peak' FROM c WHERE s IS NULL)
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rt, area) AS number, rt, round(area, 6) AS area, members, compound_id FROM u""")
def peak_groups(spark, d):
    g = spark.createDataFrame([(0, 5.0, 12.0), (1, 10.0, 20.0)], "seq int, g_low double, g_high double")
    return A.peak_groups(peaks(spark, d), g, ["sample_id"]).select("sample_id", F.col("number").cast("long").alias("number"), "rt", *r6("area"), "members", "compound_id")


@query(f"""WITH {SIGNALS}, q AS (SELECT sample_id, quantile_cont(y, 0.25) AS q FROM signals GROUP BY 1), l AS (SELECT s.*, y < q AS low, count(*) FILTER (WHERE y < q) OVER (PARTITION BY s.sample_id) AS n FROM signals s JOIN q USING (sample_id)),
u AS (SELECT * FROM l WHERE n <= 20 OR low), m AS (SELECT sample_id, median(y) AS m FROM u GROUP BY 1) SELECT sample_id, round(1.4826 * median(abs(y - m)), 6) AS noise FROM u JOIN m USING (sample_id) GROUP BY 1""")
def noise_mad(spark, d):
    return A.robust_noise(signals(spark, d), ["sample_id"]).select("sample_id", *r6("noise"))


@query(f"""WITH {SIGNALS}, h AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(y), seq) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM signals) SELECT sample_id, round(greatest(3 * stddev_pop(abs(y)), 1e-10), 6) AS floor FROM h WHERE r <= greatest(n // 4, 1) GROUP BY 1""")
def noise_floor(spark, d):
    return A.noise_floor(signals(spark, d), ["sample_id"]).select("sample_id", *r6("floor"))


@query(f"""WITH {SIGNALS}, m AS (SELECT sample_id, avg(y) AS m FROM signals GROUP BY 1) SELECT sample_id, round(avg((y - m) ** 3) / avg((y - m) ** 2) ** 1.5, 6) AS skew FROM signals JOIN m USING (sample_id) GROUP BY 1""")
def peak_skew(spark, d):
    return A.skewness(signals(spark, d), ["sample_id"], "y").select("sample_id", *r6("skew"))


@query(f"""WITH {SPECTRA}, s AS (SELECT * FROM spectra), p AS (SELECT a.label, a.mz AS i, b.mz AS j, corr(a.intensity, b.intensity) AS r FROM s a JOIN s b ON a.id = b.id AND a.label = b.label AND a.mz < b.mz GROUP BY ALL)
SELECT label, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_high, count(*) AS pairs FROM p WHERE r IS NOT NULL GROUP BY 1""")
def coherence(spark, d):
    return A.coherence(spectra(spark, d), ["label"], "mz", "id", "intensity").select("label", *r6("mean_r", "share_high"), "pairs")


@query(f"""WITH {PEAKS} SELECT sample_id, round(CASE WHEN count(*) >= 2 THEN 0.5 * median(area / 1000) ELSE 0.3 END, 7) AS gap FROM peaks GROUP BY 1""")
def gap_tolerance(spark, d):
    return A.gap_tolerance(peaks(spark, d), ["sample_id"], F.col("area") / 1000).select("sample_id", F.round("gap", 7).alias("gap"))


@query(f"""WITH {SIGNALS}, f AS (SELECT *, avg(y) OVER (PARTITION BY sample_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS fit FROM signals)
SELECT sample_id, round(1 - sum((y - fit) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round((count(*) * ln(sum((y - fit) ** 2) / count(*)) + 6) / count(*), 6) AS aic, round(1 - sqrt(avg((y - fit) ** 2)) / stddev_pop(y), 6) AS rmse_score FROM f GROUP BY 1""")
def fit_quality(spark, d):
    w = Window.partitionBy("sample_id").orderBy("seq").rowsBetween(-2, 2)
    return A.fit_quality(signals(spark, d).withColumn("fit", F.avg("y").over(w)), ["sample_id"], "y", "fit").select("sample_id", *r6("r2", "aic", "rmse_score"))


@query(f"""WITH {SIGNALS}, c AS (SELECT s.*, k AS component, 1 + (seq + k) % 5 AS curve FROM signals s, (SELECT unnest([0, 1, 2]) AS k)), p AS (SELECT *, curve / sum(curve) OVER (PARTITION BY sample_id, seq) * greatest(y, 0) AS part FROM c),
t AS (SELECT *, (x - lag(x) OVER w) * (part + lag(part) OVER w) / 2 AS strip FROM p WINDOW w AS (PARTITION BY sample_id, component ORDER BY seq)) SELECT sample_id, component, round(sum(strip), 6) AS area FROM t GROUP BY ALL""")
def rescale_area(spark, d):
    c = signals(spark, d).withColumn("component", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("curve", (1 + (F.col("seq") + F.col("component")) % 5).cast("double")).withColumn("signal", F.col("y"))
    return A.proportional_areas(c, ["sample_id"]).select("sample_id", "component", *r6("area"))


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL""")
def confusion(spark, d):
    return A.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH l AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS h, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS m, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS p FROM labels)
SELECT h AS hits, m AS misses, p AS phantoms, round(h / (h + p), 6) AS "precision", round(h / (h + m), 6) AS recall, round(2 * h / (2 * h + m + p), 6) AS f1 FROM l""")
def eval_report(spark, d):
    return A.detection_report(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0).select("hits", "misses", "phantoms", *r6("precision", "recall", "f1"))


@query("""SELECT user_id, count(*) AS files, round(avg(value), 6) AS mean_s, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS mean_optional_s FROM events GROUP BY 1""")
def timing_report(spark, d):
    found = A.timing_report(table(spark, d, "events"), ["user_id"], F.col("value"), F.when(F.col("event_type") == "click", F.col("value")))
    return found.select("user_id", "files", *r6("mean_s", "mean_optional_s"))


# --- spectra ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {SPECTRA} SELECT label, id AS scan, round(sum(intensity), 6) AS tic FROM spectra GROUP BY ALL""")
def tic(spark, d):
    return M.tic(spectra(spark, d).withColumnRenamed("id", "scan"), ["label"]).select("label", "scan", *r6("tic"))


@query(f"""WITH {SPECTRA}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS rank FROM spectra) SELECT id, mz, round(intensity, 6) AS intensity, rank FROM r WHERE rank <= 10""")
def top_ions(spark, d):
    return M.top_ions(spectra(spark, d), ["id"]).select("id", F.col("mz").cast("long").alias("mz"), *r6("intensity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SPECTRA}, w AS (SELECT *, sum(intensity) OVER (PARTITION BY id) AS w FROM spectra) SELECT label, mz, round(sum(w * intensity) / sum(w), 6) AS intensity FROM w GROUP BY ALL""")
def weighted_spectrum(spark, d):
    return M.weighted_spectrum(spectra(spark, d).withColumnRenamed("id", "scan"), ["label"]).select("label", F.col("mz").cast("long").alias("mz"), *r6("intensity"))


@query(f"""WITH {SPECTRA}, m AS (SELECT *, max(intensity) OVER (PARTITION BY id) AS m FROM spectra) SELECT id, mz, round(intensity, 6) AS intensity FROM m WHERE intensity > 0.5 * m""")
def relative_intensity(spark, d):
    return M.relative_filter(spectra(spark, d), ["id"], 0.5).select("id", F.col("mz").cast("long").alias("mz"), *r6("intensity"))


@query(f"""WITH {SPECTRA} SELECT id, mz, round(intensity, 6) AS intensity FROM spectra WHERE NOT (abs(mz - 18) <= 0.5 OR abs(mz - 28) <= 0.5 OR abs(mz - 32) <= 1)""")
def excluded_mz(spark, d):
    s = M.excluded(spectra(spark, d), [18.0, 28.0])
    return M.excluded(s, [32.0], 1.0).select("id", F.col("mz").cast("long").alias("mz"), *r6("intensity"))


SEARCH_SQL = f"""WITH {SPECTRA}, q AS (SELECT * FROM spectra WHERE id % 50 = 0), n AS (SELECT id, sqrt(sum(intensity * intensity)) AS n FROM spectra GROUP BY 1),
s AS (SELECT q.id AS query, l.id AS hit, sum(q.intensity * l.intensity) / (any_value(a.n) * any_value(b.n)) AS score FROM q JOIN spectra l ON q.mz = l.mz AND q.intensity > 0 AND l.intensity > 0 JOIN n a ON a.id = q.id JOIN n b ON b.id = l.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, hit) AS rank FROM s)"""


@query(SEARCH_SQL + " SELECT query, hit, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def library_topk(spark, d):
    s = spectra(spark, d)
    return M.search(s.filter("id % 50 = 0"), s, 5).select("query", "hit", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query(SEARCH_SQL + " SELECT query, hit, round(score, 6) AS score FROM r WHERE rank <= 1")
def best_hit_2d(spark, d):
    s = spectra(spark, d)
    return M.search(s.filter("id % 50 = 0"), s, 1).select("query", "hit", *r6("score"))


@query("""SELECT DISTINCT label, i AS mz FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) WHERE abs(embedding[i]) >= 0.3""")
def distinct_mz(spark, d):
    return M.ions_above(spectra(spark, d).withColumn("mz", F.col("mz").cast("long")), ["label"], 0.30000001192092896)


@query(f"""WITH {SPECTRA} SELECT label, mz, round(max(intensity), 6) AS highest FROM spectra GROUP BY ALL HAVING max(intensity) >= 0.25""")
def having_max(spark, d):
    return A.highest(spectra(spark, d).withColumn("mz", F.col("mz").cast("long")), ["label", "mz"], "intensity", 0.25).select("label", "mz", *r6("highest"))


# --- scans, sets, keys ------------------------------------------------------------------------------------------------


@query(f"""WITH {SIGNALS}, t AS (SELECT o_orderkey AS target, o_custkey % 15 AS sample_id, (o_orderkey * 7 % 40000)::DOUBLE AS goal FROM orders)
SELECT target, arg_min(seq, abs(x - goal) * 1e6 + seq * 1e-4) AS nearest_scan FROM t JOIN signals USING (sample_id) GROUP BY 1""")
def nearest_scan(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), (F.col("o_custkey") % 15).alias("sample_id"), (F.col("o_orderkey") * 7 % 40000).cast("double").alias("at"))
    return J.nearest_scan(t, signals(spark, d), ["sample_id"], "at", "x", "seq").filter("nearest_scan is not null").select("target", "nearest_scan")


@query(f"""WITH {PEAKS}, m AS (SELECT o_orderkey AS sample_id, o_custkey % 20 AS lo, o_custkey % 20 + 8 AS hi FROM orders) SELECT p.sample_id, peak_number, lo FROM peaks p JOIN m ON p.sample_id = m.sample_id AND rt BETWEEN lo AND hi""")
def interval_candidates(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 20).alias("lo"), (F.col("o_custkey") % 20 + 8).alias("hi"))
    return J.interval_join(peaks(spark, d), m, "rt", "lo", "hi", ["sample_id"]).select("sample_id", "peak_number", "lo")


@query(f"""WITH {PEAKS}, w AS (SELECT o_orderkey AS sample_id, o_custkey % 20 AS lo, o_custkey % 20 + 8 AS hi FROM orders), c AS (SELECT sample_id, rt, area, 'classical' AS origin FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sample_id = p.sample_id AND rt BETWEEN lo AND hi)
UNION ALL SELECT sample_id, lo + 1, hi::DOUBLE, 'component' FROM w) SELECT sample_id, rt, area, origin, row_number() OVER (PARTITION BY sample_id ORDER BY rt, origin, area) AS number FROM c""")
def hybrid_merge(spark, d):
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 20).alias("w_low"), (F.col("o_custkey") % 20 + 8).alias("w_high"))
    comps = w.select("sample_id", (F.col("w_low") + 1).cast("double").alias("rt"), F.col("w_high").cast("double").alias("area"))
    return J.hybrid(peaks(spark, d).select("sample_id", "rt", "area"), comps, w, ["sample_id"]).select("sample_id", "rt", "area", "origin", F.col("number").cast("long").alias("number"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 3) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_set_check(spark, d):
    # keys compress to so little that Spark would take many parts of them into one task
    a, b = spread(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k").distinct(), spread(table(spark, d, "orders").filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("k")), "k")
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("right")))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60)
SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def signal_setops(spark, d):
    e = table(spark, d, "events")
    a, b = e.filter("event_type = 'click'").select("user_id").distinct(), e.filter("event_type = 'error' and value > 60").select("user_id").distinct()
    return a.union(b).distinct().withColumn("op", F.lit("union")).unionByName(a.exceptAll(b).withColumn("op", F.lit("except"))).unionByName(a.intersect(b).withColumn("op", F.lit("intersect")))


@query("""SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0')[1:6] || '-' || lpad(c_custkey::VARCHAR, 9, '0')[7:8] || '-' || lpad(c_custkey::VARCHAR, 9, '0')[9:9] AS cas, lpad((c_custkey // 100)::VARCHAR, 6, '0') || '-' || (c_custkey % 100) || '-1' AS padded FROM customer""")
def cas_format(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", S.cas_format(k.cast("string")).alias("cas"), S.cas_pad(F.concat_ws("-", F.floor(k / 100).cast("string"), (k % 100).cast("string"), F.lit("1"))).alias("padded"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1 END AS carbons, round(12.0107::DOUBLE * p_size + 1.0079 * (p_partkey % 9) + 15.9994 * (p_partkey % 2) + 32.065 * 0 + 14.0067 * (p_partkey % 4), 6) AS mw FROM part""")
def molecular_weight(spark, d):
    k = F.col("p_partkey")
    formula = F.when(k % 3 == 0, F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H2"))).otherwise(F.lit("CH3OH"))
    return table(spark, d, "part").select("p_partkey", S.carbon_count(formula).alias("carbons"), F.round(S.molecular_weight(F.col("p_size"), k % 9, k % 2, F.lit(0), k % 4), 6).alias("mw"))


@query("""SELECT c_custkey, c_custkey % 5 IN (0, 1, 2, 3) AS unassigned FROM customer""")
def unassigned(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, None).when(k == 1, " ").when(k == 2, "UNKNOWN").when(k == 3, "Unknown (12.345)").otherwise("Unknown (x)")
    return table(spark, d, "customer").select("c_custkey", S.is_unassigned(name).alias("unassigned"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS parsed FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3""")
def timestamp_parse(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(k == 2, F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss")).otherwise("not a time")
    micros = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(parsed as timestamp_ntz))")
    return table(spark, d, "orders").select("o_orderkey", S.timestamp_parsed(text).alias("parsed")).select("o_orderkey", micros.alias("parsed"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'volume' WHEN p_size % 3 = 0 THEN 'density' WHEN p_size < 12 THEN 'molecular weight' END AS problem, round(8 - (p_size % 10) * 5.5 / 9, 6) AS snr, round(10 * exp(-((p_size - 20) * (p_size - 20)) / 50.0) + 1, 6) AS curve, round(abs(p_retailprice * CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 4 END), 6) AS area FROM part""")
def scalar_checks(spark, d):
    n = F.col("p_size")
    volume, density = F.when(n > 40, 1001.0).otherwise(10.0), F.when(n % 3 == 0, 3.0).otherwise(0.8)
    return table(spark, d, "part").select(
        "p_partkey", S.input_problem(volume, density, n.cast("double")).alias("problem"), F.round(S.sensitivity_snr((n % 10 + 1).cast("double")), 6).alias("snr"),
        F.round(S.gaussian(n.cast("double"), F.lit(10.0), F.lit(20.0), F.lit(5.0), F.lit(1.0)), 6).alias("curve"), F.round(S.scaled_area(F.col("p_retailprice"), (n % 4).cast("double")), 6).alias("area"),
    )


# --- resampling -------------------------------------------------------------------------------------------------------


@query(f"""WITH {SIGNALS}, g AS (SELECT sample_id, min(x) AS a, max(x) AS b FROM signals GROUP BY 1) SELECT sample_id, i, round(a + (b - a) * i / 99, 6) AS x FROM g, (SELECT unnest(generate_series(0, 99)) AS i)""")
def time_grid(spark, d):
    from ..operators.resample import time_grid as grid

    return grid(signals(spark, d), ["sample_id"], 100).select("sample_id", F.col("i").cast("long").alias("i"), *r6("x"))


@query(f"""WITH {SIGNALS}, g AS (SELECT i, (i * 450)::DOUBLE AS gx FROM (SELECT unnest(generate_series(0, 99)) AS i)), k AS (SELECT s.sample_id, i, gx, arg_max(struct_pack(x := x, y := y), x * 1e3 + seq * 1e-6) FILTER (WHERE x <= gx) AS b, arg_min(struct_pack(x := x, y := y), x * 1e3 + seq * 1e-6) FILTER (WHERE x >= gx) AS a FROM g CROSS JOIN signals s GROUP BY ALL)
SELECT sample_id, i, round(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a.x = b.x THEN b.y ELSE b.y + (a.y - b.y) * (gx - b.x) / (a.x - b.x) END, 6) AS y FROM k""")
def resample_masked(spark, d):
    from ..operators.resample import resampled

    s = signals(spark, d)
    grid = s.select("sample_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("x", F.col("i") * F.lit(450.0))
    return resampled(s, grid, ["sample_id"]).select("sample_id", F.col("i").cast("long").alias("i"), *r6("y"))


@query(f"""WITH {SIGNALS}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM signals), m AS (SELECT sample_id, i, n, i * (n - 1) / 31.0 AS p FROM (SELECT DISTINCT sample_id, n FROM n), (SELECT unnest(generate_series(0, 31)) AS i))
SELECT m.sample_id, i, round(a.y + (coalesce(b.y, a.y) - a.y) * (p - floor(p)), 6) AS y FROM m JOIN signals a ON a.sample_id = m.sample_id AND a.seq = floor(p) LEFT JOIN signals b ON b.sample_id = m.sample_id AND b.seq = floor(p) + 1""")
def length_interp(spark, d):
    from ..operators.resample import interpolated

    return interpolated(signals(spark, d), ["sample_id"], 32).select("sample_id", F.col("i").cast("long").alias("i"), *r6("y"))


@query(f"""WITH {SIGNALS} SELECT sample_id, seq, round(CASE WHEN max(y) OVER w - min(y) OVER w <= 1e-12 THEN 0 ELSE (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) END, 6) AS y FROM signals WINDOW w AS (PARTITION BY sample_id)""")
def minmax_scale(spark, d):
    from ..operators.resample import scaled

    return scaled(signals(spark, d), ["sample_id"]).select("sample_id", "seq", *r6("y"))


@query(f"""WITH {SIGNALS}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM signals) SELECT sample_id, seq // 12 AS mod, (seq % 12 + 5) % 12 AS scan, y FROM n WHERE seq // 12 < n // 12""")
def fold_2d(spark, d):
    return M.rolled(M.folded(signals(spark, d), 12), 5, 12).select("sample_id", "mod", "scan", "y")


@query(f"""WITH {PEAKS}, m AS (SELECT sample_id, median(area) AS m FROM peaks GROUP BY 1) SELECT sample_id, peak_number, area FROM peaks JOIN m USING (sample_id) WHERE area >= 0.5 * m AND (rt BETWEEN 2 AND 15 OR rt BETWEEN 30 AND 45)""")
def range_filter(spark, d):
    from ..operators.resample import in_ranges, median_area_filter

    return in_ranges(median_area_filter(peaks(spark, d), ["sample_id"], 0.5), [(2.0, 15.0), (30.0, 45.0)]).select("sample_id", "peak_number", "area")
