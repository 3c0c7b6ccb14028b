"""Further queries: filters, picks, keyed lookups and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import resample as R
from ..operators import spectra as M
from ..operators import windows as W
from ..sources import sinks
from .adapters import PEAKS, RT_TABLE, SIGNALS, SPECTRA, peaks, rt_table, signals, spectra, table
from .queries import query, r6


@query(f"WITH {SIGNALS} SELECT sample_id, seq, round(x + 0.25, 9) AS x FROM signals")
def axis_shift(spark, d):
    return R.shifted(signals(spark, d), 0.25).select("sample_id", "seq", F.round("x", 9).alias("x"))


@query(f"WITH {SIGNALS} SELECT sample_id, seq, (seq % 12 + 5) % 12 AS scan FROM signals")
def phase_roll(spark, d):
    return M.rolled(signals(spark, d).withColumn("scan", F.col("seq") % 12), 5, 12).select("sample_id", "seq", "scan")


@query(f"""WITH {SIGNALS}, m AS (SELECT sample_id, seq // 12 AS mod, seq % 12 AS scan, y, y - lag(y) OVER (PARTITION BY sample_id, seq // 12 ORDER BY seq) AS dy, lag(y) OVER (PARTITION BY sample_id, seq // 12 ORDER BY seq) AS py FROM signals)
SELECT sample_id, round(sum((y + py) / 2), 6) AS volume, round(sum(mod * y) / sum(y), 6) AS mod_centre, arg_max(mod * 12 + scan, y * 1e6 - (mod * 12 + scan)) AS apex FROM m GROUP BY 1""")
def peak_volume(spark, d):
    whole = signals(spark, d).withColumn("mod", F.floor(F.col("seq") / 12).cast("long"))
    return M.volumes(whole, ["sample_id"]).select("sample_id", *r6("volume", "mod_centre"), "apex")


@query(f"""WITH {PEAKS}, s AS (SELECT DISTINCT sample_id, part, rt, area FROM peaks)
SELECT a.sample_id, a.part, b.sample_id AS other, count(*) AS n FROM s a JOIN s b ON a.part = b.part AND a.sample_id < b.sample_id AND abs(a.rt - b.rt) <= 1 GROUP BY ALL""")
def cross_file_match(spark, d):
    s = peaks(spark, d).select("sample_id", "part", "rt", "area").distinct()
    return J.across(s, ["part"], "sample_id", "rt", 1.0).groupBy("sample_id", "part", "other").agg(F.count("*").alias("n"))


@query(f"""WITH {PEAKS}, n AS (SELECT p.*, CASE WHEN o.o_orderkey IS NOT NULL AND peak_number = 1 THEN 'new' ELSE 'old' END AS id FROM peaks p LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0) o ON o_orderkey = sample_id)
SELECT sample_id, peak_number, id AS compound_id, max(CASE WHEN id = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id) = 1 AS changed FROM n""")
def results_update(spark, d):
    ids = table(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("sample_id"), F.lit(1).cast("long").alias("peak_number"), F.lit("new").alias("compound_id"))
    return sinks.updated_ids(peaks(spark, d).select("sample_id", "peak_number", F.lit("old").alias("compound_id")), ids)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS place FROM orders""")
def chronological(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("at"))
    return W.placed(o, F.col("at").asc_nulls_last(), F.col("o_orderkey").asc()).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey, left(trim(replace(replace(c_mktsegment || '/' || c_name, '/', ''), '#', '#')), 31) AS sheet FROM customer""")
def sheet_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.sheet_name(F.concat_ws("/", "c_mktsegment", "c_name")).alias("sheet"))


@query(f"""WITH {SPECTRA}, m AS (SELECT label, id, max(intensity) AS top FROM spectra GROUP BY ALL), f AS (SELECT label, min(id) FILTER (WHERE top >= 0.35) AS first FROM m GROUP BY 1)
SELECT f.label, f.first AS first_saturated, max(m.id) FILTER (WHERE m.id < f.first) AS use_scan, round(max(m.top), 6) AS level FROM f JOIN m USING (label) GROUP BY ALL""")
def saturation(spark, d):
    return M.saturation(spectra(spark, d), ["label"], "id", 0.35).select("label", "first_saturated", "use_scan", *r6("level"))


@query(f"""WITH {SPECTRA}, b AS (SELECT *, min(intensity) OVER (PARTITION BY label, mz) AS base FROM spectra) SELECT id, round(sum(intensity), 6) AS original, round(sum(greatest(intensity - base, 0)), 6) AS corrected, round(sum(base), 6) AS baseline FROM b GROUP BY 1""")
def tic_totals(spark, d):
    return M.current_totals(spectra(spark, d), "id", ["label", "mz"]).select("id", *r6("original", "corrected", "baseline"))


@query(f"""WITH {SPECTRA}, m AS (SELECT label, mz, max(intensity) AS top FROM spectra GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY top DESC, mz) AS rank FROM m) SELECT label, mz, rank FROM r WHERE rank <= 7""")
def strongest_traces(spark, d):
    m = spectra(spark, d).groupBy("label", F.col("mz").cast("long").alias("mz")).agg(F.max("intensity").alias("top"))
    return W.top(m, ["label"], 7, F.desc("top"), F.col("mz")).select("label", "mz", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SPECTRA} SELECT id, arg_max(mz, intensity * 1e9 - mz) AS mz FROM spectra GROUP BY 1""")
def best_candidate(spark, d):
    return spectra(spark, d).groupBy("id").agg(F.max_by("mz", F.struct("intensity", -F.col("mz"))).cast("long").alias("mz"))


@query(f"""WITH {SPECTRA}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS rank FROM spectra) SELECT id, rank, mz FROM r WHERE rank <= 20""")
def top20(spark, d):
    return M.top_ions(spectra(spark, d), ["id"], 20).select("id", F.col("rank").cast("long").alias("rank"), F.col("mz").cast("long").alias("mz"))


@query(f"WITH {SIGNALS} SELECT sample_id, seq, y FROM signals WHERE seq = 17")
def nth_scan(spark, d):
    return signals(spark, d).filter("seq = 17").select("sample_id", "seq", "y")


@query("""SELECT name AS "group", CASE WHEN name = 'Total' THEN 0 ELSE 1 END::BIGINT AS first, n FROM (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM part)""")
def group_order(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("group")).agg(F.count("*").alias("n")).unionByName(table(spark, d, "part").agg(F.count("*").alias("n")).withColumn("group", F.lit("Total")))
    return g.withColumn("first", F.when(F.col("group") == "Total", 0).otherwise(1).cast("long")).orderBy("first", "group")


@query(f"WITH {PEAKS} SELECT sample_id, peak_number, row_number() OVER (PARTITION BY sample_id ORDER BY rt, peak_number) AS place FROM peaks")
def sort_rt(spark, d):
    return W.renumbered(peaks(spark, d), ["sample_id"], "rt", "peak_number", name="place").select("sample_id", "peak_number", F.col("place").cast("long").alias("place"))


@query(f"""WITH {SIGNALS}, r AS (SELECT sample_id, min(x) + 600 AS lo, max(x) - 600 AS hi FROM signals GROUP BY 1) SELECT sample_id, seq FROM signals JOIN r USING (sample_id) WHERE x BETWEEN lo AND hi""")
def ms_gate(spark, d):
    s = signals(spark, d)
    r = s.groupBy("sample_id").agg((F.min("x") + 600).alias("lo"), (F.max("x") - 600).alias("hi"))
    return J.interval_join(s, r, "x", "lo", "hi", ["sample_id"]).select("sample_id", "seq")


@query(f"""WITH {PEAKS}, w AS (SELECT o_orderkey AS sample_id, o_custkey % 20 AS lo, o_custkey % 20 + 8 AS hi FROM orders) SELECT sample_id, peak_number, EXISTS (SELECT 1 FROM w WHERE w.sample_id = p.sample_id AND rt BETWEEN lo AND hi) AS inside FROM peaks p""")
def split_window_filter(spark, d):
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 20).alias("lo"), (F.col("o_custkey") % 20 + 8).alias("hi"))
    p = peaks(spark, d)
    a = J.interval_join(p, w, "rt", "lo", "hi", ["sample_id"], "left_semi").withColumn("inside", F.lit(True))
    b = J.interval_join(p, w, "rt", "lo", "hi", ["sample_id"], "left_anti").withColumn("inside", F.lit(False))
    return a.unionByName(b).select("sample_id", "peak_number", "inside")


@query(f"""WITH {SPECTRA}, b AS (SELECT id, mz, intensity - 0.1 AS v FROM spectra), m AS (SELECT *, max(v) OVER (PARTITION BY id) AS m FROM b) SELECT id, mz, round(v, 6) AS v FROM m WHERE v > 0 AND v > 0.3 * CASE WHEN m <= 0 THEN 1 ELSE m END""")
def positive_filter(spark, d):
    return R.positive_above(spectra(spark, d).withColumn("v", F.col("intensity") - 0.1), ["id"], "v", 0.3).select("id", F.col("mz").cast("long").alias("mz"), *r6("v"))


@query(f"""WITH {SIGNALS}, m AS (SELECT *, max(y) OVER w - min(y) OVER w AS span FROM signals WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, seq FROM m WHERE y >= 0.2 * span""")
def noise_apex_filter(spark, d):
    w = Window.partitionBy("sample_id")
    return signals(spark, d).withColumn("limit", S.prominence_limit(F.lit(0.2), F.min("y").over(w), F.max("y").over(w))).filter("y >= limit").select("sample_id", "seq")


@query(f"""WITH {PEAKS} SELECT sample_id, peak_number, round(abs(area * CASE WHEN part % 3 = 0 THEN 1 ELSE part % 3 * -0.5 END), 6) AS area, round(rt, 4) AS rt, CASE WHEN area < 1000 THEN 'small' ELSE '' END AS quality FROM peaks""")
def report_fields(spark, d):
    factor = F.when(F.col("part") % 3 == 0, 0.0).otherwise(F.col("part") % 3 * -0.5)
    own = peaks(spark, d).withColumn("small", F.when(F.col("area") < 1000, "small"))
    return R.report_fields(own, factor, F.col("small")).select("sample_id", "peak_number", *r6("area"), "rt", "quality")


@query(f"""WITH {SIGNALS}, s AS (SELECT *, CASE WHEN x < 8000 THEN 0 WHEN x < 20000 THEN 1 WHEN x < 20300 THEN 2 ELSE 3 END AS segment FROM signals) SELECT sample_id, segment::BIGINT AS segment, count(*) AS n, count(*) >= 10 AS fitted, min(seq) AS first, max(seq) AS last FROM s GROUP BY ALL""")
def mask_segments(spark, d):
    return R.axis_segments(signals(spark, d), ["sample_id"], [8000, 20000, 20300])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE WHEN p_partkey IS NULL THEN NULL ELSE lpad(p_partkey::VARCHAR, 9, '0')[1:6] || '-' || lpad(p_partkey::VARCHAR, 9, '0')[7:8] || '-' || lpad(p_partkey::VARCHAR, 9, '0')[9:9] END AS cas FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 1) ON l_partkey = p_partkey""")
def cas_join(spark, d):
    lib = table(spark, d, "part").filter("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("seq"), S.cas_format(F.col("p_partkey").cast("string")).alias("cas"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return J.deduplicated_lookup(line, lib, "l_partkey", "seq", ["cas"])


@query(f"""WITH {SIGNALS}, u AS (SELECT DISTINCT sample_id, x FROM signals UNION SELECT DISTINCT sample_id, x + 30 FROM signals), k AS (SELECT u.sample_id, u.x, arg_max(struct_pack(x := s.x, y := s.y), s.x * 1e3 + s.seq * 1e-6) FILTER (WHERE s.x <= u.x) AS b, arg_min(struct_pack(x := s.x, y := s.y), s.x * 1e3 + s.seq * 1e-6) FILTER (WHERE s.x >= u.x) AS a FROM u JOIN signals s ON s.sample_id = u.sample_id GROUP BY ALL)
SELECT sample_id, round(x, 9) AS x, round(CASE WHEN b IS NULL THEN a.y WHEN a IS NULL THEN b.y WHEN a.x = b.x THEN b.y ELSE b.y + (a.y - b.y) * (x - b.x) / (a.x - b.x) END, 6) AS y FROM k""")
def axis_union(spark, d):
    s = signals(spark, d)
    u = s.select("sample_id", "x").union(s.select("sample_id", F.col("x") + 30)).distinct()
    grid = u.withColumn("i", F.row_number().over(Window.partitionBy("sample_id").orderBy("x")) - 1)
    return R.resampled(s, grid, ["sample_id"], clamp=True).select("sample_id", F.round("x", 9).alias("x"), *r6("y"))


@query("""SELECT p_partkey, round(10 * 1e-3 * 0.73 / (12.0 + p_size) * (p_partkey % 12), 9) AS molc, round(CASE WHEN p_partkey % 12 > 0 THEN p_retailprice / (10 * 1e-3 * 0.73 / (12.0 + p_size) * (p_partkey % 12)) END, 3) AS rf, 7.3::DOUBLE AS mass_mg,
CASE p_partkey % 3 WHEN 0 THEN 'mol%' WHEN 1 THEN 'wt%' ELSE 'unspecified' END AS basis, CASE WHEN p_partkey % 2 = 0 THEN 'gcms' ELSE 'gc' END AS kind FROM part""")
def quant_scalars(spark, d):
    k = F.col("p_partkey")
    molc = S.internal_standard_mol_c(F.lit(10.0), F.lit(0.73), 12.0 + F.col("p_size"), k % 12)
    unit = F.when(k % 3 == 0, "area_per_mol").when(k % 3 == 1, "area_per_mass").otherwise("what")
    return table(spark, d, "part").select("p_partkey", F.round(F.coalesce(molc, F.lit(0.0)), 9).alias("molc"), F.round(S.response_factor(F.col("p_retailprice"), molc), 3).alias("rf"), F.round(S.sample_mass_mg(F.lit(10.0), F.lit(0.73)), 6).alias("mass_mg"), S.rf_basis(unit).alias("basis"), S.signal_type(k % 2 == 0).alias("kind"))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 20 OR user_id % 10 = 0) AS matched, count(*) FILTER (WHERE value > 60) AS saturated FROM events GROUP BY 1""")
def search_summary(spark, d):
    return A.search_summary(table(spark, d, "events"), ["event_type"], (F.col("value") > 20) | (F.col("user_id") % 10 == 0), F.col("value") > 60)


@query("""SELECT p_brand AS anchor, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey < 10) GROUP BY 1""")
def missing_anchors(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "anchor")
    return J.missing_anchors(p, p.filter("p_partkey < 10"))


@query(f"""WITH {PEAKS}, {RT_TABLE}, g AS (SELECT min(start) AS lo, max("end") AS hi, least(greatest(avg("end" - start), 0.05 * (max("end") - min(start))), 1.0) AS m FROM rt_table), p AS (SELECT sample_id, peak_number, rt FROM peaks),
w AS (SELECT sample_id, peak_number, rt, arg_min(struct_pack(c := compound, s := start, e := "end"), (0.25 * abs(start - rt) + 0.5 * abs(apex - rt) + 0.25 * abs("end" - rt)) * 1e6 + seq) AS t FROM p LEFT JOIN rt_table ON (SELECT rt BETWEEN lo - m AND hi + m FROM g) GROUP BY ALL)
SELECT 0::BIGINT AS mode, sample_id, peak_number, arg_min(compound, ("end" - start) * 1e6 + seq) AS compound FROM p LEFT JOIN rt_table ON rt BETWEEN start - 0.5 AND "end" + 0.5 GROUP BY ALL
UNION ALL SELECT 1, sample_id, peak_number, arg_min(compound, abs(apex - rt) * 1e6 + seq) FROM p LEFT JOIN rt_table ON abs(apex - rt) <= 0.1 GROUP BY ALL UNION ALL SELECT 2, sample_id, peak_number, CASE WHEN greatest(t.s - rt, rt - t.e, 0) <= 0.75 * (t.e - t.s) THEN t.c END FROM w UNION ALL SELECT 7, sample_id, peak_number, NULL FROM p""")
def rt_match_dispatch(spark, d):
    p = peaks(spark, d).select("sample_id", "peak_number", "rt")
    t = rt_table(spark, d)
    return J.match_modes(p, t, (0, 1, 2, 7), 0.1, 0.5).select("mode", "sample_id", "peak_number", "compound")


@query(f"""WITH {SIGNALS} SELECT sample_id, seq, round(-log10(greatest(y, 1) / 100), 6) AS absorbance FROM signals""")
def band_absorbance(spark, d):
    return signals(spark, d).select("sample_id", "seq", F.round(S.absorbance(F.col("y")), 6).alias("absorbance"))
