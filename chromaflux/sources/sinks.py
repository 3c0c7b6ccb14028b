"""Writers: result documents, flat files, tables and keyed updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def documents(peaks: DataFrame, path: str, run: list[str]) -> None:
    """One JSON line for each run: its columns ``run`` and its ``peaks`` by number; nulls are left out."""
    rest = [c for c in peaks.columns if c not in run]
    peaks.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("peaks")).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def flat(rows: DataFrame, path: str) -> None:
    """Delimited with a header; arrays are joined by commas."""
    plain = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*plain).write.mode("overwrite").option("header", True).csv(path)


def rf_table(factors: DataFrame, path: str, unit: str) -> None:
    """Two columns under a comment with the unit."""
    lines = factors.select(F.concat_ws(",", F.concat(F.lit('"'), F.regexp_replace("compound", '"', '""'), F.lit('"')), F.col("response_factor").cast("string")).alias("value"), F.lit(2).alias("o"), "seq")
    head = factors.sparkSession.createDataFrame([(f"# rf_unit: {unit}", 0, 0), ("compound,response_factor", 1, 0)], "value string, o int, seq long")
    head.unionByName(lines.withColumn("seq", F.col("seq").cast("long"))).orderBy("o", "seq").coalesce(1).select("value").write.mode("overwrite").text(path)  # a method's table, small by nature


def upserted(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows of both; of a key the latest by ``at``, the new one on ties."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), F.desc("__n")))).filter("__r = 1").drop("__r", "__n")


def summary(peaks: DataFrame, samples: list[str]) -> DataFrame:
    """Groups by samples, missing as 0, the total first and then by name: peaks has sample_id, group, wt_percent."""
    wide = peaks.groupBy("group").pivot("sample_id", samples).agg(F.sum("wt_percent")).na.fill(0.0)
    return wide.orderBy(F.when(F.col("group") == "Total", 0).otherwise(1), "group")


def updated_ids(peaks: DataFrame, ids: DataFrame) -> DataFrame:
    """``compound_id`` replaced by (sample_id, peak_number); ``changed`` tells which runs have to be written again."""
    new = ids.select("sample_id", "peak_number", F.col("compound_id").alias("__new"))
    j = peaks.join(new, ["sample_id", "peak_number"], "left")
    diff = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("compound_id"))
    changed = F.max(diff).over(Window.partitionBy("sample_id"))
    return j.withColumn("changed", changed).withColumn("compound_id", F.coalesce("__new", "compound_id")).drop("__new").select(*peaks.columns, "changed")


def container_results(features: DataFrame, manifest: DataFrame, path: str) -> None:
    """``features.json`` (manifest, parameters and features of each run as one line) and ``features.csv`` (all columns; left out where there are no rows)."""
    rows = features.groupBy("sample_id").agg(F.collect_list(F.struct(*(c for c in features.columns if c != "sample_id"))).alias("features"))
    manifest.join(rows, "sample_id", "left").write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/features.json")
    if not features.isEmpty():
        flat(features, f"{path}/features.csv")


def aligned(resampled: DataFrame, channels: list[str]) -> DataFrame:
    """One row a place of the common grid (sample_id, i, x) and a column for each channel; NaN and missing are null. resampled: sample_id, i, x, channel, y."""
    return resampled.groupBy("sample_id", "i", "x").pivot("channel", channels).agg(F.first(F.when(~F.isnan("y"), F.col("y"))))


def rt_table(windows: DataFrame, path: str, as_json: bool = False) -> None:
    """Windows of a method as a delimited table (Compound, Start, Apex, End) or as one document with ``compounds``."""
    if as_json:
        entry = F.struct("seq", "compound", "start", "apex", "end")
        windows.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda c: c.dropFields("seq")).alias("compounds")).coalesce(1).write.mode("overwrite").json(path)  # a method's table, small by nature
        return
    named = windows.orderBy("seq").select(F.col("compound").alias("Compound"), F.col("start").alias("Start"), F.col("apex").alias("Apex"), F.col("end").alias("End"))
    named.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Entries of one document.
DOCUMENT = 100_000


def sidecar(entries: DataFrame, path: str, key: str) -> None:
    """Entries as a document keyed by ``key``, what :func:`.tables.offsets` and :func:`.tables.overrides` read.

    A file holds one document; beyond ``DOCUMENT`` entries there are more files, each with its own keys.
    """
    files = -(-entries.count() // DOCUMENT) or 1
    rest = F.struct(*(c for c in entries.columns if c != key))
    held = entries.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(files)).alias("part"), F.struct(F.col(key).cast("string").alias("k"), rest.alias("v")).alias("e"))
    documents = held.groupBy("part").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list("e"))), {"ignoreNullFields": "true"}).alias("value"))
    if files == 1:
        documents.select("value").coalesce(1).write.mode("overwrite").text(path)
    else:
        documents.write.mode("overwrite").partitionBy("part").text(path)


def overrides(assignments: DataFrame, path: str, earlier: DataFrame | None = None, places: int = 4, strongest: int | None = None) -> None:
    """Manual assignments (seq, retention_time, compound, spectrum: ions as mz and intensity, or null) upserted into ``earlier`` ones and written, keyed by the time with ``places`` decimals.

    Of one key the last by ``seq`` stays, a new one before an earlier one. ``strongest`` keeps so many ions of a spectrum, by
    intensity, then mass. ``earlier`` is what :func:`.tables.overrides` gives; it may not be read from ``path`` itself.
    """
    ions = F.col("spectrum")
    if strongest is not None:
        ranked = F.sort_array(F.transform(ions, lambda p: F.struct((-p["intensity"]).alias("o"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))
        ions = F.transform(F.slice(ranked, 1, strongest), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    entry = lambda age, time: (F.format_string(f"%.{places}f", time).alias("key"), F.lit(age).alias("age"), F.col("seq").cast("long").alias("seq"), F.col("compound").alias("compound_name"))
    rows = assignments.select(*entry(1, F.col("retention_time").cast("double")), ions.alias("spectrum"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(*entry(0, F.col("override_rt")), "spectrum"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("compound_name", "spectrum"), F.struct("age", "seq")).alias("v"))
    sidecar(last.select("key", "v.*"), path, "key")


def export(peaks: DataFrame, path: str, form: str = "json") -> None:
    """Peaks as result documents, delimited text or a table, by name; another form raises."""
    if form == "json":
        documents(peaks, path, ["sample_id"])
    elif form == "csv":
        flat(peaks, path)
    elif form == "parquet":
        peaks.write.mode("overwrite").partitionBy("sample_id").parquet(path) if peaks.select("sample_id").distinct().limit(1001).count() <= 1000 else peaks.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def library_table(library: DataFrame, path: str) -> None:
    """A compound library as delimited text, in the columns that :func:`.tables.compounds` reads."""
    library.select("compound", "cas", "group1", "group2", "group3", "c", "h", "o", "s", "n", "anchor").write.mode("overwrite").option("header", True).csv(path)
