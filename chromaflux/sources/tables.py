"""Readers of method tables, signals and results, with the checks their formats ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: fixed values: accepted headers of response-factor tables
COMPOUND_HEADERS = ("compound", "name", "compound_name", "compound name")
FACTOR_HEADERS = ("response_factor", "rf", "response factor", "factor")


def _named(df: DataFrame, accepted: tuple[str, ...]) -> Column | None:
    return next((F.col(f"`{c}`") for c in df.columns if c.strip().lower() in accepted), None)


def _refuse(df: DataFrame, bad: Column, say: str) -> None:
    rows = df.filter(bad).limit(5).collect()
    if rows:
        raise ValueError(f"{say}: {[tuple(r) for r in rows]}")


def rt_table(spark: SparkSession, path: str) -> DataFrame:
    """Compound, Start, Apex, End; the three-column form has its apex in the middle. Windows must hold their apex; blank names go."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    if not {"compound", "start", "end"} <= set(by):
        raise ValueError(f"columns are {raw.columns}")
    start, end = by["start"].cast("double"), by["end"].cast("double")
    apex = by["apex"].cast("double") if "apex" in by else (start + end) / 2
    t = raw.select(F.monotonically_increasing_id().alias("seq"), F.trim(by["compound"]).alias("compound"), start.alias("start"), apex.alias("apex"), end.alias("end"))
    _refuse(t, F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end")) | ~F.col("apex").between(F.col("start"), F.col("end")), "windows without a valid apex")
    return t.filter("coalesce(compound, '') <> ''")


def rt_table_json(spark: SparkSession, path: str) -> DataFrame:
    """``compounds[]`` with the current or the older key names; blank names are skipped before the check."""
    item = "struct<compound:string,name:string,start:double,rt_start:double,apex:double,rt_apex:double,end:double,rt_end:double>"
    raw = spark.read.option("multiLine", True).schema(f"compounds array<{item}>").json(path).select(F.posexplode("compounds").alias("seq", "c"))
    start, end = F.coalesce("c.start", "c.rt_start"), F.coalesce("c.end", "c.rt_end")
    t = raw.select(F.col("seq").cast("long").alias("seq"), F.trim(F.coalesce("c.compound", "c.name")).alias("compound"), start.alias("start"), F.coalesce("c.apex", "c.rt_apex", (start + end) / 2).alias("apex"), end.alias("end"))
    t = t.filter("coalesce(compound, '') <> ''")
    _refuse(t, F.col("start").isNull() | (F.col("start") >= F.col("end")) | ~F.col("apex").between(F.col("start"), F.col("end")), "windows without a valid apex")
    return t


def rf_table(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Response factors and their unit: an optional first line ``# rf_unit: code``; rows that lack a value are skipped."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0].value if first else ""
    unit = head.partition("rf_unit:")[2].strip() if head.startswith("#") else ""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    compound, factor = _named(raw, COMPOUND_HEADERS), _named(raw, FACTOR_HEADERS)
    if compound is None or factor is None:
        raise ValueError(f"columns are {raw.columns}")
    t = raw.select(F.monotonically_increasing_id().alias("seq"), F.trim(compound).alias("compound"), factor.try_cast("double").alias("response_factor"))
    return t.filter("coalesce(compound, '') <> '' and response_factor is not null"), unit if unit in S.RF_UNITS else "unspecified"


def compounds(spark: SparkSession, path: str) -> DataFrame:
    """A compound library; blank atom counts are 0, others must be whole; the weight comes from the counts, not the file."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    atoms = {a: F.coalesce(F.when(F.trim(by[a]) == "", "0").otherwise(F.trim(by[a])), F.lit("0")) for a in ("c", "h", "o", "s", "n")}
    checked = raw.select(*(v.alias(a) for a, v in atoms.items()))
    bad = F.lit(False)
    for a in atoms:
        bad = bad | ~F.col(a).rlike("^[0-9]+$")
    _refuse(checked, bad, "atom counts must be whole")
    text = [F.trim(by[k]).alias(k) for k in ("compound", "cas", "group1", "group2", "group3", "anchor")]
    t = raw.select(F.monotonically_increasing_id().alias("seq"), *text, *(v.cast("int").alias(a) for a, v in atoms.items()))
    return t.withColumn("mw", S.molecular_weight(*(F.col(a) for a in ("c", "h", "o", "s", "n")))).withColumn("cas", S.cas_pad(F.col("cas")))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Anchors; of one named twice the last row counts. Missing names and bad numbers raise."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    t = raw.select(F.monotonically_increasing_id().alias("seq"), F.trim(by["anchor"]).alias("anchor"), *(by[k].try_cast("double").alias(k) for k in ("c", "mw", "area", "known_wt_pct")))
    missing = F.coalesce(F.col("anchor"), F.lit("")) == ""
    for k in ("c", "mw", "area", "known_wt_pct"):
        missing = missing | F.col(k).isNull()
    _refuse(t, missing | (F.col("area") <= 0) | (F.col("known_wt_pct") < 0), "calibration rows")
    return t.groupBy("anchor").agg(F.max_by(F.struct("seq", "c", "mw", "known_wt_pct", "area"), "seq").alias("r")).select("anchor", "r.*")


def csv_signal(spark: SparkSession, path: str, x: str | int = 0, y: str | int = 1, header: bool = True) -> DataFrame:
    """sample_id (file name), seq, x, y of delimited files; columns by name or place. A column that isn't there raises KeyError."""
    raw = spark.read.option("header", header).csv(path)

    def pick(c: str | int) -> Column:
        if isinstance(c, int):
            if not -len(raw.columns) <= c < len(raw.columns):
                raise KeyError(c)
            return F.col(f"`{raw.columns[c]}`")
        if c not in raw.columns:
            raise KeyError(c)
        return F.col(f"`{c}`")

    t = raw.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(?:\\.[^./]*)?$", 1).alias("sample_id"), F.monotonically_increasing_id().alias("__o"), pick(x).cast("double").alias("x"), pick(y).cast("double").alias("y"))
    from pyspark.sql import Window

    return t.withColumn("seq", F.row_number().over(Window.partitionBy("sample_id").orderBy("__o")) - 1).select("sample_id", "seq", "x", "y")


def infrared_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without header, and the time in each file's name."""
    return csv_signal(spark, path, header=False).withColumn("time", S.filename_timestamp(F.col("sample_id")))


def ultraviolet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide files: five rows of settings (integration time, averages, labels, numbers, times), then wavelength and one column a spectrum.

    Returns sample_id, spectrum, time (null where it can't be read), integration_ms, wavelength, absorbance.
    """
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(?:\\.[^./]*)?$", 1).alias("sample_id"), F.split(F.rtrim("value"), "\r?\n").alias("rows"))
    cells = lambda i: F.split(F.col("rows")[i], ",")
    head = lines.select("sample_id", cells(0).alias("ms"), cells(4).alias("times"), F.explode(F.slice("rows", F.lit(6), F.greatest(F.size("rows") - 5, F.lit(0)))).alias("line"))
    row = head.select("sample_id", "ms", "times", F.split("line", ",").alias("v"))
    each = row.select("sample_id", "ms", "times", F.col("v")[0].try_cast("double").alias("wavelength"), F.posexplode("v").alias("k", "a")).filter("k > 0")
    time = F.try_to_timestamp(F.trim(F.get("times", F.col("k"))), F.lit("dd/MM/yyyy HH:mm:ss"))
    return each.select("sample_id", F.col("k").alias("spectrum"), time.alias("time"), F.get("ms", F.col("k")).try_cast("double").alias("integration_ms"), "wavelength", F.col("a").try_cast("double").alias("absorbance"))


def ultraviolet_signal(spark: SparkSession, path: str) -> DataFrame:
    """The spectra of :func:`ultraviolet_csv` as signals: sample_id (file name, ``#``, number of the spectrum), seq, x (wavelength), y.

    Places without a wavelength or a value are left out.
    """
    from pyspark.sql import Window

    rows = ultraviolet_csv(spark, path).filter("wavelength is not null and absorbance is not null")
    named = rows.select(F.concat_ws("#", "sample_id", "spectrum").alias("sample_id"), F.col("wavelength").alias("x"), F.col("absorbance").alias("y"))
    return named.select("sample_id", (F.row_number().over(Window.partitionBy("sample_id").orderBy("x")) - 1).cast("long").alias("seq"), "x", "y")


RESULT = "sample_id string, timestamp string, method string, detector string, signal string, notebook string, peaks array<struct<peak_number:int,compound_id:string,casno string,retention_time:double,area:double,Qual:double>>".replace("casno string", "casno:string")


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Peaks of result documents, one row each, whatever folder they lie in; hidden files and manifests are skipped.

    A file holds one document, or one on each line if ``lines`` (what :func:`chromaflux.sources.sinks.documents` writes).
    """
    docs = spark.read.option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(RESULT).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    kept = docs.filter(~name.startswith("._") & (name != "manifest.json"))
    return kept.select("sample_id", S.timestamp_parsed(F.col("timestamp")).alias("time"), S.method_name(F.col("method")).alias("method"), "detector", "notebook", F.explode_outer("peaks").alias("p")).select("*", "p.*").drop("p")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Time offsets by run; anything malformed counts as no entry."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode_outer(F.from_json("value", "map<string,struct<offset_min:double,timestamp:double,source:string>>")).alias("path", "v"))
    return entries.select("path", "v.*").filter("path is not null and offset_min is not null")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual assignments keyed by retention time, in the order of the file."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,struct<compound_name:string,spectrum:array<struct<mz:double,intensity:double>>>>"))).alias("seq", "e"))
    return entries.select("seq", F.col("e.key").try_cast("double").alias("override_rt"), F.col("e.value.compound_name").alias("compound"), F.col("e.value.spectrum").alias("spectrum")).filter("override_rt is not null")


LIBRARY_ITEM = "struct<casno:string,formula:string,mw:double,mz:array<double>,intensity:array<double>>"


def spectral_library(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """A spectral library: id, name, casno, formula, mw, mz, intensity (long). ``cache``, where it is there, is read instead (Parquet)."""
    if cache:
        files = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            return spark.read.parquet(cache)
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{LIBRARY_ITEM}>"))).alias("id", "e"))
    named = entries.select(F.col("id").cast("long").alias("id"), F.col("e.key").alias("name"), "e.value.*")
    ions = named.select("id", "name", "casno", "formula", "mw", F.inline(F.arrays_zip("mz", "intensity")))
    return ions.filter("mz is not null and intensity is not null")


def batch_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Peaks of one result document for each sample id; a document without peaks has one row of nulls."""
    name = F.create_map(*(x for k, p in paths.items() for x in (F.lit(p.rpartition("/")[2]), F.lit(k))))
    docs = spark.read.option("multiLine", True).schema(RESULT).json(list(paths.values())).withColumn("__file", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)))
    return docs.select(name[F.col("__file")].alias("sample_id"), "detector", F.explode_outer("peaks").alias("p")).select("sample_id", "detector", "p.*")


#: fixed values: keys of a container's manifest that a result carries
MANIFEST_KEYS = ("sample_id", "timestamp", "method", "notebook", "detector")


def containers(spark: SparkSession, path: str) -> DataFrame:
    """Sample containers under ``path``: folder, signal_type, source_format, csv_columns and the metadata keys, missing ones empty.

    A manifest without a signal type raises.
    """
    schema = "signal_type string, source_format string, csv_columns map<string,string>, " + ", ".join(f"{k} string" for k in MANIFEST_KEYS)
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").schema(schema).json(path)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]+$", 1).alias("folder"), "signal_type", "source_format", "csv_columns", *(F.coalesce(k, F.lit("")).alias(k) for k in MANIFEST_KEYS))
    _refuse(rows.select("folder", "signal_type"), F.col("signal_type").isNull(), "manifests without a signal type")
    return rows


def run_metadata(runs: DataFrame, fallback: str = "") -> DataFrame:
    """timestamp, method and notebook of each run (sample_id, detector_metadata, directory_metadata: maps): detector's, then directory's, then a default."""
    pick = lambda key, last: F.coalesce(F.col("detector_metadata")[key], F.col("directory_metadata")[key], last).alias(key)
    return runs.select("sample_id", pick("timestamp", F.lit(fallback)), pick("method", F.lit("Unknown")), pick("notebook", F.col("sample_id")))


def siblings(runs: DataFrame) -> DataFrame:
    """``runs`` (path) with their ``parent``, ``place`` among the runs of that folder (from 0) and how many there are."""
    parent = F.regexp_extract("path", "^(.*?)/?[^/]+/?$", 1)
    w = Window.partitionBy("parent")
    held = runs.withColumn("parent", parent)
    return held.withColumn("place", F.row_number().over(w.orderBy("path")) - 1).withColumn("siblings", F.count("*").over(w))


def file_groups(files: DataFrame) -> DataFrame:
    """Groups of files (path) of two-dimensional runs: by the name of an ``.rsd`` file those that begin with it, where an ``.dbc.lsc`` is among them.

    Files meet names by folder and by each of their own beginnings, so no pair of other files is formed.
    """
    named = files.select("path", F.regexp_extract("path", "^(.*?)/?[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    stems = named.filter("name like '%.rsd'").select("folder", F.expr("substring(name, 1, length(name) - 4)").alias("stem"))
    ahead = named.select("path", "folder", "name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("stem"))
    grouped = ahead.join(stems, ["folder", "stem"]).groupBy("folder", "stem").agg(F.sort_array(F.collect_set("path")).alias("files"), F.bool_or(F.col("name").endswith(".dbc.lsc")).alias("__both"))
    return grouped.filter("__both").drop("__both")


def export_signals(samples: DataFrame, runs: DataFrame, channels: list[str]) -> DataFrame:
    """Samples of the asked channels with the run's ``title``: notebook of the detector, then of the directory, then its name, then its folder."""
    title = F.coalesce(F.col("detector_metadata")["notebook"], F.col("directory_metadata")["notebook"], "name", F.regexp_extract("path", "([^/]+?)/*$", 1))
    return samples.filter(F.col("channel").isin(channels)).join(runs.select("sample_id", title.alias("title")), "sample_id", "left")
