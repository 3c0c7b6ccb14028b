"""Method files: parameters of a run as one validated JSON document each, and their way into :class:`.operators.signal.Method`."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.signal import Method
from .. import schemas

#: Schema of a method document; whatever is not given is null and has its default in :data:`DEFAULTS`.
DOCUMENT = (
    "name string, signal_type string, created_at timestamp, smoothing struct<enabled:boolean,method:string,lambda:double,order:int,window:int,poly:int,median_kernel:int>, "
    "baseline struct<enabled:boolean,method:string,lambda:double,offset:double,breaks:array<double>>, peaks struct<enabled:boolean,min_prominence:double,min_width:double,ranges:array<array<double>>>, "
    "negatives struct<enabled:boolean,min_prominence:double>, shoulders struct<enabled:boolean,window:int,order:int,sensitivity:double,distance:int>, "
    "rt_table array<struct<compound:string,start:double,apex:double,end:double>>, rf_table array<struct<compound:string,response_factor:double>>, rf_unit string, "
    "bands array<struct<name:string,x_min:double,x_max:double>>, rt_matching struct<mode:int,tolerance:double,expansion:double,high_priority:boolean>, area_factor double, signal_factor double, detector string"
)

#: fixed values: defaults of a new method
DEFAULTS: dict[str, dict[str, Any]] = {
    "smoothing": {"enabled": False, "method": "whittaker", "lambda": 0.1, "order": 1, "window": 3, "poly": 1, "median_kernel": 5},
    "baseline": {"enabled": True, "method": "arpls", "lambda": 1e4, "offset": 0.0, "breaks": []},
    "peaks": {"enabled": False, "min_prominence": 1e5, "min_width": 0.0, "ranges": []},
    "negatives": {"enabled": False, "min_prominence": 1e5},
    "shoulders": {"enabled": False, "window": 41, "order": 3, "sensitivity": 8.0, "distance": 10},
    "rt_matching": {"mode": 0, "tolerance": 0.1, "expansion": 0.0, "high_priority": False},
}
#: fixed values: names that are the same parameter in other places
ALIASES = {"peak_splitting": "deconvolution", "prominence": "min_prominence", "lam": "lambda"}


def merged(defaults: dict, given: dict | None) -> dict:
    """``defaults`` overlaid with what is given, one level deep; None is not given."""
    return {**defaults, **{k: v for k, v in (given or {}).items() if v is not None}}


def renamed(params: dict, back: bool = False) -> dict:
    """Parameters under the names that methods use, or ``back`` under those of the forms; metadata (name, created_at) stays out."""
    names = {v: k for k, v in ALIASES.items()} if back else ALIASES
    return {names.get(k, k): v for k, v in params.items() if k not in ("name", "created_at")}


def normalised(params: dict) -> dict:
    """Parameters as the operators take them: aliases renamed, missing lists empty, the prominence under both of its names."""
    out = renamed(params)
    for name in ("breaks", "ranges"):
        out[name] = out.get(name) or []
    if "min_prominence" in out:
        out["peak_prominence"] = out["min_prominence"]
    return out


def _problems() -> Column:
    one = lambda bad, say: F.when(bad, F.lit(say))
    matching, bands = F.col("rt_matching"), F.coalesce("bands", F.array().cast("array<struct<name:string,x_min:double,x_max:double>>"))
    return F.filter(
        F.array(
            one(~F.coalesce("signal_type", F.lit("gc")).isin("gc", "gcms", "ftir", "uvvis", "gcxgc"), "unknown signal type"),
            one(~F.coalesce("rf_unit", F.lit("unspecified")).isin(*S.RF_UNITS), "unknown unit of response factors"),
            one(F.exists(bands, lambda b: b["x_max"] <= b["x_min"]), "a band ends before it begins"),
            one(F.col("smoothing.median_kernel") < 3, "median kernel under 3"),
            one(~F.col("smoothing.order").between(1, 2), "smoothing order is 1 or 2"),
            one(~F.col("shoulders.sensitivity").between(1, 10), "sensitivity is 1 to 10"),
            one(~matching["mode"].between(0, 2), "matching mode is 0 to 2"),
            one(F.col("peaks").isNotNull() & F.col("peaks.min_prominence").isNull(), "peaks lack their prominence"),
        ),
        lambda p: p.isNotNull(),
    )


def methods(spark: SparkSession, path: str) -> DataFrame:
    """All method documents under ``path``, one row each; a document that breaks a rule raises, with its name."""
    rows = spark.read.option("multiLine", True).schema(DOCUMENT).json(path)
    bad = rows.select("name", _problems().alias("problems")).filter("size(problems) > 0").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {', '.join(r.problems)}" for r in bad))
    return rows


def write_methods(rows: DataFrame, path: str) -> None:
    """One JSON line for each method; what is null is left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def method_of(row: Row) -> Method:
    """The parameters of one document for the operators; stages that are not enabled are off."""
    part = {k: merged(d, row[k].asDict() if row[k] else None) for k, d in DEFAULTS.items()}
    s, b, p, n, h = (part[k] for k in ("smoothing", "baseline", "peaks", "negatives", "shoulders"))
    options = {"whittaker": {"lam": s["lambda"], "order": s["order"]}, "savgol": {"window": s["window"], "poly": s["poly"]}, "median": {"kernel": s["median_kernel"]}}
    return Method(
        smoothing=s["method"] if s["enabled"] else None, smoothing_options=options.get(s["method"], {}) if s["enabled"] else {},
        baseline=b["method"] if b["enabled"] else None, lam=b["lambda"], offset=b["offset"], breaks=tuple(b["breaks"]),
        min_prominence=p["min_prominence"], min_width=p["min_width"], ranges=tuple(tuple(r) for r in p["ranges"]), negatives=n["enabled"], negative_prominence=n["min_prominence"],
        shoulders=h["enabled"], shoulder_window=h["window"], shoulder_order=h["order"], sensitivity=h["sensitivity"], shoulder_distance=h["distance"], area_factor=row["area_factor"],
    )


def rt_table_of(spark: SparkSession, row: Row) -> DataFrame:
    """The method's windows as a table; without any an empty one of the same types."""
    return spark.createDataFrame([(i, r.compound, r.start, r.apex, r.end) for i, r in enumerate(row["rt_table"] or [])], schemas.RT_TABLE)


def processing_record(rows: DataFrame) -> DataFrame:
    """``name`` and ``record``: the JSON of what is on, without nulls and without the parameters of stages that are off."""
    stages = [F.when(F.coalesce(F.col(f"{k}.enabled"), F.lit(d["enabled"])), F.col(k)).alias(k) for k, d in DEFAULTS.items() if "enabled" in d]
    return rows.select("name", F.to_json(F.struct("signal_type", *stages, "rt_matching", "rf_unit", "area_factor", "signal_factor"), {"ignoreNullFields": "true"}).alias("record"))
