"""Quantitation: response factors, internal standard, and broadcast of anchor factors over a compound library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregates import shares
from .joins import deduplicated_lookup


def by_response_factor(peaks: DataFrame, factors: DataFrame, on: list[str], unit: str = "unspecified") -> DataFrame:
    """``raw_amount`` = area / factor and its percentage within each key; ``factors``: seq, compound, response_factor.

    Unassigned compounds and those without a factor are not quantitated; a factor of 0 gives 0; a total of 0 gives 0 %.
    """
    found = deduplicated_lookup(peaks, factors, "compound", "seq", ["response_factor"])
    rf = F.col("response_factor")
    raw = F.when(S.is_unassigned(F.col("compound")) | rf.isNull(), None).when(rf == 0, 0.0).otherwise(F.col("area") / rf)
    with_raw = found.withColumn("raw_amount", raw)
    total = F.sum("raw_amount").over(Window.partitionBy(*on))
    percent = F.when(F.col("raw_amount").isNull(), None).when(total == 0, 0.0).otherwise(100 * F.col("raw_amount") / total)
    out = with_raw.withColumn("composition_percent", percent).withColumn("basis", F.lit(S.RF_UNITS.get(unit, S.RF_UNITS["unspecified"])[0]))
    return out.withColumn("mol_percent", F.col("composition_percent")) if S.RF_UNITS.get(unit, S.RF_UNITS["unspecified"])[1] else out


def by_internal_standard(peaks: DataFrame, compounds: DataFrame, on: list[str], standard: str, volume_ul: float, density: float) -> DataFrame:
    """Moles, mass and percentages of each peak against the first peak named ``standard``.

    ``peaks``: compound, peak_number, area; ``compounds``: seq, compound, formula, mw. Keys without the standard keep nulls;
    every peak named like the standard has amounts but no percentages.
    """
    return by_internal_standard_known(deduplicated_lookup(peaks, compounds, "compound", "seq", ["formula", "mw"]), on, standard, volume_ul, density)


def by_internal_standard_known(found: DataFrame, on: list[str], standard: str, volume_ul: float, density: float) -> DataFrame:
    """The same for peaks that have their ``formula`` and ``mw`` already."""
    carbons = S.carbon_count(F.col("formula"))
    is_standard = S.name_matches(F.col("compound"), F.lit(standard))
    held = found.withColumn("carbons", carbons).withColumn("is_standard", is_standard)
    w = Window.partitionBy(*on)
    mol_c = S.internal_standard_mol_c(F.lit(volume_ul), F.lit(density), F.col("mw"), F.col("carbons"))
    first = F.min_by(F.struct("area", mol_c.alias("mol_c")), F.when(F.col("is_standard"), F.col("peak_number"))).over(w)
    rf = S.response_factor(F.col("__s.area"), F.col("__s.mol_c"))
    held = held.withColumn("__s", first).withColumn("rf", rf)
    held = held.withColumn("mol_c", F.try_divide("area", "rf")).withColumn("mol", F.try_divide("mol_c", "carbons"))
    held = held.withColumn("mass_mg", F.col("mol") * F.col("mw") * 1000).drop("__s")
    for v in ("mol_c", "mol", "mass_mg"):
        held = held.withColumn(f"__{v}", F.when(~F.col("is_standard"), F.col(v)))
    out = shares(held, on, {"__mol_c": "mol_c_percent", "__mol": "mol_percent", "__mass_mg": "wt_percent"})
    return out.drop("__mol_c", "__mol", "__mass_mg")


def carbon_balance(total_mg: Column, sample_mg: Column) -> Column:
    return F.when(sample_mg > 0, 100 * total_mg / sample_mg)


def broadcast_factors(peaks: DataFrame, library: DataFrame, anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """Weight percent of each peak by its anchor's factor, scaled by carbon share and molecular weight.

    ``peaks``: sample_id, compound, area; ``library``: seq, compound, c, mw, anchor; ``anchors``: seq, anchor, c, mw,
    known_wt_pct, area; ``samples``: sample_id, sample_mass_g, solvent_mass_g. Records without carbon are unmatched.
    """
    found = deduplicated_lookup(peaks, library, "compound", "seq", ["c", "mw", "anchor"])
    a = anchors.groupBy("anchor").agg(F.max_by(F.struct("c", "mw", "known_wt_pct", "area"), "seq").alias("a"))
    j = found.join(a, "anchor", "left").join(samples, "sample_id", "left")
    matched = (F.col("c") > 0) & F.col("a").isNotNull()
    rf = F.when(matched, F.col("a.known_wt_pct") / F.col("a.area") * (F.col("a.c") / F.col("c")) * (F.col("mw") / F.col("a.mw")))
    held = j.withColumn("matched", F.coalesce(matched, F.lit(False))).withColumn("rf", rf)
    wt = F.greatest(F.col("area"), F.lit(0.0)) * F.col("rf") * S.dilution_factor(F.col("sample_mass_g"), F.col("solvent_mass_g"))
    held = held.withColumn("wt_percent", wt)
    held = held.withColumn("mass_mg", F.col("wt_percent") / 100 * F.col("sample_mass_g") * 1000)
    held = held.withColumn("mol", F.col("mass_mg") / 1000 / F.col("mw")).withColumn("mol_c", F.col("mol") * F.col("c"))
    return held.drop("a", "sample_mass_g", "solvent_mass_g")
