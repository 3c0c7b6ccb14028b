"""Column functions of the domain: formulas, registry numbers, names, quantities. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: atomic weights of C, H, O, S, N and the registry number that means "not known"
WEIGHTS = {"c": 12.0107, "h": 1.0079, "o": 15.9994, "s": 32.065, "n": 14.0067}
SENTINEL_CAS = "000000-00-0"
#: fixed values: unit of the response factor -> (label of the percentage, whether mol % is written too)
RF_UNITS = {"area_per_mol": ("mol%", True), "area_per_mol_c": ("mol C%", True), "area_per_mass": ("wt%", False), "area_per_volume": ("vol%", False), "unspecified": ("unspecified", True)}


def carbon_count(formula: Column) -> Column:
    """Carbons by the first ``C`` of a formula: its digits, 1 without digits, null without any C."""
    digits = F.regexp_extract(formula, "C([0-9]*)", 1)
    return F.when(formula.contains("C"), F.coalesce(F.when(digits == "", None).otherwise(digits), F.lit("1")).cast("int"))


def cas_format(number: Column) -> Column:
    """Digits padded to nine and written 6-2-1; null and empty give the empty text."""
    padded = F.when(F.length(number) >= 9, number).otherwise(F.lpad(number, 9, "0"))
    cut = F.length(padded)
    text = F.concat_ws("-", F.substring(padded, F.lit(1), cut - 3), F.substring(padded, cut - 2, F.lit(2)), F.substring(padded, cut, F.lit(1)))
    return F.when(number.isNull() | (number == ""), "").otherwise(text)


def cas_pad(cas: Column) -> Column:
    """Three parts with a whole number first are padded to six digits there; anything else is only trimmed."""
    text = F.trim(cas)
    parts = F.split(text, "-")
    whole = (F.size(parts) == 3) & parts[0].rlike("^[0-9]+$")
    head = F.when(F.length(parts[0]) >= 6, parts[0]).otherwise(F.lpad(parts[0], 6, "0"))
    return F.when(whole, F.concat_ws("-", head, parts[1], parts[2])).otherwise(text)


def cas_state(cas: Column) -> Column:
    """``empty``, ``valid`` or ``malformed``."""
    text = F.trim(F.coalesce(cas, F.lit("")))
    parts = F.split(text, "-")
    return F.when(text == "", "empty").when((F.size(parts) == 3) & parts[0].rlike("^[0-9]+$"), "valid").otherwise("malformed")


def unmatched_reason(cas: Column, has_record: Column) -> Column:
    """Why a peak found no record: malformed number, sentinel, no record at all, or a number the library lacks."""
    padded = cas_pad(F.coalesce(cas, F.lit("")))
    return (
        F.when(has_record, None)
        .when(cas_state(cas) == "malformed", "malformed_cas")
        .when(padded == SENTINEL_CAS, "sentinel_cas")
        .when(padded == "", "no_record")
        .otherwise("no_cas_match")
    )


def is_unassigned(compound: Column) -> Column:
    """Null, blank, ``unknown`` in any case, or ``Unknown (1.234)``."""
    text = F.trim(compound)
    return F.coalesce(compound.isNull() | (text == "") | (F.lower(text) == "unknown") | text.rlike(r"^Unknown \([0-9]+\.[0-9]+\)$"), F.lit(True))


def unknown_label(rt: Column) -> Column:
    return F.format_string("Unknown (%.3f)", rt)


def name_matches(a: Column, b: Column) -> Column:
    """Equal after trimming and lower-casing; null matches nothing."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def molecular_weight(c: Column, h: Column, o: Column, s: Column, n: Column) -> Column:
    counts = {"c": c, "h": h, "o": o, "s": s, "n": n}
    return sum((F.coalesce(v, F.lit(0)) * F.lit(WEIGHTS[k]) for k, v in counts.items()), F.lit(0.0))


def internal_standard_mol_c(volume_ul: Column, density: Column, weight: Column, carbons: Column) -> Column:
    """Moles of carbon of an internal standard; null where a value is missing or it has no carbon."""
    return F.when(carbons > 0, F.try_divide(volume_ul * 1e-3 * density, weight) * carbons)


def response_factor(area: Column, mol_c: Column) -> Column:
    return F.when((area > 0) & (mol_c > 0), F.try_divide(area, mol_c))


def sample_mass_mg(volume_ul: Column, density: Column) -> Column:
    return volume_ul * 1e-3 * density * 1000


def input_problem(volume_ul: Column, density: Column, weight: Column) -> Column:
    """The first problem with the values of an internal standard; null if there is none."""
    return (
        F.when(volume_ul.isNull() | (volume_ul <= 0) | (volume_ul > 1000), "volume")
        .when(density.isNull() | (density < 0.5) | (density > 2), "density")
        .when(weight.isNull() | (weight < 12), "molecular weight")
    )


def dilution_factor(sample_g: Column, solvent_g: Column) -> Column:
    """(sample + solvent) / sample; raises where the sample is not positive or the solvent negative."""
    bad = (sample_g <= 0) | (solvent_g < 0)
    return F.when(bad, F.raise_error(F.lit("sample mass must be positive and solvent mass not negative")).cast("double")).otherwise((sample_g + solvent_g) / sample_g)


def gaussian(x: Column, height: Column, centre: Column, sigma: Column, base: Column | None = None) -> Column:
    curve = height * F.exp(-((x - centre) * (x - centre)) / (2 * sigma * sigma))
    return curve if base is None else curve + base


def sensitivity_snr(sensitivity: Column) -> Column:
    """Signal-to-noise from sensitivity 1 to 10; values below 1 are the older height scale."""
    return F.when(sensitivity >= 1, 8 - (sensitivity - 1) * 5.5 / 9).otherwise(3 + (sensitivity - 0.01) * 7 / 0.09)


def prominence_limit(p: Column, low: Column, high: Column) -> Column:
    """Above 1 a prominence is absolute, up to 1 a share of the signal's range."""
    return F.when(p > 1, p).otherwise(p * (high - low))


def rf_basis(unit: Column) -> Column:
    out = F.lit(RF_UNITS["unspecified"][0])
    for code, (label, _) in RF_UNITS.items():
        out = F.when(unit == code, label).otherwise(out)
    return out


def signal_type(has_ms: Column) -> Column:
    return F.when(has_ms, "gcms").otherwise("gc")


def scaled_area(area: Column, factor: Column) -> Column:
    """Absolute area times its factor; a missing factor and zero count as 1."""
    return F.abs(area * F.coalesce(F.when(factor == 0, None).otherwise(factor), F.lit(1.0)))


def method_name(text: Column) -> Column:
    """What stands before ``.M``."""
    return F.split(text, r"\.M")[0]


#: fixed values: accepted time formats, in order
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MMM-yy, HH:mm:ss", "dd MMM yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyyMMdd_HHmmss", "yyyyMMdd")


def timestamp_parsed(text: Column) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))


def filename_timestamp(name: Column) -> Column:
    """A time in a file name: yyyymmdd_hhmmss, yyyy-mm-dd_hh-mm-ss, yyyymmdd or yyyy-mm-dd."""
    pairs = ((r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"), (r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", "yyyy-MM-dd_HH-mm-ss"), (r"(\d{8})", "yyyyMMdd"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"))
    return F.coalesce(*(F.try_to_timestamp(F.regexp_extract(name, p, 1), F.lit(f)) for p, f in pairs))


def sheet_name(raw: Column) -> Column:
    """A name a spreadsheet accepts: forbidden characters go, at most 31 stay, blank is ``Sheet``."""
    clean = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]:*?/\\]", ""))
    return F.when(clean == "", "Sheet").otherwise(F.substring(clean, 1, 31))


def timestamp_formatted(text: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time in another format; text that is no time passes as it is."""
    return F.coalesce(F.date_format(timestamp_parsed(text), form), text)


#: Fields a peak's record always has; others only where they are not null.
RECORD_FIELDS = ("compound_id", "peak_number", "retention_time", "integrator", "width", "area", "start_time", "end_time", "is_shoulder", "is_negative", "is_convoluted", "quality_issues")


def peak_record(columns: list[str]) -> Column:
    """A peak as JSON, optional fields only where they are not null; what must be there is there as null at least."""
    fixed = [c for c in RECORD_FIELDS if c in columns]
    always, some = F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}), F.to_json(F.struct(*(c for c in columns if c not in fixed)), {"ignoreNullFields": "true"})
    return F.when(some == "{}", always).otherwise(F.concat(F.regexp_replace(always, r"\}$", ","), F.substring(some, 2, 1 << 30))) if len(fixed) < len(columns) else always


def peak_from_record(record: Column, schema: str) -> Column:
    """The peak of a record; fields that it lacks are null."""
    return F.from_json(record, schema)


def apex_distance(least: Column, width: Column, share: float = 0.03, pixels: int = 256) -> Column:
    """Least distance of apexes in pixels of a window: ``least`` or ``share`` of time, whichever is more."""
    return F.greatest(least, F.ceil(F.lit(share) / width * pixels))


def absorbance(transmittance: Column) -> Column:
    """Absorbance of a transmittance in percent, which counts as 1 at least."""
    return -F.log10(F.greatest(transmittance, F.lit(1.0)) / 100)
