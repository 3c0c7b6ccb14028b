"""Manual assignments: keys, upserts, strongest ions, and back."""

from chromaflux.sources import sinks, tables

SCHEMA = "seq int, retention_time double, compound string, spectrum array<struct<mz:double,intensity:double>>"


def read(spark, path):
    return {round(r.override_rt, 4): (r.compound, [tuple(p) for p in r.spectrum or []]) for r in tables.overrides(spark, path).collect()}


def test_upserts_by_key(spark, tmp_path):
    first, second = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    ions = [(float(m), float(m % 7)) for m in range(40, 70)]
    rows = [(0, 1.23456, "early", None), (1, 1.23462, "late", ions), (2, 2.5, "other", None)]
    sinks.overrides(spark.createDataFrame(rows, SCHEMA), first, strongest=20)
    got = read(spark, first)
    strongest = sorted(ions, key=lambda p: (-p[1], p[0]))[:20]
    assert got == {1.2346: ("late", strongest), 2.5: ("other", [])}
    sinks.overrides(spark.createDataFrame([(0, 2.50004, "newer", None), (1, 3.0, "third", ions[:2])], SCHEMA), second, tables.overrides(spark, first))
    assert read(spark, second) == {1.2346: ("late", strongest), 2.5: ("newer", []), 3.0: ("third", ions[:2])}


def test_three_decimals(spark, tmp_path):
    rows = [(0, 1.0004, "a", None), (1, 1.0001, "b", None), (2, 1.0006, "c", None)]
    sinks.overrides(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", places=3)
    assert read(spark, f"file://{tmp_path}/a") == {1.0: ("b", []), 1.001: ("c", [])}
