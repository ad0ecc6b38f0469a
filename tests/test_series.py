"""Series without numbers keep their rows; limits are asked for."""

from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators import catalog, series
from drivescope.sources import columns

SERIES = "run_id long, name string, ts_ms long, seq long, value_num double"


def test_series_without_numbers(spark):
    d = spark.createDataFrame([(1, "bler", 0, 0, 7.0), (1, "bler", 1, 1, 120.0), (1, "cqi", 0, 2, None), (1, "cqi", 1, 3, float("nan"))], SERIES)
    got = {r.name: r for r in series.throughput_summary(d, value="value_num", low_threshold=10).collect()}
    assert (got["cqi"].avg, got["cqi"].median, got["cqi"].pct_below, got["cqi"].sample_count) == (None, None, None, 0)
    assert (got["bler"].avg, got["bler"].median, got["bler"].pct_below, got["bler"].sample_count) == (63.5, 7.0, 50.0, 2)
    checks = {r.name: (r.checks, r["pass"]) for r in series.sanity_check(d).collect()}
    assert checks["cqi"] == (["No numeric samples"], True) and checks["bler"][1] is False


def test_verdict_of_runs_without_pairs(spark):
    radio = spark.createDataFrame([(1, "r", 0, 0, 10.0), (2, "r", 0, 1, 5.0)], SERIES)
    app = spark.createDataFrame([(1, "a", 90_000, 2, 1.0), (3, "a", 0, 3, 2.0)], SERIES)
    got = {r.run_id: (r.flag, r.pairs, r.ratio_median, r.correlation) for r in series.mismatch_verdict(radio, app).collect()}
    assert got == {k: ("mixed", 0, None, None) for k in (1, 2, 3)}


def test_limits_are_asked_for(spark):
    rows = [(1, "Radio.X", i, i, float(i % 7)) for i in range(900)]
    d = spark.createDataFrame(rows, SERIES)
    assert catalog.signal_series(d, "Radio.X").count() == 900 and catalog.signal_series(d, "Radio.X", max_points=50).count() == 50
    assert catalog.page(d, ["run_id"], 1, 700).count() == 700
    names = spark.createDataFrame([(1, f"x{i}.Rsrp", i) for i in range(30)], "run_id long, name string, first_seq long")
    assert catalog.discover_signals(names).where("key = 'driver'").count() == 30
    assert catalog.discover_signals(names, max_drivers=24).where("key = 'driver'").count() == 24
    wide = columns.neighbor_columns(["A40_sc", "m1_rscp", "d0_sc"])
    assert set(wide) == {("A40", "UTRA"), ("M1", "UTRA")}
    cats = spark.createDataFrame([("kpi_pci", i, i, float(i % 13)) for i in range(100)], "key string, ts_ms long, seq long, value_num double")
    assert catalog.legend_bins(cats).count() == 13 and catalog.legend_bins(cats, top=8).count() == 8
    combos = F.array(*[F.lit(f"B{i}") for i in range(6)])
    r = spark.range(1).select(catalog.ca_label(F.lit(3), combos).alias("all"), catalog.ca_label(F.lit(3), combos, 4).alias("some")).first()
    assert "B5" in r["all"] and "more" not in r["all"] and "(+2 more)" in r["some"]


def test_values_as_text(spark):
    texts = ["dB-3", "3 dB", "-4.5", "dB", "x", "1e3dB", "ms320", "40", "MS 7", "ms-1", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.enum_db("t").alias("db"), S.enum_ms("t").alias("ms"))
    got = {r.t: (r.db, r.ms) for r in d.collect()}
    assert [got[t][0] for t in texts] == [-3.0, 3.0, -4.5, None, None, None, None, 40.0, None, None, None, None]
    assert [got[t][1] for t in texts] == [None, None, None, None, None, None, 320, 40, 7, None, None, None]
    tacs = {"12": 12, "70000": None, "0x1F": 31, "00AF": 175, "'00000101'B": 5, "B'00000101'": 5, "00000101B": 5, "+7": 7, "0xFFFFF": None, "'0101'B": None, "BB00000101": None, "zz": None, "0000010100000101": 0}
    rows = spark.createDataFrame([(t,) for t in tacs], "t string").select("t", S.parse_tac("t").alias("v")).collect()
    assert {r.t: r.v for r in rows} == tacs | {"0000010100000101": None}
    letters = spark.createDataFrame([("Šžőğ ąĘŵ éß",)], "t string").select(S.strip_accents_upper_alpha("t").alias("k")).first().k
    assert letters.startswith("SZOGAEWE")


def test_columns_by_rank_then_equality_then_place():
    assert columns.resolve_column(["my pci", "PCI", "Serving Cell SC"], ["servingcellsc", "pci"]) == "Serving Cell SC"
    assert columns.resolve_column(["my pci", "PCI"], ["pci"]) == "PCI"
    assert columns.resolve_column(["A2 as pci", "n1 pci", "active pci", "meas pci"], ["pci"], ["active"]) == "meas pci"
    assert columns.resolve_column(["rsrp"], ["pci"]) is None
