"""Extended overlap profile, second source, deep analysis by downlink interference, core metrics by technology."""

import pytest
from pyspark.sql import functions as F

from drivescope.operators import catalog, radio, sessions

BASE = {
    "two_pilot_rows": 10, "gap_coverage": 0.5, "gap_median": 1.0, "gap_low_ratio": 0.9, "gap_std": 3.0, "pilots_max": 3, "pilots_mean": 2.6, "psc_switches": 4, "bler_max": 10.0, "ecno_median": -8.0,
    "rscp_median": -80.0, "tx_p90": 20.0, "strong_share": 0.1,
}
KINDS = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in BASE.items())


def scored(spark, profile, **changes):
    row = {**BASE, **changes}
    return radio.pilot_pollution_score(spark.createDataFrame([tuple(row.values())], KINDS), profile).first()


@pytest.mark.parametrize(("changes", "label", "score"), [
    ({}, "High overlap / poor dominance under strong coverage", 100),
    ({"rscp_median": -92.0}, "High overlap / poor dominance under fair coverage", 100),
    ({"rscp_median": None}, "High overlap / poor dominance under weak coverage", 100),
    ({"gap_median": 2.5, "strong_share": 0.9}, "Overlap risk", 70),
    ({"gap_median": 4.0, "strong_share": 0.9}, "Low overlap risk", 70),
    ({"gap_median": 6.0, "gap_low_ratio": 0.2}, "Low overlap risk (strong dominance)", 20),
    ({"gap_median": 7.0, "gap_low_ratio": 0.1, "bler_max": 90.0, "tx_p90": 10.0}, "DL Interference (strong dominance, overlap unlikely)", 20),
    ({"gap_median": 4.0, "bler_max": 90.0, "tx_p90": 10.0}, "Pilot Pollution / DL Interference", 70),
    ({"gap_coverage": 0.1, "bler_max": 90.0, "tx_p90": 10.0}, "DL Interference (dominance evidence unavailable)", 70),
    ({"two_pilot_rows": 0, "gap_coverage": None, "gap_median": None}, "Dominance unavailable / low interference risk", 20),
])
def test_extended_labels(spark, changes, label, score):
    r = scored(spark, "extended", **changes)
    assert (r.pollution_label, r.pollution_score) == (label, score)


def test_limits_by_profile(spark):
    few = {"gap_coverage": 0.1, "pilots_mean": 2.4, "psc_switches": 3}
    assert scored(spark, "default", **few).dominance_score == 50 and scored(spark, "extended", **few).dominance_score == 10


def test_second_source(spark):
    anchors = spark.createDataFrame([(1, 1, 10_000), (2, 1, 10_000), (3, 1, 10_000), (4, 1, None), (5, 1, 10_000)], "device_id long, call_id long, end_ts long")
    cells = spark.createDataFrame(
        [(1, 9000, 2, 0, 2.0), (1, 9500, 2, 0, 4.0), (1, 9600, 1, 1, None), (1, 100_000, 2, 0, 50.0), (2, 9000, 0, 3, 9.0), (3, 9000, 1, 0, None), (4, 9000, 2, 0, 1.0)],
        "device_id long, ts_ms long, pilots_a long, pilots_b long, gap double")
    r = {x.device_id: x for x in radio.cell_corroboration(anchors, cells, window_ms=5000).collect()}
    assert (r[1].cell_rows, r[1].cell_gaps, r[1].cell_gap_median, r[1].cell_gap_low_ratio, r[1].cell_reason) == (3, 2, 3.0, 0.5, None)
    assert [r[i].cell_reason for i in (2, 3, 4, 5)] == [radio.CELL_REASONS[k] for k in ("no levels", "one pilot", "no rows", "no rows")]


def test_downlink_interference_has_its_own_points(spark):
    row = (1, "SETUP_FAIL_DL_INTERFERENCE", -85.0, -13.0, 12.0, 96.0, False, None, 27, 1000, None, None)
    d = spark.createDataFrame([row, (2, "SETUP_TIMEOUT", *row[2:7], 5, 102, None, 2000, None)],
                              "call_id long, category string, rscp_median double, ecno_median double, tx_p90 double, bler_max double, bler_evidence boolean, connected_ts long, cad_cause long, end_ts_caf long, "
                              "end_ts_cad long, end_ts_care long")
    event = "struct<ts_ms:bigint,seq:bigint,header:string,raw:string>"
    for c in ("first_events", "last_events"):
        d = d.withColumn(c, F.lit(None).cast(f"array<{event}>"))
    for c in ("closest_release", "closest_mobility"):
        d = d.withColumn(c, F.lit(None).cast(event))
    r = {x.call_id: x for x in sessions.setup_failure_deep_analysis(d).collect()}
    assert r[1].deep_breakdown == {"bler_very_high": 50, "uplink_not_limited": 20, "coverage_acceptable": 15, "ecno_degraded": 15} and r[1].deep_score == 100 and r[1].terminal_marker == "CAF"
    assert r[2].deep_breakdown == {"no_mobility": 10, "no_congestion": 10} and r[2].deep_score == 20 and r[2].terminal_marker == "CAD"


def test_core_metrics_by_tech(spark):
    names = ["Nr.ServingCell.Ss-Rsrp", "Nr.Neighbor.Ss-Rsrp", "Wcdma.Rscp", "Wcdma.EcNo.Rscp", "X.Sinr", "Pdsch.Throughput"]
    d = spark.createDataFrame([(t, n, i) for t in ("5G NR", "UMTS 3G", None) for i, n in enumerate(names)], "tech string, name string, position long")
    rows = {}
    for x in catalog.core_metrics_by_tech(d, F.col("tech"), ["tech"]).collect():
        rows.setdefault(x.tech, {})[x.slot] = x.name
    assert rows["5G NR"] == {"rsrp": names[0], "sinr": names[4], "dl": names[5]}
    assert rows["UMTS 3G"] == {"rsrp": names[0], "rsrq": names[3], "sinr": names[4], "dl": names[5]}
    assert rows[None] == {"rsrp": names[0], "sinr": names[4], "dl": names[5]}
