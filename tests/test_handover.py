"""Handover scenarios: small drives with a known verdict."""

import pytest
from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators import handover as H
from drivescope.operators.handover import replace

POINT = ("log_id long, device_id long, seq long, ts_ms long, lat double, lon double, tech string, pci long, earfcn long, rsrp double, rsrq double, "
         "neighbors array<struct<role:string,pci:long,earfcn:long,eci:string,name:string,rsrp:double,rsrq:double,sinr:double>>")
EVENT = "log_id long, device_id long, seq long, ts_ms long, class string, src_pci long, src_earfcn long, tgt_pci long, tgt_earfcn long, a3_offset double, hysteresis_db double, ttt_ms double"


def P(t, pci, f, rsrp, rsrq, *n):
    return t, pci, f, rsrp, rsrq, n


CASES = {
    "intra success": ("intra", [P(0, 101, 1320, -92, -8, (102, 1320, -88, -9)), P(1, 101, 1320, -95, -9, (102, 1320, -89, -9)), P(2, 102, 1320, -87, -8, (101, 1320, -96, -10)),
                                P(3, 102, 1320, -86, -8, (101, 1320, -97, -10))],
                      [(0.8, "measurement_report"), (1.0, "ho_command", 101, 1320, 102, 1320, 3, 1, 320), (2.1, "ho_complete")], ["successful"]),
    "execution failure": ("intra", [P(0, 201, 1320, -103, -13, (202, 1320, -96, -10)), P(1, 201, 1320, -107, -15, (202, 1320, -98, -10)), P(2, 202, 1320, -99, -10, (201, 1320, -110, -16))],
                          [(0.5, "measurement_report"), (1.0, "ho_command", 201, 1320, 202, 1320), (1.4, "failure")], ["execution-failure"]),
    "ping-pong": ("intra", [P(0, 301, 1320, -90, -8, (302, 1320, -88, -9)), P(2, 302, 1320, -87, -8, (301, 1320, -91, -9)), P(12, 301, 1320, -89, -8, (302, 1320, -90, -9))],
                  [(1.0, "ho_command", 301, 1320, 302, 1320), (11.0, "ho_command", 302, 1320, 301, 1320)], ["ping-pong", "ping-pong"]),
    "missing report": ("intra", [P(0, 401, 1320, -101, -11, (402, 1320, -95, -9)), P(1.5, 401, 1320, -104, -13, (402, 1320, -96, -9)), P(3, 402, 1320, -97, -10, (401, 1320, -108, -14))],
                       [(2.0, "failure")], [("missing-report/config-issue", "too-late", "execution-failure")]),
    "inter success": ("inter", [P(0, 101, 1320, -92, -9, (205, 3050, -88, -10)), P(1, 101, 1320, -96, -11, (205, 3050, -89, -10)), P(2, 205, 3050, -87, -9, (101, 1320, -101, -14))],
                      [(0.7, "measurement_report"), (1.0, "ho_command", 101, 1320, 205, 3050), (2.1, "ho_complete")], ["successful"]),
    "measurement limited": ("inter", [P(0, 300, 1320, -98, -10), P(1, 300, 1320, -103, -13), P(2.2, 300, 1320, -106, -15, (410, 3050, -95, -9)), P(3, 410, 3050, -94, -9, (300, 1320, -110, -16))],
                            [(2.3, "measurement_report"), (2.7, "ho_command", 300, 1320, 410, 3050), (3.1, "ho_complete")], ["measurement_limited"]),
    "inter execution failure": ("inter", [P(0, 500, 1320, -100, -11, (600, 3050, -94, -9)), P(1, 500, 1320, -105, -15, (600, 3050, -93, -8)), P(2, 600, 3050, -97, -10, (500, 1320, -112, -17))],
                                [(0.4, "measurement_report"), (1.0, "ho_command", 500, 1320, 600, 3050), (1.5, "failure")], ["execution_failure"]),
}


@pytest.fixture(scope="module")
def drives(spark):
    """All cases as separate logs of one table, so one run covers them all."""
    pts, evs, seq = [], [], 0
    for log, (_, points, events, _) in enumerate(CASES.values()):
        for t, pci, f, rsrp, rsrq, n in points:
            seq += 1
            pts.append((log, 0, seq, int(t * 1000), 33.9, -6.3, "LTE", pci, f, float(rsrp), float(rsrq), [("M1", a, b, None, None, float(c), float(d), None) for a, b, c, d in n]))
        for e in events:
            seq += 1
            cells = list(e[2:]) + [None] * (9 - len(e))
            evs.append((log, 0, seq, int(e[0] * 1000), e[1], *cells[:4], *[None if x is None else float(x) for x in cells[4:7]]))
    return spark.createDataFrame(pts, POINT), spark.createDataFrame(evs, EVENT)


@pytest.mark.parametrize("mode", ["intra", "inter"])
def test_scenarios(drives, mode):
    cfg = replace(H.HoConfig(), target_visible_late_ms=800, target_sampling_ratio_sparse=0.3, block_ms=1500) if mode == "inter" else replace(H.HoConfig(), block_ms=1500)
    got = {}
    for r in H.handovers(*drives, mode=mode, cfg=cfg).orderBy("log_id", "transition_no").collect():
        got.setdefault(r.log_id, []).append(r)
    for log, (name, (kind, _, _, want)) in enumerate(CASES.items()):
        if kind != mode:
            continue
        labels = [r.classification for r in got[log]]
        assert len(labels) == len(want), name
        for label, w in zip(labels, want):
            assert label in (w if isinstance(w, tuple) else (w,)), name
        assert all(r.reasons and (r.is_intra if kind == "intra" else r.is_inter) for r in got[log]), name
        assert all(r.thresholds_used["serving_weak_rsrp_dbm"] == -102.0 and ("ping_pong_time_ms" in r.thresholds_used) == (kind == "intra") for r in got[log]), name


def test_result_does_not_depend_on_layout(drives):
    pts, evs = drives
    cols = ["log_id", "transition_no", "classification", "confidence", "effective_delta_at_command"]
    one = H.handovers(pts, evs, cfg=replace(H.HoConfig(), block_ms=700)).select(cols)
    two = H.handovers(pts.orderBy(F.rand(3)).repartition(7), evs.orderBy(F.rand(5)).repartition(3)).select(cols)
    assert sorted(one.collect()) == sorted(two.collect())


def test_effective_delta(spark):
    row = spark.range(1).select(S.effective_delta(F.lit(-100.0), F.lit(-95.0)).alias("a"), S.effective_delta(F.lit(-100.0), F.lit(-95.0), F.lit(2.0), F.lit(0.0)).alias("b")).first()
    assert (row.a, row.b) == (5.0, 3.0)


def test_returns_are_found_by_rounds(spark):
    """Many returns lie too far away before one is near enough; the first near one counts, too late ones and other ways don't."""
    at = lambda no, t, a, b, lat: (1, 1, no, t, t, a, b, (lat, 0.0), (lat, 0.0))
    hos = [at(0, 0, 1, 2, 0.0), *[at(i, i, 2, 1, 5.0 + i) for i in range(1, 40)], at(40, 40, 2, 1, None), at(41, 41, 2, 1, 0.0), at(42, 42, 1, 2, 50.0), at(43, 900, 2, 1, 50.0)]
    hos += [(None, 1, 50, 1, 1, 1, 2, (0.0, 0.0), (0.0, 0.0)), (None, 1, 51, 2, 2, 2, 1, (0.0, 0.0), (0.0, 0.0)), at(60, 1000, None, 2, 0.0), at(61, 1001, 2, None, 0.0)]
    geo = "struct<lat:double,lon:double>"
    d = spark.createDataFrame(hos, f"log_id long, device_id long, transition_no long, start_ts long, complete_ts long, source_pci long, target_pci long, source {geo}, target {geo}")
    d = d.withColumn("command_ts", F.lit(None).cast("long"))
    cfg = replace(H.HoConfig(), ping_pong_time_ms=500, ping_pong_distance_m=1000.0)
    for width in (2, 16):
        got = {r.first_no: (r.second_no, r.delta_ms) for r in H.ping_pong(d, cfg, width=width).collect()}
        assert got == {0: (40, 40), 40: (42, 2)}  # the position of 40 is unknown
