"""Measurement configuration and neighbours at a time, from decoded messages."""

import json

import pytest
from pyspark.sql import functions as F

from drivescope.operators import catalog
from drivescope.operators import neighbors as N

T = 1764847832810  # 2025-12-04T11:30:32.810Z


def recfg(obj):
    cfg = {"measIdToAddModList": [{"measId": 12, "measObjectId": 2, "reportConfigId": 12}], "measObjectToAddModList": obj,
           "reportConfigToAddModList": [{"reportConfigId": 12, "reportConfig": {"reportConfigEUTRA": {"triggerType": {"event": {"eventId": {"eventA3": {"a3-Offset": 2}}}}}}}]}
    return json.dumps({"message": {"c1": {"rrcConnectionReconfiguration": {"criticalExtensions": {"c1": {"rrcConnectionReconfiguration-r8": {"measConfig": cfg}}}}}}})


def report(**results):
    return json.dumps({"message": {"c1": {"measurementReport": {"criticalExtensions": {"c1": {"measurementReport-r8": {"measResults": {"measId": 12, **results}}}}}}}})


EUTRA = [{"measObjectId": 2, "measObject": {"measObjectEUTRA": {"carrierFreq": 1320, "cellsToAddModList": [{"cellIndex": 1, "physCellId": 147}]}}}]
UTRA = [{"measObjectId": 7, "measObject": {"measObjectUTRA": {"carrierFreq": 10663, "cellsToAddModList": [{"physCellId": {"fdd": 313}}]}}}]
MR0 = report(measResultPCell={"rsrpResult": 50, "rsrqResult": 19}, **{"measResultServFreqList-r10": [{"servFreqId-r10": 1}]})


def mr1(rsrp, rsrq):
    return report(measResultPCell={"rsrpResult": 55, "rsrqResult": 20},
                  measResultNeighCells={"measResultListEUTRA": [{"physCellId": 147, "measResult": {"rsrpResult": rsrp, "rsrqResult": rsrq}}]})


MR_UTRA = json.dumps({"measResults": {"measId": 12, "measResultListUTRA": [{"physCellId": {"fdd": 111}, "carrierFreq": 10613, "measResult": {"rscp": 60, "ecNo": 20}}]}})

# run -> (configuration, reports, asked time)
RUNS = {1: (EUTRA, [(0, MR0)], 0), 2: (EUTRA, [(0, MR0), (1190, mr1(61, 21))], 390), 3: (EUTRA, [(0, mr1(65, 22))], 0), 4: (UTRA, [(0, MR0)], 0), 5: (EUTRA, [(1190, MR_UTRA)], 1190)}


@pytest.fixture(scope="module")
def result(spark):
    cfg = spark.createDataFrame([(r, T, 1, recfg(c)) for r, (c, _, _) in RUNS.items()], "run_id long, ts_ms long, seq long, decoded string")
    mrs = spark.createDataFrame([(r, T + dt, 10 + i, x) for r, (_, rs, _) in RUNS.items() for i, (dt, x) in enumerate(rs)], "run_id long, ts_ms long, seq long, decoded string")
    ids, objects, reports = N.config_operations(cfg)
    hints = cfg.select("run_id", "ts_ms", "seq", F.lit(56).cast("long").alias("pci"), F.lit(1320).cast("long").alias("earfcn"))
    times = spark.createDataFrame([(r, 1, T + at) for r, (_, _, at) in RUNS.items()], "run_id long, time_id long, ts_ms long")
    serving, merged = N.neighbors_at_time(times, N.decode_reports(mrs), ids, objects, hints)
    rows = {}
    for x in merged.collect():
        rows.setdefault(x.run_id, []).append(x)
    return {x.run_id: x for x in serving.collect()}, rows, reports


def test_configured_only(result):
    serving, rows, reports = result
    s = serving[1]
    assert (s.pci, s.earfcn, s.rsrp, s.rsrq) == (56, 1320, -90.0, -10.0)
    assert [(n.pci, n.earfcn, n.source, n.type, n.rsrp) for n in rows[1]] == [(147, 1320, "CONFIG", "intra-frequency", None)]
    assert reports.first().event_type == "eventA3"


def test_nearest_and_exact_reports(result):
    _, rows, _ = result
    n = rows[2][0]
    assert (n.pci, n.earfcn, n.type, n.rsrp, n.rsrq, n.source, n.delta_ms) == (147, 1320, "intra-frequency", -79.0, -9.0, "MR_NEAREST", 800)
    m = rows[3]
    assert len(m) == 1 and (m[0].source, m[0].rsrp, m[0].rsrq) == ("MR", -75.0, -8.5)


def test_other_technologies(result):
    _, rows, _ = result
    assert [(n.psc, n.uarfcn, n.source) for n in rows[4] if n.rat == "UTRA"] == [(313, 10663, "CONFIG")]
    assert [(n.psc, n.uarfcn, n.rscp, n.source) for n in rows[5] if n.rat == "UTRA"] == [(111, 10613, -60.0, "MR")]


def plan_of(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_asked_times_meet_nearest_samples_without_pairs(spark):
    """Ties go to the earlier sample, then to the lower index and number; a field without samples in reach is null, or has no row."""
    names = ["Radio.Lte.ServingCell[8].Pci", "Radio.Lte.ServingCell[8].Rsrp"]
    rows = [(1, names[0], 90, 0, 5, 1.0), (1, names[0], 110, 0, 6, 2.0), (1, names[0], 90, 0, 4, 3.0), (1, names[0], 90, 1, 3, 4.0), (1, names[1], 500, 0, 7, -90.0), (2, names[0], 100, 0, 8, 9.0)]
    s = spark.createDataFrame(rows, "run_id long, name string, ts_ms long, idx long, seq long, value_num double")
    t = spark.createDataFrame([(1, 1, 100), (1, 2, 111), (1, 3, None), (3, 4, 100)], "run_id long, time_id long, ts_ms long")
    d = N.nearest_in_window(t, s, N.SERVING_CANDIDATES, 50)
    got = {(r.time_id, r.field): (r.value, r.delta_ms) for r in d.collect()}
    none = (None, None)
    assert got == {(1, "pci"): (3.0, 10), (2, "pci"): (2.0, 1), (3, "pci"): none, (1, "rsrp"): none, (2, "rsrp"): none, (3, "rsrp"): none}
    assert "_row_bucket" not in plan_of(d)
    s = s.withColumn("name", F.lit("Radio.Lte.ServingCellTotal.Pdsch.NumberOfResourceBlocks")).where("run_id = 1")
    d = catalog.scheduler_at_time(s, t, 50)
    got = {r.time_id: (r.value, r.delta_ms) for r in d.collect()}
    assert got == {1: (4.0, 10), 2: (2.0, 1)}
    assert "_row_bucket" not in plan_of(d)


def test_configured_neighbours_are_the_state_of_every_object_without_pairs(spark):
    """A time before the first operation sees the first state, a removed object has no cells, unnumbered objects count as one."""
    ops = [(1, None, 20, 1, "add", "7"), (1, 2, 10, 2, "add", "8"), (1, 2, 30, 3, "remove", None), (1, 2, 50, 4, "add", "9"), (1, 5, None, 5, "add", "1")]
    objects = spark.createDataFrame(ops, "run_id long, object_id long, ts_ms long, seq long, op string, cell string").select(
        "run_id", "object_id", "ts_ms", "seq", "op", F.lit("LTE").alias("rat"), F.lit(1320).cast("long").alias("earfcn"), *[F.lit(None).cast("long").alias(c) for c in ("uarfcn", "arfcn")],
        F.array("cell").alias("cells"))
    reports = N.decode_reports(spark.createDataFrame([], "run_id long, ts_ms long, seq long, decoded string"))
    hints = spark.createDataFrame([], "run_id long, ts_ms long, seq long, pci long, earfcn long")
    ids = spark.createDataFrame([], "run_id long, ts_ms long, seq long, op string, meas_id long, object_id long")
    t = spark.createDataFrame([(1, i, at) for i, at in enumerate((5, 15, 25, 35, 60))], "run_id long, time_id long, ts_ms long")
    _, merged = N.neighbors_at_time(t, reports, ids, objects, hints, 10)
    got = sorted((r.time_id, r.pci) for r in merged.collect())
    assert got == [(0, 8), (1, 8), (2, 7), (2, 8), (3, 7), (4, 7), (4, 9)]
    assert "_row_bucket" not in plan_of(merged)
