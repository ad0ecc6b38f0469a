"""Reconfigurations as VARIANT: shapes of messages, links resolved in the message, properties, evaluation of reports."""

import json

import pytest
from pyspark.sql import functions as F

from drivescope.operators import reconfigurations as R

R8 = "rrcConnectionReconfiguration-r8"


def event(**kind):
    return {"triggerType": {"event": {"eventId": kind, "hysteresis": 1, "timeToTrigger": "ms640"}}, "triggerQuantity": "rsrq"}


CONFIG = {
    "measIdToAddModList": [{"measId": 3, "measObjectId": 1, "reportConfigId": 5}, {"measId": 4, "measObjectId": 1, "reportConfigId": 6}, {"measId": 7, "measObjectId": 99, "reportConfigId": 5},
                           {"measId": None, "measObjectId": 1, "reportConfigId": 5}],
    "measObjectToAddModList": [{"measObjectId": 1, "measObject": {"measObjectEUTRA": {"carrierFreq": 100}}},
                               {"measObjectId": 1, "measObject": {"measObjectEUTRA": {"carrierFreq": 6300, "offsetFreq": "dB-2", "cellsToAddModList": [{"physCellId": 12, "cellIndividualOffset": "dB4"}]}}}],
    "reportConfigToAddModList": [{"reportConfigId": 5, "reportConfig": {"reportConfigEUTRA": event(eventA3={"a3-Offset": 6})}}, {"reportConfigId": 6, "reportConfig": {"reportConfigEUTRA": event(eventA5={})}},
                                 {"reportConfigId": 8, "reportConfig": {"reportConfigInterRAT": {}}}],
}
BODY = {"measConfig": CONFIG, "mobilityControlInfo": {"targetPhysCellId": 3}}
SHAPES = {
    1: json.dumps(BODY), 2: json.dumps({R8: BODY}), 3: json.dumps({"criticalExtensions": {"c1": {R8: BODY}}}),
    4: json.dumps({"message": {"c1": {"rrcConnectionReconfiguration": {"criticalExtensions": {"c1": {R8: BODY}}}}}}),
    5: "{not json", 6: None, 7: json.dumps({R8: {}}), 8: json.dumps({"measConfig": {"measIdToAddModList": "none", "measObjectToAddModList": [1, None], "reportConfigToAddModList": {}}}), 9: "[1]", 10: "",
}


@pytest.fixture(scope="module")
def read(spark):
    d = spark.createDataFrame([(1, 1000 * i, i, t) for i, t in SHAPES.items()], "run_id long, ts_ms long, seq long, decoded string")
    return R.read_reconfigurations(d)


def test_every_shape_gives_the_same_properties(read):
    rows = {r.seq: r.properties for r in R.reconfiguration_properties(read).collect()}
    assert set(rows) == {1, 2, 3, 4, 7, 8, 9}
    for i in (1, 2, 3, 4):
        p = rows[i]
        assert p["rrc_recfg_a3_resolver_summary"] == (
            "measId 3 | reportConfig 5 | measObject 1 | EARFCN 6300 | A3 offset 6.0 dB | Hys 1.0 dB | TTT 640 ms | offsetFreq -2.0 dB | PCI 12 CIO 4.0 dB")
        assert p["rrc_message_summary"] == "measConfig | mobilityControlInfo | A3 resolvers 1"
        assert json.loads(p["rrc_recfg_meas_config_json"]) == CONFIG and json.loads(p["rrc_recfg_full_json"]) == json.loads(SHAPES[i])
        told = json.loads(p["rrc_recfg_meas_resolver_json"])
        assert [x["meas_id"] for x in told["links"]] == [3, 4, 7] and [x["event_type"] for x in told["reports"]] == ["EVENTA3", "EVENTA5"] and len(told["objects"]) == 2
    assert rows[7]["rrc_recfg_meas_config_present"] == "No" and rows[7]["rrc_recfg_meas_config_json"] == "{}" and "rrc_message_summary" not in rows[7]
    assert rows[8]["rrc_recfg_meas_config_present"] == "Yes" and "rrc_recfg_meas_id" not in rows[8] and rows[9]["rrc_recfg_meas_config_present"] == "No"


def test_reports_are_evaluated_by_the_message_that_holds_their_id(spark, read):
    text = json.dumps({"measResults": {"measId": 3, "measResultPCell": {"rsrpResult": 50, "rsrqResult": 20}, "measResultListEUTRA": [{"physCellId": 12, "measResult": {"rsrpResult": 60, "rsrqResult": 34}}]}})
    other = text.replace('"measId": 3', '"measId": 4')  # an A5 link: no evaluation
    mrs = spark.createDataFrame([(1, 2500, 100, text), (1, 2600, 101, other)], "run_id long, ts_ms long, seq long, decoded string")
    mrs = mrs.withColumn("serving_pci", F.lit(3).cast("long")).withColumn("serving_earfcn", F.lit(6300).cast("long"))
    cfg = spark.createDataFrame([(1, 1000, 1, SHAPES[1]), (1, 2400, 2, SHAPES[4])], "run_id long, ts_ms long, seq long, decoded string")
    rows = {r.seq: r.properties for r in R.precompute_messages(cfg, mrs).collect()}
    assert set(rows) == {1, 2, 100, 101}
    told = json.loads(rows[100]["measurement_report_a3_eval_json"])
    # index 20 is -9.5 dB, plus offset -2 and A3 offset 6; index 34 is -2.5 dB, plus offset -2 and 4 of the cell, less 1 of hysteresis
    assert told["sourceTimeMs"] == 2400 and told["triggerQuantity"] == "RSRQ" and told["bestNeighbor"]["pci"] == 12
    assert told["bestNeighbor"]["rhs"] == pytest.approx(-5.5) and told["bestNeighbor"]["lhsEnter"] == pytest.approx(-1.5) and told["bestNeighbor"]["enterSatisfied"]
    assert rows[100]["measurement_report_a3_source_time"] == "00:00:02.400"
    assert "measurement_report_a3_eval_json" not in rows[101] and rows[101]["measurement_report_measid"] == "4"


def test_empty_table(read):
    none = read.limit(0).select("run_id", "ts_ms", "seq", "decoded")
    assert R.reconfiguration_properties(R.read_reconfigurations(none)).count() == 0 and R.resolver_rows(R.read_reconfigurations(none)).count() == 0


def test_rlf_summary_reads_a_text_once(spark):
    from drivescope.functions import decoded

    texts = [None, "", "{}", '{"cause":"x","t310":5}', '{"cause":"early","rlf_Report-r9":{"Cause":" a ","cause":"none","cause_b":"a","c-cause":"b","t310-r9":7,"T310":8,"my-timer":"x","xTimer":3,"time_ConnFailure":-4}}']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decoded.rlf_report_summary("t").alias("s"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
    got = {r.i: r.s for r in d.collect()}
    assert [got[i] and tuple(got[i]) for i in range(5)] == [
        (None, None, None, None), (False, None, {}, {}), (False, None, {}, {}), (False, "x", {"x": 1}, {"t310": 5}),
        (True, "a", {"a": 2, "b": 1}, {"t310": 7, "xTimer": 3, "timeConnFailureMs": -4})]
