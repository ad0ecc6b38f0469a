"""Fields, properties and messages are read once a row, whatever is asked of them; the values stay as they were."""

import json
import re

from pyspark.sql import functions as F

from drivescope.operators import catalog
from drivescope.sources import columns, nmf


def times(df, pattern):
    """How often an expression stands in the plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return len(re.findall(pattern, df._jdf.queryExecution().optimizedPlan().toString()))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


LINES = "log_id long, line_no long, raw string"
EVENTS = "run_id long, ts_ms long, seq long, event_name string, params array<struct<param_id:string,param_value:string>>"
SAMPLES = "run_id long, ts_ms long, seq long, name string, value_num double"
CELL = "CELLMEAS,10:00:00.000,,5,0,2,1,3032,-65,60401,3032,7,-6.5,0,60401,3032,7,-71,-60,-6,1,60401,3032,47,-80,-60,-8,3,60401,3032,90,-7,-60,-90"


def test_numbers_of_fields(spark):
    texts = ["", "abc", " 7x", "+.5", "-12.", "1e3z", "--1", "99999999999999999999", "3.9", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    d = d.select("i", nmf.num(F.col("t")).alias("n"), nmf.integer(F.col("t")).alias("w"))
    got = [(r.n, r.w) for r in d.orderBy("i").collect()]
    assert got == [(None, None), (None, None), (7.0, 7), (0.5, None), (-12.0, -12), (1000.0, 1), (None, None), (1e20, None), (3.9, 3), (None, None)]
    assert times(d, r"cast\(regexp_extract\(") == 0  # an empty text in a cast costs an exception


def test_lines_are_split_once(spark):
    lines = spark.createDataFrame([(1, 1, "CHI,10:00:00.000,,7,0,0,0,0,0,51328000,8362"), (1, 2, 'CHI,10:00:01.000,,5,0,0,29000000,8000,17,0,"3.0",100')], LINES)
    d = nmf.identity_track(nmf.parse_records(lines))
    assert times(d, r"split\(") == 1
    got = [(r.line_no, r.rat, r.cid, r.rnc, r.lac, r.psc) for r in d.orderBy("line_no").collect()]
    assert got == [(1, "LTE", 51328000, None, 8362, None), (2, "UMTS", 29000000, 442, 8000, 17)]


def test_cells_are_read_at_networks_only(spark):
    d = nmf.cellmeas_dominance(nmf.parse_records(spark.createDataFrame([(1, 1, CELL)], LINES)))
    assert times(d, r"regexp_extract(_all)?\(") <= 12
    assert [(r.gap, r.subtype_a, r.subtype_b) for r in d.collect()] == [(9.0, 2, 1)]
    (r,) = nmf.label_neighbors(nmf.umts_cellmeas(nmf.parse_records(spark.createDataFrame([(1, 1, CELL)], LINES)))).collect()
    assert (r.serving_sc, r.serving_ecno, r.serving_rscp) == (7, -6.5, -71.0)
    assert [(n.label, n.sc, n.rscp, n.ecno) for n in r.neighbors] == [("A2", 47, -80.0, -8.0), ("D1", 90, -90.0, -7.0)]


def test_messages_are_read_once(spark):
    cap, sib = json.dumps({"ueCategory": 6, "mimoCapability": "2x2"}), json.dumps({"trackingAreaCode": "0x20AA"})
    rows = [(1, 0, 0, "UeCapabilityInformation", [("UE_CAP_INFO_SUMMARY ", cap)]), (1, 1, 1, "Sib1", [("sib1_tac", "zz"), ("sib1_summary", sib)]), (1, 2, 2, "Sib1", None), (1, 3, 3, "Other", [("rrc_message_id", None)])]
    d = catalog.run_info(spark.createDataFrame([], SAMPLES), spark.createDataFrame(rows, EVENTS))
    assert times(d, r"get_json_object\(") <= 10
    assert [(r.ue_category, r.mimo_capability, r.tac) for r in d.collect()] == [("Cat 6", "2x2", 8362)]


def test_properties_are_read_once(spark):
    rows = [(1, 1, 1, 5, {"serving rsrp": " ", "Serving RSRP": "-90", "A1 pci": "7", "a1 RSRP": "-95.5", "M1 RSRP": "-99", "a2 EARFCN": "1320", "SC": "12"}), (1, 1, 2, 6, None), (1, 1, 3, None, {"SC": "1"})]
    d = columns.normalize_points(spark.createDataFrame(rows, "log_id long, device_id long, seq long, ts long, props map<string,string>"), props="props")
    assert times(d, r"map_entries\(") <= 2
    got = {r.seq: (r.rsrp, r.pci, sorted((n.role, n.pci, n.earfcn, n.rsrp) for n in r.neighbors)) for r in d.collect()}
    assert got == {1: (-90.0, 12, [("A1", 7, None, -95.5), ("A2", None, 1320, None)]), 2: (None, None, [])}
    e = columns.normalize_events(spark.createDataFrame([(1, 1, 1, 5, {"Message": "Handover Complete", "ho target pci": "9"})], "log_id long, device_id long, seq long, ts long, props map<string,string>"), props="props")
    assert times(e, r"map_entries\(") == 1
    assert [(r["class"], r.tgt_pci) for r in e.collect()] == [("ho_complete", 9)]
