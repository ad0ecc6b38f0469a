"""Catalogs, scheduler fields and run information on small samples."""

import json

from pyspark.sql import functions as F

from drivescope.functions import decoded as D
from drivescope.functions import scalars as S
from drivescope.operators import catalog

KPI = "run_id long, ts_ms long, seq long, name string, metric_id long, value_num double, value_str string, dtype string"
EV = "run_id long, ts_ms long, seq long, event_name string, params array<struct<param_id:string,param_value:string,param_type:string>>"


def samples(spark, *rows):
    return spark.createDataFrame([(1, t, i, n, i, v, s, None) for i, (t, n, v, s) in enumerate(rows)], KPI)


def events(spark, *rows):
    return spark.createDataFrame([(1, i, i, n, [(k, v, None) for k, v in p]) for i, (n, p) in enumerate(rows)], EV)


def test_scheduler_fields(spark):
    n = "Radio.Lte.ServingCell[8].Pdsch.NumberOfResourceBlocks"
    s = samples(spark, (0, n, 8.0, None), (1000, n, 10.0, None), (2000, n, 7.0, None), (0, "Data.Http.Download.Throughput", 5.0, None))
    f = catalog.scheduler_fields(s)
    r = f.collect()
    assert [(x.field, x.sample_count, x.gap_p50, x.per_tti) for x in r] == [("allocated_rb_dl", 3, 1000.0, False)]
    ev = events(spark, ("Message.Layer2.LteMac.UlGrant", []), ("Message.Layer3.Errc.DcchUl.MeasurementReport", []))
    assert [x.event_name for x in catalog.payload_events(ev).collect()] == ["Message.Layer2.LteMac.UlGrant"]
    none = catalog.payload_events(events(spark, ("Call.Setup", [])))
    assert len(catalog.scheduler_limitations(f, none, s.select("run_id").distinct()).first().limitations) == 2


def test_catalogs(spark):
    s = samples(spark, (0, "Radio.Lte.Rsrp", -95.0, None), (1, "Radio.Lte.Rsrp", -90.0, None), (2, "Text", None, "x"))
    got = {r.name: r for r in catalog.metric_catalog(s).collect()}
    assert (got["Radio.Lte.Rsrp"].sample_count, got["Radio.Lte.Rsrp"].min, got["Radio.Lte.Rsrp"].max, got["Radio.Lte.Rsrp"].tags) == (2, -95.0, -90.0, ["RSRP"])
    assert got["Text"].value_kind == "string"
    ev = {r.event_name: r for r in catalog.event_catalog(events(spark, ("Call.Setup", [("7", "a")]), ("Call.Setup", [("8", "b")]), ("IMS.Reg", []))).collect()}
    assert ev["Call.Setup"]["count"] == 2 and ev["Call.Setup"].param_ids == ["7", "8"] and ev["IMS.Reg"].param_ids == []


def test_run_information(spark):
    none = samples(spark, (0, "x", 1.0, None))
    cap = json.dumps({"ueCategoryLabel": "Cat 6", "mimoCapability": "2x2", "caCapability": "CA yes"})
    sib = json.dumps({"trackingAreaCode": "0x20AA"})
    ev = events(spark, ("Message.Layer3.Errc.DcchUl.UeCapabilityInformation", [("UE_CAP_INFO_SUMMARY", cap)]), ("Message.Layer3.Errc.Sib.SystemInformationBlockType1", [("sib1_summary", sib)]))
    r = catalog.run_info(none, ev).first()
    assert (r.ue_category, r.mimo_capability, r.ca_capability, r.tac, r.tac_source) == ("Cat 6", "2x2", "CA yes", 8362, "decoded_sib1")
    cap = json.dumps({"maxNumCarriers": 10, "supportedBandCombinations": ["B3+B7", "B3+B20"]})
    r = catalog.run_info(none, events(spark, ("UeCapabilityInformation", [("ue_cap_info_summary", cap)]))).first()
    assert "B3+B7" in r.ca_capability and "B3+B20" in r.ca_capability and "MaxNumCarriers=10" in r.ca_capability
    s = samples(spark, (0, "Pocket.General.Device.MaxNumCarriers", 10.0, None), (0, "Radio.Lte.ServingCell[8].Rank4.FeedbackCount", 7.0, None), (0, "Radio.Lte.ServingSystem.Tac", 8362.0, None))
    r = catalog.run_info(s, events(spark)).first()
    assert r.ca_capability_inferred == "CA capable (MaxNumCarriers=10)" and r.mimo_capability_inferred.startswith("4x4") and r.ue_category_inferred.startswith("Cat 6+") and r.tac == 8362


def test_decoded_messages(spark):
    rlf = json.dumps({"rlf_Report_r9": {"cause": "reconfigurationFailure", "timeConnFailure-r10": 345, "timeSinceFailure-r10": 117, "t310-r9": 1000}})
    cap = json.dumps({"rf": {"supportedBandCombination-r10": [[{"bandEUTRA-r10": 3}, {"bandEUTRA-r10": 7}], [{"bandEUTRA-r10": 20}, {"bandEUTRA-r10": 3}]]}, "maxNumCarriers-r10": 10})
    r = spark.range(1).select(D.rlf_report_summary(F.lit(rlf)).alias("r"), D.ue_capability_summary(F.lit(cap)).alias("c"),
                              *[S.parse_tac(F.lit(t)).alias(f"t{i}") for i, t in enumerate(["0x20AA", "20AA", "'0010000010101010'B", "70000"])]).first()
    assert r.r.root_cause == "reconfigurationFailure" and r.r.timers == {"timeConnFailureMs": 345, "timeSinceFailureMs": 117, "t310": 1000}
    assert r.c.combos == ["B3+B7", "B3+B20"] and "MaxNumCarriers=10" in r.c.ca
    assert (r.t0, r.t1, r.t2, r.t3) == (8362, 8362, 8362, None)
