"""Queries on wide ingest, sites, regions, decoded messages and the session machine."""

import uuid

from pyspark.sql import functions as F

from drivescope.functions import decoded as D
from drivescope.operators import catalog, rrc_sessions, sites, staging
from drivescope.plans import probes
from drivescope.plans.registry import query
from drivescope.sources import columns, tables


def r6(c):
    return F.round(c, 6)


def export(v):
    """An export-shaped table with awkward headers, comma decimals and day fractions."""
    k, e = F.col("k"), F.col("seq")
    t = F.when(e % 3 == 0, F.format_string("0.%d", k + 100)).when(e % 3 == 1, F.lit("12:00:00")).otherwise("")
    return v.v_points.select(
        "seq", t.alias("Time Stamp"), F.when(k % 5 != 0, F.regexp_replace(F.col("lat").cast("string"), r"\.", ",")).alias("Latitude"), F.col("lon").cast("string").alias("Longitude"),
        F.col("pci").cast("string").alias("Serving SC"), F.concat(F.col("rsrp").cast("int").cast("string"), F.lit(",5")).alias("Serving RSRP"), F.col("earfcn").alias("EARFCN"),
        F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("/"), (k + 7).cast("string"))).otherwise((F.lit(29000000) + k).cast("string")).alias("CellID"),
        (k / 4).alias("DL Throughput"), F.col("n1_pci").alias("LTE N1 PCI"), F.col("n1_rsrp").alias("LTE N1 RSRP"), F.when(k % 3 == 0, F.col("n2_pci")).alias("3G M1 SC"))


@query("S10_read_tabular", "v_points", """
SELECT seq, CASE WHEN k % 5 <> 0 THEN lat END AS lat, lon, CASE seq % 3 WHEN 1 THEN '12:00:00' WHEN 0 THEN 'fraction' END AS time, rsrp - 0.5 AS level, pci AS sc, CASE WHEN k % 2 = 0 THEN k ELSE (29000000 + k) >> 16 END AS rnc,
 CASE WHEN k % 2 = 0 THEN k + 7 ELSE (29000000 + k) & 65535 END AS cid, k / 4 * 1000 AS throughput_dl, CASE WHEN k % 3 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS n_neighbors FROM v_points WHERE k % 5 <> 0 OR seq % 3 <> 2
""")
def _(v):
    d = columns.tabular_points(export(v), ["seq"])
    when = F.when(F.col("time").rlike(r"^\d\d:\d\d:\d\d\.\d{3}$"), "fraction").otherwise(F.col("time"))
    return d.select("seq", "lat", "lon", when.alias("time"), "level", "sc", "rnc", "cid", "throughput_dl", F.size("neighbors").cast("long").alias("n_neighbors"))


@query("S10_read_exports", "v_points", """
SELECT seq, CASE WHEN k % 5 <> 0 THEN lat END AS lat, lon, CASE seq % 3 WHEN 1 THEN '12:00:00' WHEN 0 THEN 'fraction' END AS time, rsrp - 0.5 AS level, pci AS sc,
 CASE WHEN k % 2 = 0 THEN k ELSE (29000000 + k) >> 16 END AS rnc, CASE WHEN k % 2 = 0 THEN k + 7 ELSE (29000000 + k) & 65535 END AS cid, CASE WHEN seq % 4 <> 3 THEN k / 4 * 1000 END AS throughput_dl,
 CASE WHEN seq % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'M1 ' || n2_pci ELSE '' END WHEN seq % 4 = 2 THEN CASE WHEN k % 3 = 0 THEN 'M1 ' || n2_pci || ',' ELSE '' END || 'N1 ' || n1_pci
 ELSE 'N1 ' || n1_pci || CASE WHEN k % 3 = 0 THEN ',M1 ' || n2_pci ELSE '' END END AS neighbors
FROM v_points WHERE k % 5 <> 0 OR seq % 3 <> 2
""")
def _(v):
    """Four kinds of files in one folder: all columns, another order, other spellings, fewer columns."""
    d, path = export(v), staging.staging_path(v.spark, "exports")
    names = ["seq", *[c for c in d.columns if c != "seq"]]
    without = lambda *gone: [c for c in names if c not in gone]
    kinds = [names, without("LTE N1 PCI", "LTE N1 RSRP"), [*reversed(names)], without("DL Throughput")]
    for i, kind in enumerate(kinds):
        out = d.where(F.col("seq") % 4 == i).select(*[F.col(f"`{c}`") for c in kind])
        if i == 3:
            out = out.withColumnsRenamed({"Serving SC": "Primary PCI", "Time Stamp": "Timestamp", "Latitude": "lat", "Longitude": "x"})
        out.write.option("header", True).csv(f"{path}/{i}")
    d = tables.read_tabular(v.spark, path, ["seq"])
    when = F.when(F.col("time").rlike(r"^\d\d:\d\d:\d\d\.\d{3}$"), "fraction").otherwise(F.col("time"))
    cells = F.array_join(F.transform("neighbors", lambda n: F.concat(n["role"], F.lit(" "), n["pci"].cast("string"))), ",")
    return d.select(F.col("seq").cast("long").alias("seq"), "lat", "lon", when.alias("time"), "level", "sc", "rnc", "cid", "throughput_dl", cells.alias("neighbors"))


@query("C1_resolve_columns", "v_points", """
SELECT 'sc' AS field, 'Serving SC' AS header, count(pci) AS present FROM v_points UNION ALL SELECT 'level', 'Serving RSRP', count(rsrp) FROM v_points UNION ALL SELECT 'freq', 'EARFCN', count(earfcn) FROM v_points
UNION ALL SELECT 'cell_id', 'CellID', count(*) FROM v_points UNION ALL SELECT 'throughput_dl', 'DL Throughput', count(*) FROM v_points UNION ALL SELECT 'time', 'Time Stamp', count(*) FROM v_points
UNION ALL SELECT 'lat', 'Latitude', count(*) FILTER (WHERE k % 5 <> 0) FROM v_points UNION ALL SELECT 'lon', 'Longitude', count(lon) FROM v_points
""")
def _(v):
    d = export(v)
    found = columns.resolve_columns([c for c in d.columns if c != "seq"])
    counts = d.agg(*[F.count(F.col(f"`{h}`")).alias(f) for f, h in found.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("header"), F.col(f).alias("present")) for f, h in found.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("C2_normalize_points", "v_points", """
SELECT seq, CASE WHEN k % 6 <> 0 THEN ts_ms END AS ts_ms, 'LTE' AS tech, pci, CASE WHEN k % 2 = 0 THEN 1320::BIGINT ELSE 3050::BIGINT END AS earfcn, rsrp, CASE WHEN k % 3 = 0 THEN 3.0::DOUBLE END AS a3_offset, n1_pci, n1_rsrp FROM v_points WHERE k % 6 <> 0
""")
def _(v):
    k = F.col("k")
    s = lambda c: F.col(c).cast("string")
    props = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("serving rsrp").alias("key"), s("rsrp").alias("value")), F.struct(F.lit("EARFCN").alias("key"), s("earfcn").alias("value")),
        F.struct(F.lit("A3 offset").alias("key"), F.when(k % 3 == 0, "3").alias("value")), F.struct(F.lit("A1 PCI").alias("key"), s("n1_pci").alias("value")),
        F.struct(F.lit("A1 RSRP").alias("key"), s("n1_rsrp").alias("value"))), lambda e: e["value"].isNotNull()))
    raw = v.v_points.select("log_id", "device_id", "seq", F.when(k % 6 != 0, F.col("ts_ms")).alias("timestamp"), F.lit("4G").alias("Technology"), s("pci").alias("Physical cell ID"), props.alias("props"))
    n = F.col("neighbors")[0]
    return columns.normalize_points(raw, props="props").select("seq", "ts_ms", "tech", "pci", "earfcn", "rsrp", "a3_offset", n["pci"].alias("n1_pci"), n["rsrp"].alias("n1_rsrp"))


@query("C2_normalize_events", "v_msgs", """
SELECT seq, ts_ms, CASE message WHEN 'MeasurementReport' THEN 'measurement_report' WHEN 'A3/A5 Event' THEN 'ho_command' WHEN 'Handover Complete' THEN 'ho_complete' WHEN 'RRCConnectionReconfigurationComplete' THEN 'ho_complete'
 WHEN 'RADIO LINK FAILURE' THEN 'failure' WHEN 'HANDOVER FAILURE' THEN 'failure' ELSE 'other' END AS class, CASE WHEN k % 2 = 0 THEN k END AS tgt_pci FROM v_msgs
""")
def _(v):
    props = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("HO target PCI"), F.col("k").cast("string")))
    raw = v.v_msgs.select("log_id", F.col("log_id").alias("device_id"), "seq", F.col("ts_ms").alias("time"), F.col("message").alias("Event"), props.alias("props"))
    return columns.normalize_events(raw, props="props").select("seq", "ts_ms", "class", "tgt_pci")


@query("C4_metric_value", "v_points", """
SELECT seq, CASE WHEN k % 3 = 0 THEN rsrp WHEN k % 3 = 1 THEN rsrp - 1 ELSE rsrp - 2 END AS level, rsrq AS quality, sinr AS spelled FROM v_points
""")
def _(v):
    k = F.col("k")
    d = v.v_points.select(
        "seq", F.when(k % 3 == 0, F.col("rsrp")).alias("level"), F.struct(F.when(k % 3 == 1, F.col("rsrp") - 1).alias("rscp"), F.col("rsrq").alias("ecno")).alias("serving"),
        F.create_map(F.lit("Serving RSRP"), (F.col("rsrp") - 2).cast("string")).alias("props"), F.col("sinr").alias("Serving-SINR"))
    get = lambda m: columns.metric_value(d, m, "serving", "props").cast("double")
    return d.select("seq", get("rscp").alias("level"), get("quality").alias("quality"), get("serving_sinr").alias("spelled"))


@query("S11_read_track", "v_points", "SELECT ts_ms // 1000 * 1000 AS ts_ms, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(k AS DOUBLE) AS alt FROM v_points")
def _(v):
    p = v.v_points.select(F.concat(
        F.lit('<trkpt lat="'), F.round("lat", 6).cast("string"), F.lit('" lon="'), F.round("lon", 6).cast("string"), F.lit('"><ele>'), F.col("k").cast("string"), F.lit("</ele><time>"),
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time></trkpt>")).alias("value"))
    base = staging.staging_dir(v.spark)
    path = f"{base}/drivescope/track-{uuid.uuid4().hex}"
    p.write.text(path)
    return tables.read_track(v.spark, path, one_per_line=True).select("ts_ms", "lat", "lon", "alt")


@query("S15_write_analysis", "v_series", """
SELECT run_id, name, count(*) AS n, sha1(CAST(run_id AS VARCHAR) || chr(1) || name) AS result_key FROM v_series GROUP BY run_id, name
""")
def _(v):
    d = v.v_series.groupBy("run_id", "name").agg(F.count("*").alias("n"))
    path = f"{staging.staging_dir(v.spark)}/drivescope/analysis-{uuid.uuid4().hex}"
    tables.write_analysis(d, path, ["run_id"], ["run_id", "name"])
    return tables.read_analysis(v.spark, path).select(F.col("run_id").cast("long").alias("run_id"), "name", "n", "result_key")


@query("S15_series_store", "v_kpi", """
SELECT run_id, name, count(*) AS n, count(value_num) AS n_numbers, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, min(seq) AS first_seq FROM v_kpi WHERE run_id <> 2 OR idx = 3 GROUP BY run_id, name
""")
def _(v):
    """The whole table stored, one run of it written again with fewer rows, everything read back."""
    path = staging.staging_path(v.spark, "series")
    tables.write_series(v.v_kpi, path)
    tables.write_series(v.v_kpi.where("run_id = 2 and idx = 3"), path)
    return tables.read_series(v.spark, path).groupBy("run_id", "name").agg(
        F.count("*").alias("n"), F.count("value_num").alias("n_numbers"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.min("seq").alias("first_seq"))


@query("S17_stored_series", "v_kpi", """
, busy AS (SELECT run_id FROM v_kpi WHERE value_str IS NOT NULL GROUP BY run_id HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM v_kpi WHERE value_str IS NOT NULL GROUP BY run_id)))
SELECT run_id, ts_ms, seq, value_num FROM v_kpi WHERE name = 'Radio.Lte.ServingCell[0].Rsrp' AND idx = 3 AND value_num IS NOT NULL AND run_id IN (SELECT run_id FROM busy)
""")
def _(v):
    """A signal of the runs with at least the usual number of texts, read from the store by a table of runs."""
    path = staging.staging_path(v.spark, "series")
    tables.write_series(v.v_kpi, path)
    counts = v.v_kpi.where("value_str is not null").groupBy("run_id").agg(F.count("*").alias("n"))
    busy = counts.join(counts.agg(F.avg("n").alias("usual")), F.col("n") >= F.col("usual"))
    name = "Radio.Lte.ServingCell[0].Rsrp"
    found = tables.read_series(v.spark, path, [name], busy)
    return catalog.signal_series(found, name, idx=3).select("run_id", "ts_ms", "seq", "value_num")


# ---- sites and regions --------------------------------------------------------------------------------------------------------


@query("J13_serving_site_lookup", "v_points v_sites", """
, s AS (SELECT *, 1000 + site_no AS eci_n, CASE WHEN site_no % 2 = 0 THEN 400 + site_no % 3 END AS rnc, site_no * 16 + 3 AS cid FROM v_sites)
, p AS (SELECT seq, pci, earfcn, lat, lon, CASE WHEN k % 4 = 0 THEN 1000 + k END AS eci, CASE WHEN k % 4 = 1 THEN 400 + k % 3 END AS rnc, CASE WHEN k % 4 = 1 THEN k * 16 + CASE WHEN k % 8 = 1 THEN 3 ELSE 5 END END AS cid, k FROM v_points)
, c AS (SELECT p.seq, 0 AS rank, s.site_no, 0.0 AS d FROM p JOIN s ON p.eci = s.eci_n WHERE p.pci = s.pci AND p.earfcn = s.freq
  UNION ALL SELECT p.seq, 2, s.site_no, 0 FROM p JOIN (SELECT rnc, cid, max(site_no) AS site_no, arg_max(pci, site_no) AS pci, arg_max(freq, site_no) AS freq FROM s GROUP BY rnc, cid) s ON p.rnc = s.rnc AND p.cid = s.cid WHERE p.pci = s.pci AND p.earfcn = s.freq
  UNION ALL SELECT p.seq, 6, s.site_no, 0 FROM p JOIN (SELECT rnc, cid >> 4 AS sh, min(site_no) AS site_no, arg_min(pci, site_no) AS pci, arg_min(freq, site_no) AS freq FROM s GROUP BY rnc, cid >> 4) s ON p.rnc = s.rnc AND p.cid >> 4 = s.sh WHERE p.pci = s.pci AND p.earfcn = s.freq
  UNION ALL SELECT p.seq, 8, s.site_no, (p.lat - s.lat) * (p.lat - s.lat) + (p.lon - s.lon) * (p.lon - s.lon) FROM p JOIN s ON p.pci = s.pci AND p.earfcn = s.freq AND abs(p.lat - s.lat) < 0.02 AND abs(p.lon - s.lon) < 0.02)
, b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rank, d, site_no) AS rn FROM c)
SELECT p.seq AS point_id, b.site_no, CASE b.rank WHEN 0 THEN 'eci' WHEN 2 THEN 'rnccid' WHEN 6 THEN 'short' WHEN 8 THEN 'psc' END AS rule FROM p LEFT JOIN b ON b.seq = p.seq AND rn = 1
""")
def _(v):
    n, k = F.col("site_no"), F.col("k")
    s = v.v_sites.select("site_no", "pci", F.col("freq").cast("double").alias("freq"), "lat", "lon", (n + 1000).alias("eci"), F.when(n % 2 == 0, 400 + n % 3).alias("rnc"), (n * 16 + 3).alias("cid"))
    p = v.v_points.select(
        F.col("seq").alias("point_id"), "pci", F.col("earfcn").cast("double").alias("freq"), "lat", "lon", F.when(k % 4 == 0, 1000 + k).alias("eci"), F.when(k % 4 == 1, 400 + k % 3).alias("rnc"),
        F.when(k % 4 == 1, k * 16 + F.when(k % 8 == 1, 3).otherwise(5)).alias("cid"))
    d = sites.serving_site_lookup(p, s)
    return d.select("point_id", F.col("site.site_no").alias("site_no"), "rule")


@query("J19_region_lookup", "v_region", """
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'DR Rabat' WHEN s_suppkey % 4 = 0 THEN 'DR Fes' WHEN s_suppkey % 4 = 1 THEN 'DR Casa' WHEN s_suppkey % 4 = 2 THEN 'Unknown' ELSE 'DR Beni Mellal' END AS region_label FROM supplier
""")
def _(v):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "Fès").when(k % 4 == 1, "Médiouna").when(k % 4 == 2, F.col("s_name")).otherwise("Ben-Slimane")
    d = v.table("supplier").select("s_suppkey", name.alias("province"), F.when(k % 10 == 3, "El Mansouria 2").alias("commune"))
    return sites.region_lookup(d, "province", "commune").select("s_suppkey", "region_label")


@query("J19_region_lookup_table", "v_region", """
, m AS (SELECT DISTINCT regexp_replace(upper(province), '[^A-Z]', '', 'g') AS key, last_value(region_code) OVER (PARTITION BY regexp_replace(upper(province), '[^A-Z]', '', 'g') ORDER BY province_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS code FROM v_region)
SELECT province_id, coalesce('R' || code, 'Unknown') AS region_label FROM v_region JOIN m ON m.key = regexp_replace(upper(province), '[^A-Z]', '', 'g')
""")
def _(v):
    d = v.v_region
    m = d.select("province", F.col("region_code").cast("string").alias("code"), F.col("province_id").alias("pos"))
    out = sites.region_lookup(d, "province", mapping=m, names={str(i): f"R{i}" for i in range(5)})
    return out.select("province_id", "region_label")


# ---- decoded messages ------------------------------------------------------------------------------------------------------------


@query("C30_rlf_report_summary", "ev", """
SELECT event_id, true AS has_report, 'reconfigurationFailure' AS root_cause, CASE WHEN k % 2 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS n_root, k * 10 AS conn_failure, 1000::BIGINT AS t310 FROM ev
""")
def _(v):
    k = F.col("k")
    js = F.format_string('{"x":{"rlf_Report_r9":{"reestablishmentCause-r11":"reconfigurationFailure","timeConnFailure-r10":%d,"t310-r9":1000,"inner":[{"cause":"%s"},{"timeConnFailure-r11":5}]}}}',
                         k * 10, F.when(k % 2 == 0, "reconfigurationFailure").otherwise("handoverFailure"))
    d = v.ev.select("event_id", D.rlf_report_summary(js).alias("s"))
    return d.select("event_id", "s.has_report", "s.root_cause", F.col("s.causes")["reconfigurationFailure"].alias("n_root"), F.col("s.timers")["timeConnFailureMs"].alias("conn_failure"),
                    F.col("s.timers")["t310"].alias("t310"))


@query("C31_ue_capability_summary", "ev", """
, c AS (SELECT event_id, k, [3 + k % 5, 8] AS a FROM ev)
SELECT event_id, 'Cat ' || (k % 12 + 1) AS category_label, CASE WHEN k % 2 = 0 THEN '4x4 capable (decoded UE capability)' END AS mimo, array_to_string(list_distinct([x]), ',') AS combos,
 'CA capable (band combos: ' || x || '; MaxNumCarriers=5)' AS ca FROM (SELECT *, 'B' || a[1] || '+B8' AS x FROM c)
""")
def _(v):
    k = F.col("k")
    js = F.format_string('{"a":{"ue-Category":%d,%s"maxNumCarriers-r10":5,"rf":{"supportedBandCombination-r10":[[{"bandEUTRA-r10":8},{"bandEUTRA-r10":%d}],[{"bandEUTRA-r10":%d},{"bandEUTRA-r10":8}]]},"z":1}}',
                         k % 12 + 1, F.when(k % 2 == 0, '"maxNumberMIMO-LayersPDSCH-r10":4,').otherwise(""), 3 + k % 5, 3 + k % 5)
    d = v.ev.select("event_id", D.ue_capability_summary(js).alias("s"))
    return d.select("event_id", "s.category_label", "s.mimo", F.concat_ws(",", "s.combos").alias("combos"), "s.ca")


@query("C32_rrc_message_summary", "ev", """
SELECT event_id, CASE k % 3 WHEN 0 THEN CAST(8000 + k AS VARCHAR) WHEN 1 THEN 'loadBalancing' ELSE 'emergency' END AS picked, CASE WHEN k % 3 = 1 THEN 'true' END AS redirected FROM ev
""")
def _(v):
    k = F.col("k")
    mid = F.when(k % 3 == 0, "sib1").when(k % 3 == 1, "rrc_release").otherwise("rrc_connection_request")
    js = (
        F.when(k % 3 == 0, F.concat(F.lit('{"sib1":{"trackingAreaCode":"0x'), F.hex(F.lit(8000) + k), F.lit('"}}')))
        .when(k % 3 == 1, F.lit('{"c1":{"releaseCause":"loadBalancing","redirectedCarrierInfo":{"eutra":1320}}}')).otherwise('{"establishmentCause":"emergency"}')
    )
    d = v.ev.select("event_id", D.rrc_message_summary(mid, js).alias("m"))
    m = F.col("m")
    return d.select("event_id", F.coalesce(m["trackingAreaCode"], m["releaseCause"], m["establishmentCause"]).alias("picked"), m["hasRedirectedCarrierInfo"].alias("redirected"))


BLOCK_MS = 5 * 86_400_000  # the probe's rows lie minutes apart


# The machine row by row: a log's open sessions, busy keys and pending requests are lists that a recursion hands on.
K9 = r"""
, r AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY ts_ms, seq) AS rn, ts_ms AS ts, seq, upper(message) AS m, upper(cause) AS c,
   CASE WHEN k % 4 = 0 THEN CAST(k % 11 AS VARCHAR) END AS call_id, CASE WHEN k % 4 = 1 THEN '60400' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS imsi,
   CASE WHEN k % 4 = 2 OR (k % 4 = 1 AND k % 3 = 0) THEN 'A1B2C' || (k % 10) END AS tmsi FROM v_msgs)
, q AS MATERIALIZED (SELECT *, CASE WHEN call_id IS NOT NULL THEN 'CALL:' || call_id WHEN imsi IS NOT NULL THEN 'IMSI:' || imsi || coalesce('|TMSI:' || tmsi, '') WHEN tmsi IS NOT NULL THEN 'TMSI:' || tmsi ELSE '__ANON__' END AS own,
   CASE WHEN m IN ('RRC_CONNECTION_RELEASE', 'PAGING') THEN true WHEN m IN ('CELL_UPDATE', 'RRC_CONNECTION_SETUP', 'RRC_CONNECTION_SETUP_COMPLETE') THEN false END AS to_idle FROM r)
, w AS (
 SELECT log_id, 0::BIGINT AS rn, CAST([] AS VARCHAR[]) AS busy, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS asked,
  CAST([] AS STRUCT(k VARCHAR, a BIGINT, z BIGINT, trig VARCHAR, ots BIGINT, oseq BIGINT, n BIGINT, cid VARCHAR, imsi VARCHAR, tmsi VARCHAR, conn BOOLEAN, disc BOOLEAN, cm BOOLEAN, ca BOOLEAN, rlf BOOLEAN)[]) AS live,
  CAST(NULL AS STRUCT(k VARCHAR, a BIGINT, z BIGINT, trig VARCHAR, ots BIGINT, oseq BIGINT, n BIGINT, cid VARCHAR, imsi VARCHAR, tmsi VARCHAR, conn BOOLEAN, disc BOOLEAN, cm BOOLEAN, ca BOOLEAN, rlf BOOLEAN)) AS gone, CAST(NULL AS VARCHAR) AS ending
 FROM (SELECT DISTINCT log_id FROM q)
 UNION ALL
 SELECT log_id, rn, busy2, CASE WHEN trig IS NULL THEN asked2 ELSE [x FOR x IN asked2 IF x.k <> key] END,
  CASE WHEN s IS NULL THEN live WHEN ending IS NULL THEN list_append([x FOR x IN live IF x.k <> key], s) ELSE [x FOR x IN live IF x.k <> key] END, CASE WHEN ending IS NOT NULL THEN s END, ending
 FROM (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN m = 'RADIO LINK FAILURE' THEN 'RADIO_LINK_FAILURE' WHEN m = 'IU RELEASE' AND bad THEN 'IU_RELEASE_ABNORMAL' WHEN m = 'RRC_CONNECTION_RELEASE' AND bad THEN 'RRC_CONNECTION_RELEASE_ABNORMAL'
    WHEN s.conn AND m = 'IU RELEASE' AND NOT s.disc THEN 'MSC_RELEASE_WITHOUT_DISCONNECT' WHEN m = 'RRC_CONNECTION_RELEASE' AND (contains(c, 'NORMAL') OR s.disc) THEN 'RRC_CONNECTION_RELEASE_NORMAL'
    WHEN m IN ('CM_SERVICE_REJECT', 'CALL_REJECT') THEN m WHEN m = 'RAB RELEASE' AND NOT s.conn THEN 'RAB_RELEASE' WHEN m = 'IU RELEASE' AND NOT s.conn THEN 'IU_RELEASE'
    WHEN NOT was_idle AND NOT list_contains(busy2, key) THEN CASE WHEN s.disc THEN 'RETURN_TO_IDLE' ELSE 'RRC_IDLE_TRANSITION' END END AS ending
  FROM (SELECT *, contains(c, 'ABNORMAL') OR contains(c, 'ERROR') AS bad, CASE WHEN s0 IS NOT NULL THEN struct_pack(k := key, a := least(s0.a, ts), z := greatest(s0.z, ts), trig := s0.trig, ots := s0.ots, oseq := s0.oseq, n := s0.n + 1,
     cid := coalesce(s0.cid, call_id), imsi := coalesce(s0.imsi, imsi), tmsi := coalesce(s0.tmsi, tmsi), conn := s0.conn OR m = 'CONNECT', disc := s0.disc OR m = 'DISCONNECT', cm := s0.cm OR m = 'CM_SERVICE_REJECT', ca := s0.ca OR m = 'CALL_REJECT',
     rlf := s0.rlf OR (m = 'RADIO LINK FAILURE' AND NOT s0.conn)) END AS s
   FROM (SELECT *, CASE WHEN held IS NOT NULL THEN held WHEN trig IS NOT NULL THEN struct_pack(k := key, a := CASE WHEN trig LIKE '%PLUS%' THEN pend ELSE ts END, z := CASE WHEN trig LIKE '%PLUS%' THEN pend ELSE ts END, trig := trig, ots := ts,
      oseq := seq, n := 0::BIGINT, cid := NULL::VARCHAR, imsi := NULL::VARCHAR, tmsi := NULL::VARCHAR, conn := false, disc := false, cm := false, ca := false, rlf := false) END AS s0
    FROM (SELECT *, CASE WHEN held IS NOT NULL THEN NULL WHEN was_idle AND m IN ('CM_SERVICE_REQUEST', 'SETUP', 'RAB_ASSIGNMENT_REQUEST', 'CALL_PROCEEDING') THEN m
       WHEN m IN ('CM_SERVICE_REQUEST', 'SETUP', 'CALL_PROCEEDING') AND ts - pend BETWEEN 0 AND 18000000 THEN 'RRC_CONNECTION_REQUEST_PLUS_NAS_CC' END AS trig
     FROM (SELECT *, ([x.t FOR x IN asked2 IF x.k = key])[1] AS pend
      FROM (SELECT *, CASE WHEN held IS NULL AND was_idle AND m = 'RRC_CONNECTION_REQUEST' THEN list_append([x FOR x IN asked IF x.k <> key], struct_pack(k := key, t := ts)) ELSE asked END AS asked2
       FROM (SELECT *, NOT list_contains(busy, key) AS was_idle, CASE WHEN to_idle IS NULL THEN busy WHEN to_idle THEN [x FOR x IN busy IF x <> key] WHEN list_contains(busy, key) THEN busy ELSE list_append(busy, key) END AS busy2,
          ([x FOR x IN live IF x.k = key])[1] AS held
        FROM (SELECT w.busy, w.asked, w.live, q.*, CASE WHEN own = '__ANON__' AND len([x FOR x IN live IF x.k <> '__ANON__']) = 1 THEN ([x.k FOR x IN live IF x.k <> '__ANON__'])[1] ELSE own END AS key
         FROM w JOIN q ON q.log_id = w.log_id AND q.rn = w.rn + 1)))))))))
, e AS (SELECT log_id, gone AS s, ending FROM w WHERE ending IS NOT NULL
  UNION ALL SELECT log_id, unnest(live), NULL FROM w WHERE rn = (SELECT max(x.rn) FROM q x WHERE x.log_id = w.log_id))
, f AS (SELECT log_id, s.*, ending, s.z - s.a AS len, CASE WHEN ending IN ('RADIO_LINK_FAILURE', 'IU_RELEASE_ABNORMAL', 'RRC_CONNECTION_RELEASE_ABNORMAL') THEN 'loss' WHEN ending = 'MSC_RELEASE_WITHOUT_DISCONNECT' THEN 'drop'
   WHEN ending IN ('RRC_CONNECTION_RELEASE_NORMAL', 'RETURN_TO_IDLE', 'RRC_IDLE_TRANSITION') THEN 'normal' WHEN ending IS NOT NULL THEN 'fail' END AS kind FROM e)
, g AS (SELECT *, coalesce(kind = 'drop' OR (kind = 'loss' AND conn), false) AS lost, ending IS NOT NULL AND NOT conn AND len < 7200000 AS short, ending IS NOT NULL AND NOT conn AND len > 108000000 AS late,
   ending IS NOT NULL AND NOT conn AND len BETWEEN 7200000 AND 108000000 AS failed FROM f)
SELECT log_id, k AS key, cid AS call_id, imsi, tmsi, a AS start_ts, z AS end_ts, CASE WHEN ending IS NOT NULL THEN len END AS duration_ms, trig AS start_trigger, ending AS end_trigger,
 CASE WHEN short THEN 'IGNORED_SHORT_ATTEMPT' WHEN late THEN 'INCOMPLETE_OR_ONGOING' WHEN failed THEN 'CALL_SETUP_FAILURE' WHEN lost THEN CASE WHEN cid IS NOT NULL THEN 'DROP' ELSE 'RRC_SESSION_ABNORMAL_END' END
  WHEN kind = 'normal' THEN 'NORMAL' WHEN kind IS NOT NULL THEN 'CALL_SETUP_FAILURE' END AS end_type,
 CASE WHEN lost AND cid IS NOT NULL THEN 'RRC_SESSION_ABNORMAL_END' ELSE 'RRC_SESSION' END AS result_type, lost AND cid IS NOT NULL AND conn AS "drop", failed AS setup_failure, short AS ignored, late AS incomplete, conn AS has_connect,
 CASE WHEN failed THEN CASE WHEN cm AND ca THEN 'CORE_NAS_REJECT' WHEN rlf THEN 'EARLY_RADIO_FAILURE' ELSE 'UNKNOWN_FAILURE' END END AS failure_code, n AS records,
 row_number() OVER (PARTITION BY log_id ORDER BY ots, oseq) AS session_no
FROM g
"""


@query("K9_rrc_session_machine", "v_msgs", K9, recursive=True)
def _(v):
    return rrc_sessions.rrc_session_machine(v.v_msgs, details="details", rrc_cause="cause", timers=rrc_sessions.Timers(18_000_000, 7_200_000, 108_000_000), block_ms=BLOCK_MS)
