"""Queries on column expressions."""

from pyspark.sql import functions as F

from drivescope.functions import messages as M
from drivescope.functions import scalars as S
from drivescope.plans.registry import query


def r6(c):
    return F.round(c, 6)


@query("C6_parse_ts", "ev", """
, t AS (SELECT event_id, k, ts_ms, CASE k % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') || ',' || (k % 10) WHEN 1 THEN
   strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN CAST(ts_ms AS VARCHAR) ELSE 'soon' END AS txt FROM ev)
SELECT event_id, CASE k % 4 WHEN 0 THEN (ts_ms // 1000 * 1000) % 86400000 + (k % 10) * 100 WHEN 1 THEN ts_ms // 1000 * 1000
  WHEN 2 THEN ts_ms END AS parsed FROM t
""")
def _(v):
    txt = (
        F.when(F.col("k") % 4 == 0, F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(","), (F.col("k") % 10).cast("string")))
        .when(F.col("k") % 4 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(F.col("k") % 4 == 2, F.col("ts_ms").cast("string")).otherwise("soon")
    )
    return v.ev.withColumn("txt", txt).select("event_id", S.parse_ts("txt").alias("parsed"))


@query("C7_format_time", "ev", """
SELECT event_id, strftime(to_timestamp(0)::TIMESTAMP + to_milliseconds(ts_ms), '%H:%M:%S.%g') AS tod,
  strftime(to_timestamp(0)::TIMESTAMP + to_milliseconds(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ev
""")
def _(v):
    return v.ev.select("event_id", S.format_ms_of_day("ts_ms").alias("tod"), S.format_iso("ts_ms").alias("iso"))


TECHS = ["lte fdd", "4G", "NR SA", "5G", "wcdma", "3G", "GSM 900", "2G", "cdma"]


@query("C8_normalize_tech", "ev", f"""
, t AS (SELECT event_id, upper({TECHS}[k % 9 + 1]) AS t FROM ev)
SELECT event_id, CASE WHEN t LIKE '%LTE%' OR t = '4G' THEN 'LTE' WHEN t LIKE '%NR%' OR t LIKE '%5G%' THEN 'NR' WHEN t LIKE '%WCDMA%'
 OR t LIKE '%UMTS%' OR t = '3G' THEN 'UMTS' WHEN t LIKE '%GSM%' OR t = '2G' THEN 'GSM' ELSE t END AS tech FROM t
""")
def _(v):
    t = F.element_at(F.array(*[F.lit(x) for x in TECHS]), (F.col("k") % 9 + 1).cast("int"))
    return v.ev.select("event_id", S.normalize_tech(t).alias("tech"))


@query("C11_band", "ev", """
, f AS (SELECT event_id, (event_id * 37) % 7000 AS e, 2900 + (event_id * 91) % 8000 AS u FROM ev)
SELECT event_id, CASE WHEN e <= 599 THEN 'B1 (2100)' WHEN e <= 1199 THEN 'B2 (1900)' WHEN e <= 1949 THEN 'B3 (1800)'
  WHEN e BETWEEN 2400 AND 2649 THEN 'B5 (850)' WHEN e BETWEEN 2750 AND 3449 THEN 'B7 (2600)' WHEN e BETWEEN 3450 AND 3799 THEN 'B8 (900)'
  WHEN e BETWEEN 6150 AND 6449 THEN 'B20 (800)' ELSE 'Unknown' END AS lte_band,
  CASE WHEN u BETWEEN 10562 AND 10838 THEN 'B1 (2100)' WHEN u BETWEEN 2937 AND 3088 THEN 'B8 (900)' END AS umts_band FROM f
""")
def _(v):
    e, u = (F.col("event_id") * 37) % 7000, F.lit(2900) + (F.col("event_id") * 91) % 8000
    return v.ev.select("event_id", S.band_from_earfcn(e).alias("lte_band"), S.band_from_uarfcn(u).alias("umts_band"))


@query("C12_index_scales", "ev", """
, i AS (SELECT event_id, event_id % 110 - 5 AS i FROM ev)
SELECT event_id, CAST(CASE WHEN i BETWEEN 0 AND 97 THEN -140 + i END AS DOUBLE) AS rsrp,
 CAST(CASE WHEN i BETWEEN 0 AND 34 THEN -19.5 + i / 2.0 END AS DOUBLE) AS rsrq, CAST(CASE WHEN i BETWEEN 0 AND 96 THEN -120 + i END AS DOUBLE) AS rscp,
 CAST(CASE WHEN i BETWEEN 0 AND 49 THEN -24 + i / 2.0 END AS DOUBLE) AS ecno, CAST(CASE WHEN i BETWEEN 0 AND 63 THEN -110 + i END AS DOUBLE) AS rxlev FROM i
""")
def _(v):
    i = F.col("event_id") % 110 - 5
    return v.ev.select("event_id", S.rsrp_idx_to_dbm(i).alias("rsrp"), S.rsrq_idx_to_db(i).alias("rsrq"),
                       S.utra_rscp_idx_to_dbm(i).alias("rscp"), S.utra_ecno_idx_to_db(i).alias("ecno"),
                       S.geran_rxlev_to_dbm(i).alias("rxlev"))


@query("C13_split_eci", "ev", """
, c AS (SELECT event_id, event_id * 7919 % 70000000 AS eci FROM ev)
SELECT event_id, CASE WHEN eci > 255 THEN eci // 256 END AS enb, CASE WHEN eci > 255 THEN eci % 256 END AS cell,
 CASE WHEN eci > 255 THEN (eci // 256) || '-' || (eci % 256) ELSE '' END AS label, eci >> 16 AS rnc, eci & 65535 AS cid FROM c
""")
def _(v):
    eci = (F.col("event_id") * 7919) % 70000000
    return v.ev.select("event_id", S.enb_id(eci).alias("enb"), S.enb_cell(eci).alias("cell"), S.enb_label(eci).alias("label"),
                       S.long_cid_rnc(eci).alias("rnc"), S.long_cid_cell(eci).alias("cid"))


@query("C14_parse_tac", "ev", """
, t AS (SELECT event_id, k, event_id % 70000 AS n FROM ev)
SELECT event_id, CASE k % 5 WHEN 0 THEN CASE WHEN n <= 65535 THEN n END WHEN 1 THEN CASE WHEN n <= 65535 THEN n END
  WHEN 2 THEN 8362 WHEN 3 THEN n % 256 END AS tac FROM t
""")
def _(v):
    k, n = F.col("k"), F.col("event_id") % 70000
    txt = (
        F.when(k % 5 == 0, n.cast("string")).when(k % 5 == 1, F.concat(F.lit("0x"), F.hex(n))).when(k % 5 == 2, "20AA")
        .when(k % 5 == 3, F.concat(F.lit("'"), F.lpad(F.bin(n % 256), 8, "0"), F.lit("'B"))).otherwise("no tac")
    )
    return v.ev.select("event_id", S.parse_tac(txt).alias("tac"))


@query("C15_enum_values", "ev", """
SELECT event_id, CAST(CASE k % 3 WHEN 0 THEN k % 15 - 7 WHEN 1 THEN k % 9 + 0.5 ELSE k END AS DOUBLE) AS db,
 CASE k % 3 WHEN 0 THEN k * 10 WHEN 1 THEN k END AS ms FROM ev
""")
def _(v):
    k = F.col("k")
    db = (
        F.when(k % 3 == 0, F.concat(F.lit("dB"), (k % 15 - 7).cast("string")))
        .when(k % 3 == 1, F.concat((k % 9).cast("string"), F.lit(".5 db"))).otherwise(k.cast("string"))
    )
    ms = F.when(k % 3 == 0, F.concat(F.lit("ms"), (k * 10).cast("string"))).when(k % 3 == 1, k.cast("string")).otherwise("spare")
    return v.ev.select("event_id", S.enum_db(db).alias("db"), S.enum_ms(ms).alias("ms"))


@query("C16_effective_delta", "v_points", """
SELECT seq, CASE WHEN k % 5 <> 0 THEN (n1_rsrp + coalesce(CASE WHEN k % 2 = 0 THEN 1.5 END, 0)) - (rsrp + coalesce(CASE WHEN k % 3 = 0 THEN 2.0 END, 0)) END AS delta FROM v_points
""")
def _(v):
    d = v.v_points.select("seq", "k", "rsrp", F.when(F.col("k") % 5 != 0, F.col("n1_rsrp")).alias("t"))
    delta = S.effective_delta("rsrp", "t", F.when(F.col("k") % 3 == 0, 2.0), F.when(F.col("k") % 2 == 0, 1.5))
    return d.select("seq", delta.alias("delta"))


@query("C17_haversine", "v_points", """
SELECT seq, round(6371000 * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS meters FROM (SELECT seq, pow(sin(radians(33.5 - lat) / 2), 2)
 + cos(radians(lat)) * cos(radians(33.5)) * pow(sin(radians(-7.2 - lon) / 2), 2) AS h FROM v_points)
""")
def _(v):
    return v.v_points.select("seq", F.round(S.haversine_m("lat", "lon", F.lit(33.5), F.lit(-7.2)), 3).alias("meters"))


@query("C18_bearing", "v_points", """
SELECT seq, round((degrees(atan2(sin(d) * cos(radians(33.5)), cos(a) * sin(radians(33.5)) - sin(a) * cos(radians(33.5)) * cos(d))) + 360) % 360, 6) AS bearing
FROM (SELECT seq, radians(lat) AS a, radians(-7.2 - lon) AS d FROM v_points)
""")
def _(v):
    return v.v_points.select("seq", r6(S.bearing_deg("lat", "lon", F.lit(33.5), F.lit(-7.2))).alias("bearing"))


@query("C19_sector_polygon", "v_sites", """
, p AS (SELECT *, radians(azimuth - beam / 2) AS b1, radians(azimuth + beam / 2) AS b2 FROM v_sites)
SELECT site_no, CAST(CASE WHEN beam > 300 THEN 1 ELSE 3 END AS BIGINT) AS corners,
 CASE WHEN beam <= 300 THEN round(lat + cos(b1) * 500 / 111111, 8) END AS lat1,
 CASE WHEN beam <= 300 THEN round(lon + sin(b1) * 500 / (111111 * cos(radians(lat))), 8) END AS lon1,
 CASE WHEN beam <= 300 THEN round(lat + cos(b2) * 500 / 111111, 8) END AS lat2,
 CASE WHEN beam <= 300 THEN round(lon + sin(b2) * 500 / (111111 * cos(radians(lat))), 8) END AS lon2,
 round(lat + cos(radians(azimuth)) * 500 / 111111, 8) AS tip_lat FROM p
""")
def _(v):
    d = v.v_sites.withColumn("p", S.sector_polygon("lat", "lon", "azimuth", "beam", 500.0))
    at = lambda i, f: F.round(F.try_element_at("p", F.lit(i))[f], 8)
    return d.select("site_no", F.size("p").cast("long").alias("corners"), at(2, "lat").alias("lat1"), at(2, "lon").alias("lon1"),
                    at(3, "lat").alias("lat2"), at(3, "lon").alias("lon2"),
                    F.round(S.destination_point("lat", "lon", "azimuth", 500.0)["lat"], 8).alias("tip_lat"))


@query("C20_square_footprint", "v_points", """
SELECT seq, x - 25 AS x_min, y - 25 AS y_min, x + 25 AS x_max, y + 25 AS y_max
FROM (SELECT seq, CAST(seq * 10 AS DOUBLE) AS x, CAST(seq * 7 AS DOUBLE) AS y FROM v_points)
""")
def _(v):
    d = v.v_points.select("seq", (F.col("seq") * 10).cast("double").alias("x"), (F.col("seq") * 7).cast("double").alias("y"))
    return d.select("seq", S.square_footprint("x", "y").alias("f")).select("seq", "f.*")


@query("C21_classify_event_name", "v_msgs", r"""
, m AS (SELECT seq, 'event  ' || lower(message) AS n FROM v_msgs)
SELECT seq, CASE WHEN regexp_matches(n, 'handover complete|ho complete|rrcconnectionreconfigurationcomplete|\bhos\b|\bhoi\b') THEN 'ho_complete'
 WHEN regexp_matches(n, 'a3/a5 event|\bhoa\b|ho command|handover command|rrcconnectionreconfiguration') THEN 'ho_command'
 WHEN regexp_matches(n, 'measurementreport|measurement report') THEN 'measurement_report'
 WHEN regexp_matches(n, 'rlf|radio link failure|re-establishment|reestablishment|call drop|drop call|hof|handover failure') THEN 'failure'
 WHEN regexp_matches(n, 'rach|target access|sync') THEN 'access' ELSE 'other' END AS class FROM m
""")
def _(v):
    return v.v_msgs.select("seq", M.classify_event_name(F.lit("event"), None, "message").alias("class"))


@query("C22_cause_label", "v_calls", "SELECT seq, CASE k % 13 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(S.CAUSES.values())) + " ELSE 'Unknown cause' END AS label FROM v_calls")
def _(v):
    code = F.element_at(F.array(*[F.lit(c) for c in [*S.CAUSES, 1, 2]]), (F.col("k") % 13 + 1).cast("int"))
    return v.v_calls.select("seq", S.cause_label(code).alias("label"))


@query("C23_strip_accents", "", """
SELECT doc_id, regexp_replace(upper(strip_accents(replace(text || ' ŠžőğąĘŵ', 'ß', 'SS'))), '[^A-Z]', '', 'g') AS key FROM documents
""")
def _(v):
    return v.table("documents").select("doc_id", S.strip_accents_upper_alpha(F.concat("text", F.lit(" ŠžőğąĘŵ"))).alias("key"))


@query("C24_bsic_and_psc", "ev", """
SELECT event_id, CASE k % 4 WHEN 0 THEN (k % 8) || '-' || (k % 7) WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN (k % 8) || '-3' END AS bsic,
 CASE k % 3 WHEN 0 THEN k WHEN 1 THEN k + 100 ELSE k + 200 END AS psc FROM ev
""")
def _(v):
    k = F.col("k")
    bsic = (
        F.when(k % 4 == 0, F.format_string('{"networkColourCode": %d, "baseStationColourCode": %d}', k % 8, k % 7))
        .when(k % 4 == 1, F.format_string('{"bsic": %d}', k)).when(k % 4 == 2, F.format_string(" %d-3 ", k % 8)).otherwise("[object Object]")
    )
    psc = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.format_string('{"fdd": %d}', k + 100)).otherwise(
        F.format_string('{"tdd": %d}', k + 200)
    )
    return v.ev.select("event_id", S.normalize_bsic(bsic).alias("bsic"), S.utra_psc(psc).alias("psc"))


@query("C25_params_map", "ev", """
SELECT event_id, CAST(k AS VARCHAR) AS first_wins, event_type AS ci_value, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n FROM ev
""")
def _(v):
    p = lambda i, val: F.struct(F.lit(i).alias("param_id"), val.alias("param_value"))
    k = F.col("k").cast("string")
    base = F.array(p("Cause", k), p("Cause", F.lit("late")), p(" ", F.lit("blank")), p("Name", F.col("event_type")))
    params = F.when(F.col("k") % 2 == 0, base).otherwise(F.concat(base, F.array(p("Extra", k))))
    d = v.ev.withColumn("params", params).withColumn("m", S.params_map("params"))
    return d.select("event_id", F.col("m")["Cause"].alias("first_wins"), S.param_ci("params", "NAME").alias("ci_value"),
                    F.size("m").cast("long").alias("n"))


@query("C26_interesting_events", "v_msgs", r"""
SELECT seq, message FROM v_msgs WHERE regexp_matches(lower(message), '(rrc|idle|connected|handover|\bho\b|rlf|re-?establish|cell|pci|earfcn)')
""")
def _(v):
    return v.v_msgs.where(M.interesting("message")).select("seq", "message")


@query("C28_neighbor_metric_name", "v_kpi", r"""
SELECT seq, CASE WHEN name LIKE 'Radio.Lte.Neighbor%' THEN CAST(regexp_extract(name, '\[(\d+)\]', 1) AS BIGINT) END AS neighbor_index,
 CASE WHEN name LIKE 'Radio.Lte.Neighbor%' THEN lower(regexp_extract(name, '\]\.(\w+)$', 1)) END AS field,
 name AS base, CASE WHEN k % 2 = 0 THEN idx END AS qualifier,
 CASE WHEN k % 3 = 0 THEN idx WHEN k % 3 = 1 THEN k END AS sample_index FROM v_kpi
""")
def _(v):
    q = F.when(F.col("k") % 2 == 0, F.concat("name", F.lit("|idx="), F.col("idx").cast("string"))).otherwise(F.col("name"))
    d = v.v_kpi.withColumn("q", q)
    explicit = F.when(F.col("k") % 3 == 0, F.col("idx")).otherwise(5000)
    text = F.when(F.col("k") % 3 == 1, F.concat(F.lit("slot = "), F.col("k").cast("string")))
    return d.select("seq", S.neighbor_metric_index("name").alias("neighbor_index"), S.neighbor_metric_field("name").alias("field"),
                    S.index_qualifier_base("q").alias("base"), S.index_qualifier("q").alias("qualifier"),
                    S.sample_index(explicit, text=text).alias("sample_index"))


@query("C33_call_identifiers", "v_msgs", """
SELECT seq, CASE WHEN k % 4 = 0 THEN CAST(k % 11 AS VARCHAR) END AS call_id, CASE WHEN k % 4 = 1 THEN '60400' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS imsi,
 CASE WHEN k % 4 = 2 OR (k % 4 = 1 AND k % 3 = 0) THEN 'A1B2C' || (k % 10) END AS tmsi,
 CASE WHEN k % 4 = 0 THEN 'CALL:' || (k % 11) WHEN k % 4 = 1 THEN 'IMSI:60400' || lpad(CAST(user_id AS VARCHAR), 6, '0') ||
   CASE WHEN k % 3 = 0 THEN '|TMSI:A1B2C' || (k % 10) ELSE '' END WHEN k % 4 = 2 THEN 'TMSI:A1B2C' || (k % 10) ELSE '__ANON__' END AS key FROM v_msgs
""")
def _(v):
    txt = F.concat_ws(" | ", "message", "details")
    d = v.v_msgs.select("seq", M.call_id(txt).alias("call_id"), M.imsi(txt).alias("imsi"), M.tmsi(txt).alias("tmsi"))
    return d.withColumn("key", M.correlation_key("call_id", "imsi", "tmsi"))


@query("C34_semantic_flags", "v_msgs", r"""
, m AS (SELECT seq, upper(message) AS m, upper(cause) AS c FROM v_msgs)
SELECT seq, m LIKE '%CM\_SERVICE\_REQUEST%' ESCAPE '\' AS cm_service_request, m = 'SETUP' AS setup, m = 'CONNECT' AS connect,
 m IN ('CM_SERVICE_REQUEST', 'SETUP', 'CALL_PROCEEDING') AS nas_call_control, m = 'RADIO LINK FAILURE' AS rlf, m = 'IU RELEASE' AND (contains(c, 'ABNORMAL') OR contains(c, 'ERROR')) AS iu_release_abnormal,
 m = 'RRC_CONNECTION_RELEASE' AND contains(c, 'NORMAL') AS rrc_release_normal, m IN ('RELEASE', 'RAB RELEASE', 'IU RELEASE') AS release, m = 'HANDOVER FAILURE' AS ho_failure,
 CASE WHEN m IN ('RAB_ASSIGNMENT_REQUEST', 'RAB_ASSIGNMENT_COMPLETE') THEN 'START' WHEN m = 'RAB RELEASE' THEN 'END' END AS rab_phase FROM m
""")
def _(v):
    f = M.semantic_flags(M.envelope("message"), "cause")
    names = ["cm_service_request", "setup", "connect", "nas_call_control", "rlf", "iu_release_abnormal", "rrc_release_normal",
             "release", "ho_failure"]
    return v.v_msgs.select("seq", *[f[n].alias(n) for n in names], M.rab_phase("message").alias("rab_phase"))


@query("C35_release_cause_flags", "v_msgs", """
SELECT seq, cause, CASE WHEN contains(lower(cause), 'normal') THEN 'normal' ELSE 'abnormal' END AS kind FROM v_msgs
WHERE cause NOT IN ('', 'N/A', '-')
""")
def _(v):
    return v.v_msgs.select("seq", "cause", M.release_kind("cause").alias("kind")).where("kind is not null")


@query("C36_call_measurements", "v_radio", """
SELECT seq, coalesce(CASE WHEN k % 4 = 0 THEN rscp END, CASE WHEN k % 3 = 0 THEN rssi END) AS rscp, CASE WHEN k % 5 = 0 THEN ecno END AS ecno,
 CASE WHEN k % 7 = 0 THEN CAST(uarfcn AS BIGINT) END AS freq FROM v_radio WHERE k % 4 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0
""")
def _(v):
    from drivescope.operators.sessions import call_measurements

    k = F.col("k")
    d = v.v_radio.select("seq", F.when(k % 4 == 0, F.col("rscp")).alias("level"), F.when(k % 3 == 0, F.col("rssi")).alias("serving_rscp"),
                         F.when(k % 5 == 0, F.col("ecno")).alias("ecno"), F.when(k % 7 == 0, F.col("uarfcn")).alias("freq"))
    return call_measurements(d, {"rscp": ["level", "serving_rscp"], "ecno": ["ecno"], "freq": ["freq"]}).select("seq", "rscp", "ecno", "freq")
