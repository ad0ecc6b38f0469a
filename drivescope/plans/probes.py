"""Drive-test shaped views of the given tables, written once for Spark and once as SQL.

All of them are row-wise projections of ``events`` (or of ``nation``/``region``/``supplier``), so every operator that
runs on them sees whole tables and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

# Metric names by (event type, k % 4).
KPI_NAMES = {
    "signup": ["Radio.Lte.ServingCell[0].Rsrp", "Radio.Lte.ServingCell[0].Rsrq", "Radio.Lte.ServingCell[0].RsSinr",
               "Radio.Lte.ServingCell[0].Pci"],
    "click": ["Radio.Lte.ServingCellTotal.Pdsch.Throughput", "Radio.Lte.ServingCellTotal.Pusch.Throughput",
              "Data.Http.Download.Throughput", "Data.Http.Upload.Throughput"],
    "purchase": ["Radio.Lte.ServingCell[0].Pdsch.NumberOfResourceBlocks", "Radio.Lte.ServingCell[0].Cqi",
                 "Radio.Lte.ServingCell[0].Pdsch.Mcs", "Radio.Lte.ServingCell[0].Pdsch.Bler"],
    "error": ["Radio.Lte.Neighbor[0].Rsrp", "Radio.Lte.Neighbor[0].Pci", "Radio.Lte.Neighbor[1].Rsrp",
              "Radio.Lte.Neighbor[1].Pci"],
    "view": ["Voice.Volte.Call.State", "Radio.Common.Rrc.State", "Radio.Lte.Rank4.FeedbackCount", "Data.Ping.Rtt"],
}

SQL: dict[str, str] = {
    "ev": """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, ts, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "v_series": """v_series AS (SELECT user_id % 5 AS run_id, event_type AS name, ts_ms, value AS value_num,
        user_id % 8 AS idx, event_id AS seq, k FROM ev)""",
    "v_kpi": "v_kpi AS (SELECT user_id % 5 AS run_id, CASE "
    + " ".join(
        f"WHEN event_type = '{t}' AND k % 4 = {i} THEN '{n}'" for t, names in KPI_NAMES.items() for i, n in enumerate(names)
    )
    + """ END AS name, ts_ms, value AS value_num, CASE WHEN k % 9 = 0 THEN 'S' || (k % 5) END AS value_str,
        1000 + k % 4 AS metric_id, user_id % 8 AS idx, event_id AS seq, k FROM ev)""",
    "v_points": """v_points AS (SELECT user_id % 5 AS log_id, user_id % 10 AS device_id, event_id AS seq, ts_ms,
        33 + (event_id % 1000) / 1e3 AS lat, -7 - (event_id % 777) / 1e3 AS lon, 'LTE' AS tech, k % 7 AS pci,
        CASE WHEN k % 2 = 0 THEN 1320 ELSE 3050 END AS earfcn,
        CASE WHEN k % 3 <> 0 THEN CAST(300 + k % 5 AS VARCHAR) END AS eci,
        CAST(-140 + event_id % 97 AS DOUBLE) AS rsrp, CAST(-20 + event_id % 17 AS DOUBLE) AS rsrq,
        CAST(event_id % 31 - 5 AS DOUBLE) AS sinr,
        (k + 1) % 7 AS n1_pci, CASE WHEN k % 2 = 0 THEN 1320 ELSE 3050 END AS n1_earfcn,
        CAST(-140 + (event_id * 7) % 97 AS DOUBLE) AS n1_rsrp, CAST(-20 + (event_id * 3) % 17 AS DOUBLE) AS n1_rsrq,
        (k + 2) % 7 AS n2_pci, CASE WHEN k % 2 = 0 THEN 3050 ELSE 1320 END AS n2_earfcn,
        CAST(-140 + (event_id * 13) % 97 AS DOUBLE) AS n2_rsrp, CAST(-20 + (event_id * 5) % 17 AS DOUBLE) AS n2_rsrq,
        event_type, k FROM ev WHERE event_type IN ('view', 'click', 'purchase'))""",
    "v_marks": """v_marks AS (SELECT user_id % 5 AS log_id, user_id % 10 AS device_id, event_id AS seq, ts_ms,
        CASE WHEN event_id % 3 = 0 THEN 'measurement_report' WHEN event_type = 'signup' THEN 'ho_command'
             WHEN event_id % 3 = 1 THEN 'ho_complete' ELSE 'failure' END AS class,
        CASE WHEN k % 5 <> 0 THEN k % 7 END AS tgt_pci, k % 4 = 1 AS exact_a3, k
        FROM ev WHERE event_type IN ('signup', 'error'))""",
    "v_calls": """v_calls AS (SELECT user_id % 10 AS device_id, user_id * 100 + day(ts) AS call_id, ts_ms,
        event_id AS seq, CASE event_type WHEN 'signup' THEN 'CAA' WHEN 'click' THEN 'CAC' WHEN 'purchase' THEN 'CAD'
        WHEN 'error' THEN 'CAF' ELSE 'CARE' END AS header, k % 4 AS state, k % 4 AS status,
        CASE k % 4 WHEN 0 THEN 16 WHEN 1 THEN 16 WHEN 2 THEN 102 ELSE 41 END AS cause,
        CASE WHEN k % 3 = 0 THEN k % 50 END AS reason, '06' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS dialed, k
        FROM ev)""",
    "v_radio": """v_radio AS (SELECT user_id % 10 AS device_id, ts_ms, event_id AS seq, ts_ms // 7200000 AS scan,
        (ts_ms // 7200000) * 7200000 AS scan_ms, k % 6 AS psc, event_id % 3 AS branch,
        CAST(-120 + event_id % 70 AS DOUBLE) AS rscp, -24 + (event_id % 49) / 2.0 AS ecno,
        CAST(-100 + event_id % 60 AS DOUBLE) AS rssi, 40000 + k % 11 AS cell_id, 3032 AS uarfcn,
        CAST(event_id % 27 - 3 AS DOUBLE) AS tx, CAST((event_id % 201) / 2.0 AS DOUBLE) AS bler, event_type, k FROM ev)""",
    "v_cfg": """v_cfg AS (SELECT user_id % 5 AS run_id, ts_ms, event_id AS seq, k % 8 AS meas_id,
        CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, k % 3 AS object_id, k % 4 AS report_id,
        CASE WHEN k % 2 = 0 THEN 1320 ELSE 3050 END AS earfcn, event_type, k FROM ev)""",
    "v_region": """v_region AS (SELECT n_nationkey AS province_id, n_name AS province, n_regionkey AS region_code,
        r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "v_sites": """v_sites AS (SELECT s_suppkey AS site_no, s_name AS site_name, s_suppkey % 7 AS pci,
        CASE WHEN s_suppkey % 2 = 0 THEN 1320 ELSE 3050 END AS freq, 33 + (s_nationkey % 25) / 25.0 AS lat,
        -7 - (s_suppkey % 20) / 26.0 AS lon, CAST(300 + s_suppkey % 5 AS VARCHAR) AS eci,
        (s_suppkey * 36) % 360 AS azimuth, CASE WHEN s_suppkey % 4 = 0 THEN 360 ELSE 65 END AS beam FROM supplier)""",
}

_NEEDS = {
    "v_series": ["ev"], "v_kpi": ["ev"], "v_points": ["ev"], "v_marks": ["ev"], "v_calls": ["ev"], "v_radio": ["ev"],
    "v_cfg": ["ev"],
}


def with_sql(views: list[str], body: str, recursive: bool = False) -> str:
    """SQL text: the named views, then ``body`` (a SELECT, or more CTEs starting with a comma, which may be recursive)."""
    names: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    return (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + "\n" if names else "") + body.strip()


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def ev(v):
    return v.table("events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("ts").cast("timestamp").alias("ts"),
        "user_id", "event_type", "value", _k().alias("k"),
    )


def _mod(col, n):
    return F.col(col) % F.lit(n)


def v_series(v):
    return ev(v).select(
        _mod("user_id", 5).alias("run_id"), F.col("event_type").alias("name"), "ts_ms", F.col("value").alias("value_num"),
        _mod("user_id", 8).alias("idx"), F.col("event_id").alias("seq"), "k",
    )


def v_kpi(v):
    name = None
    for t, names in KPI_NAMES.items():
        for i, n in enumerate(names):
            hit = (F.col("event_type") == t) & (_mod("k", 4) == i)
            name = F.when(hit, n) if name is None else name.when(hit, n)
    return ev(v).select(
        _mod("user_id", 5).alias("run_id"), name.alias("name"), "ts_ms", F.col("value").alias("value_num"),
        F.when(_mod("k", 9) == 0, F.concat(F.lit("S"), _mod("k", 5).cast("string"))).alias("value_str"),
        (F.lit(1000) + _mod("k", 4)).alias("metric_id"), _mod("user_id", 8).alias("idx"), F.col("event_id").alias("seq"), "k",
    )


def _freq(even, odd, k="k"):
    return F.when(_mod(k, 2) == 0, even).otherwise(odd).cast("long")


def v_points(v):
    e = F.col("event_id")
    return ev(v).where(F.col("event_type").isin("view", "click", "purchase")).select(
        _mod("user_id", 5).alias("log_id"), _mod("user_id", 10).alias("device_id"), e.alias("seq"), "ts_ms",
        (F.lit(33) + (e % 1000) / 1e3).alias("lat"), (F.lit(-7) - (e % 777) / 1e3).alias("lon"), F.lit("LTE").alias("tech"),
        _mod("k", 7).alias("pci"), _freq(1320, 3050).alias("earfcn"),
        F.when(_mod("k", 3) != 0, (F.lit(300) + _mod("k", 5)).cast("string")).alias("eci"),
        (F.lit(-140) + e % 97).cast("double").alias("rsrp"), (F.lit(-20) + e % 17).cast("double").alias("rsrq"),
        (e % 31 - 5).cast("double").alias("sinr"),
        ((F.col("k") + 1) % 7).alias("n1_pci"), _freq(1320, 3050).alias("n1_earfcn"),
        (F.lit(-140) + (e * 7) % 97).cast("double").alias("n1_rsrp"),
        (F.lit(-20) + (e * 3) % 17).cast("double").alias("n1_rsrq"),
        ((F.col("k") + 2) % 7).alias("n2_pci"), _freq(3050, 1320).alias("n2_earfcn"),
        (F.lit(-140) + (e * 13) % 97).cast("double").alias("n2_rsrp"),
        (F.lit(-20) + (e * 5) % 17).cast("double").alias("n2_rsrq"), "event_type", "k",
    )


def neighbor_array():
    """The two neighbours of ``v_points`` as an array of structs."""
    def one(i):
        return F.struct(
            F.lit(f"N{i}").alias("role"), F.col(f"n{i}_pci").alias("pci"), F.col(f"n{i}_earfcn").alias("earfcn"),
            F.lit(None).cast("string").alias("eci"), F.lit(None).cast("string").alias("name"),
            F.col(f"n{i}_rsrp").alias("rsrp"), F.col(f"n{i}_rsrq").alias("rsrq"), F.lit(None).cast("double").alias("sinr"),
        )

    return F.array(one(1), one(2))


def v_marks(v):
    e = F.col("event_id")
    return ev(v).where(F.col("event_type").isin("signup", "error")).select(
        _mod("user_id", 5).alias("log_id"), _mod("user_id", 10).alias("device_id"), e.alias("seq"), "ts_ms",
        F.when(e % 3 == 0, "measurement_report").when(F.col("event_type") == "signup", "ho_command")
        .when(e % 3 == 1, "ho_complete").otherwise("failure").alias("class"),
        F.when(_mod("k", 5) != 0, _mod("k", 7)).alias("tgt_pci"), (_mod("k", 4) == 1).alias("exact_a3"), "k",
    )


def v_calls(v):
    return ev(v).select(
        _mod("user_id", 10).alias("device_id"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("call_id"), "ts_ms",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "CAA").when(F.col("event_type") == "click", "CAC")
        .when(F.col("event_type") == "purchase", "CAD").when(F.col("event_type") == "error", "CAF").otherwise("CARE")
        .alias("header"),
        _mod("k", 4).alias("state"), _mod("k", 4).alias("status"),
        F.when(_mod("k", 4) <= 1, 16).when(_mod("k", 4) == 2, 102).otherwise(41).cast("long").alias("cause"),
        F.when(_mod("k", 3) == 0, _mod("k", 50)).alias("reason"),
        F.concat(F.lit("06"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("dialed"), "k",
    )


def v_radio(v):
    e = F.col("event_id")
    scan = F.floor(F.col("ts_ms") / 7200000)
    return ev(v).select(
        _mod("user_id", 10).alias("device_id"), "ts_ms", e.alias("seq"), scan.alias("scan"),
        (scan * 7200000).alias("scan_ms"), _mod("k", 6).alias("psc"), (e % 3).alias("branch"),
        (F.lit(-120) + e % 70).cast("double").alias("rscp"), (F.lit(-24) + (e % 49) / 2).alias("ecno"),
        (F.lit(-100) + e % 60).cast("double").alias("rssi"), (F.lit(40000) + _mod("k", 11)).alias("cell_id"),
        F.lit(3032).cast("long").alias("uarfcn"), (e % 27 - 3).cast("double").alias("tx"),
        ((e % 201) / 2).alias("bler"), "event_type", "k",
    )


def v_cfg(v):
    return ev(v).select(
        _mod("user_id", 5).alias("run_id"), "ts_ms", F.col("event_id").alias("seq"), _mod("k", 8).alias("meas_id"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), _mod("k", 3).alias("object_id"),
        _mod("k", 4).alias("report_id"), _freq(1320, 3050).alias("earfcn"), "event_type", "k",
    )


def v_region(v):
    return v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("province_id"), F.col("n_name").alias("province"),
        F.col("n_regionkey").alias("region_code"), F.col("r_name").alias("region"),
    )


def v_sites(v):
    s = F.col("s_suppkey")
    return v.table("supplier").select(
        s.alias("site_no"), F.col("s_name").alias("site_name"), (s % 7).alias("pci"), _freq(1320, 3050, "s_suppkey").alias("freq"),
        (F.lit(33) + (F.col("s_nationkey") % 25) / 25.0).alias("lat"), (F.lit(-7) - (s % 20) / 26.0).alias("lon"),
        (F.lit(300) + s % 5).cast("string").alias("eci"), ((s * 36) % 360).alias("azimuth"),
        F.when(s % 4 == 0, 360).otherwise(65).cast("long").alias("beam"),
    )


# Message texts of the signalling probe.
MESSAGES = [
    "CM_SERVICE_REQUEST", "SETUP", "CALL_PROCEEDING", "CONNECT", "DISCONNECT", "RELEASE", "RRC_CONNECTION_REQUEST",
    "RRC_CONNECTION_SETUP", "RRC_CONNECTION_SETUP_COMPLETE", "RRC_CONNECTION_RELEASE", "RAB_ASSIGNMENT_REQUEST",
    "RAB_ASSIGNMENT_COMPLETE", "RAB RELEASE", "RADIO LINK FAILURE", "IU RELEASE", "CM_SERVICE_REJECT", "CALL_REJECT",
    "HANDOVER FAILURE", "MeasurementReport", "A3/A5 Event", "Handover Complete", "RRCConnectionReconfigurationComplete",
    "Cell_Update", "Paging",
]
CAUSE_TEXTS = ["Normal", "Abnormal release", "N/A", "-", "RLF error"]

SQL["v_msgs"] = (
    "v_msgs AS (SELECT user_id % 5 AS log_id, ts_ms, event_id AS seq, user_id, ["
    + ", ".join(f"'{m}'" for m in MESSAGES)
    + f"][(event_id * 7 + k) % {len(MESSAGES)} + 1] AS message, ["
    + ", ".join(f"'{m}'" for m in CAUSE_TEXTS)
    + """][k % 5 + 1] AS cause, CASE k % 4 WHEN 0 THEN 'Call Id: ' || (k % 11) WHEN 1 THEN 'x IMSI=60400' || lpad(CAST(user_id AS VARCHAR), 6, '0')
        || CASE WHEN k % 3 = 0 THEN ' tmsi: A1B2C' || (k % 10) ELSE '' END WHEN 2 THEN 'TMSI=A1B2C' || (k % 10) ELSE 'none' END AS details, k FROM ev)"""
)
_NEEDS["v_msgs"] = ["ev"]


def v_msgs(v):
    e, k = F.col("event_id"), F.col("k")
    pick = lambda texts, i: F.element_at(F.array(*[F.lit(t) for t in texts]), (i + 1).cast("int"))
    details = (
        F.when(k % 4 == 0, F.concat(F.lit("Call Id: "), (k % 11).cast("string")))
        .when(k % 4 == 1, F.concat(
            F.lit("x IMSI=60400"), F.lpad(F.col("user_id").cast("string"), 6, "0"),
            F.when(k % 3 == 0, F.concat(F.lit(" tmsi: A1B2C"), (k % 10).cast("string"))).otherwise("")))
        .when(k % 4 == 2, F.concat(F.lit("TMSI=A1B2C"), (k % 10).cast("string"))).otherwise("none")
    )
    return ev(v).select(
        _mod("user_id", 5).alias("log_id"), "ts_ms", e.alias("seq"), "user_id",
        pick(MESSAGES, (e * 7 + k) % len(MESSAGES)).alias("message"), pick(CAUSE_TEXTS, k % 5).alias("cause"),
        details.alias("details"), "k",
    )


DEVICE_HEADERS = ["RRCSM", "SHO", "L3SM", "CAD", "CAF", "RRC"]
SQL["v_devents"] = (
    "v_devents AS (SELECT user_id % 10 AS device_id, ts_ms, event_id AS seq, ["
    + ", ".join(f"'{h}'" for h in DEVICE_HEADERS)
    + "][event_id % 6 + 1] AS header, ["
    + ", ".join(f"'{h}'" for h in DEVICE_HEADERS)
    + "][event_id % 6 + 1] || ',' || ["
    + ", ".join(f"'{m}'" for m in MESSAGES)
    + f"][(event_id * 7 + k) % {len(MESSAGES)} + 1] AS raw, user_id * 100 + day(ts) AS call_id FROM ev)"
)
_NEEDS["v_devents"] = ["ev"]


def v_devents(v):
    e, k = F.col("event_id"), F.col("k")
    pick = lambda texts, i: F.element_at(F.array(*[F.lit(t) for t in texts]), (i + 1).cast("int"))
    header = pick(DEVICE_HEADERS, e % 6)
    return ev(v).select(
        _mod("user_id", 10).alias("device_id"), "ts_ms", e.alias("seq"), header.alias("header"),
        F.concat(header, F.lit(","), pick(MESSAGES, (e * 7 + k) % len(MESSAGES))).alias("raw"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("call_id"),
    )
