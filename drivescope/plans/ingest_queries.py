"""Queries on log ingest: text lines are derived from the event table, then read like a log."""

from pyspark.sql import functions as F

from drivescope.operators.staging import staging_path
from drivescope.plans.registry import query
from drivescope.sources import nmf


def _tod(ts="ts"):
    return F.concat(F.date_format(ts, "HH:mm:ss"), F.lit("."), F.lpad((F.col("ts_ms") % 1000).cast("string"), 3, "0"))


def lines(v, body):
    """``log_id, line_no, raw``: one dated #START per log, then one line per event in time order (line_no = event id + 1)."""
    e = v.ev.withColumn("log_id", F.col("user_id") % 5).withColumn("tod", _tod())
    start = e.groupBy("log_id").agg(F.min("ts").alias("t")).select(
        "log_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("#START,00:00:00.000,,\""), F.date_format("t", "dd.MM.yyyy"), F.lit("\"")).alias("raw"))
    return start.unionByName(e.select("log_id", (F.col("event_id") + 1).alias("line_no"), body.alias("raw")))


def k():
    return F.col("k")


def s(c):
    return c.cast("string")


def csv(*cols):
    return F.concat_ws(",", *[c if not isinstance(c, str) else F.lit(c) for c in cols])


def radio_line():
    """MIMOMEAS of two blocks, TXPC, RLCBLER or a call row, by event number."""
    e = F.col("event_id")
    blk = lambda i: csv("50008", "3032", s((k() + i) % 512), s(F.lit(i)), "0", s(F.lit(-60.5) - (e + i) % 50), s(F.lit(-5.5) - k() % 15), s(F.lit(-70.0) - e % 20))
    mimo = csv("MIMOMEAS", F.col("tod"), "", "5", "0", "2", "8", blk(0), blk(1))
    tx = csv("TXPC", F.col("tod"), "", "5", s((e % 27).cast("double") - 3), "0")
    bler = csv("RLCBLER", F.col("tod"), "", "5", s((e % 100).cast("double")), "30", s((k() % 50).cast("double")), "2")
    caa = csv("CAA", F.col("tod"), "1", s(k()), "5", "1", "1", F.concat(F.lit('"06,'), s(k()), F.lit('"')), "")
    return F.when(e % 4 == 0, mimo).when(e % 4 == 1, tx).when(e % 4 == 2, bler).otherwise(caa)


def radio_records(v):
    return nmf.absolute_time(nmf.parse_records(lines(v, radio_line())))


@query("S1_parse_records", "ev", """
, e AS (SELECT event_id + 1 AS line_no, user_id % 5 AS log_id, event_id, k FROM ev)
SELECT log_id, line_no, CASE event_id % 4 WHEN 0 THEN 'MIMOMEAS' WHEN 1 THEN 'TXPC' WHEN 2 THEN 'RLCBLER' ELSE 'CAA' END AS header, CASE event_id % 4 WHEN 0 THEN 23::BIGINT WHEN 1 THEN 6::BIGINT WHEN 2 THEN 8::BIGINT ELSE 9::BIGINT END AS fields,
 CASE WHEN event_id % 4 = 3 THEN '06,' || k END AS dialed FROM e
""")
def _(v):
    d = nmf.parse_records(lines(v, radio_line())).where("header <> '#START'")
    return d.select("log_id", "line_no", "header", F.size("parts").cast("long").alias("fields"), F.when(F.col("header") == "CAA", nmf.part(7)).alias("dialed"))


@query("S1_read_nmf", "ev", """
, e AS (SELECT user_id % 5 AS log_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) + 1 AS line_no, CASE event_id % 4 WHEN 0 THEN 'MIMOMEAS' WHEN 1 THEN 'TXPC' WHEN 2 THEN 'RLCBLER' ELSE 'CAA' END AS header, ts_ms FROM ev)
SELECT log_id, line_no, header, ts_ms % 86400000 AS tod_ms FROM e
""")
def _(v):
    path = staging_path(v.spark, "logs")
    rows = lines(v, radio_line()).repartition("log_id").sortWithinPartitions("log_id", "line_no")
    rows.select("log_id", F.col("raw").alias("value")).write.partitionBy("log_id").text(path)  # a file for each log
    d = nmf.absolute_time(nmf.read_nmf(v.spark, path))
    return d.select(F.regexp_extract("log_id", r"log_id=(\d+)", 1).cast("long").alias("log_id"), "line_no", "header", "tod_ms")


@query("S2_absolute_time", "ev", """
, b AS (SELECT user_id % 5 AS log_id, event_id, ts_ms, ts_ms % 86400000 AS tod FROM ev), f AS (SELECT log_id, min(ts_ms) // 86400000 * 86400000 AS base FROM b GROUP BY log_id)
, l AS (SELECT *, lag(tod) OVER (PARTITION BY log_id ORDER BY event_id) AS p FROM b), d AS (SELECT *, sum(CASE WHEN tod < p - 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY event_id) AS off FROM l)
SELECT d.log_id, event_id + 1 AS line_no, CAST(base + off * 86400000 + tod AS BIGINT) AS ts_ms FROM d JOIN f ON f.log_id = d.log_id
""")
def _(v):
    return radio_records(v).select("log_id", "line_no", "ts_ms")


@query("S3_explode_radio", "ev", """
, e AS (SELECT event_id + 1 AS line_no, event_id AS e, k, unnest([0, 1]) AS i FROM ev WHERE event_id % 4 = 0)
SELECT line_no, 'mimo' AS kind, i::BIGINT AS branch_no, CAST((k + i) % 512 AS DOUBLE) AS a, CAST(-60.5 - (e + i) % 50 AS DOUBLE) AS b, CAST(-5.5 - k % 15 AS DOUBLE) AS c FROM e
UNION ALL SELECT event_id + 1, 'tx', NULL, CAST(event_id % 27 - 3 AS DOUBLE), NULL, NULL FROM ev WHERE event_id % 4 = 1
UNION ALL SELECT event_id + 1, 'bler', NULL, CAST(greatest(event_id % 100, k % 50) AS DOUBLE), CAST((event_id % 100 + k % 50) / 2.0 AS DOUBLE), NULL FROM ev WHERE event_id % 4 = 2
""")
def _(v):
    r = nmf.parse_records(lines(v, radio_line()))
    none = F.lit(None)
    m = nmf.mimo_samples(r).select("line_no", F.lit("mimo").alias("kind"), F.col("branch_no").cast("long").alias("branch_no"), F.col("psc").alias("a"), F.col("rscp").alias("b"), F.col("ecno").alias("c"))
    t = nmf.tx_power(r).select("line_no", F.lit("tx").alias("kind"), none.cast("long").alias("branch_no"), F.col("tx").alias("a"), none.cast("double").alias("b"), none.cast("double").alias("c"))
    b = nmf.rlc_bler(r).select("line_no", F.lit("bler").alias("kind"), none.cast("long").alias("branch_no"), F.col("bler_max").alias("a"), F.col("bler_mean").alias("b"), none.cast("double").alias("c"))
    return m.unionByName(t).unionByName(b)


def cell_line():
    """UMTS (three tuples) and LTE (two blocks) cell measurements."""
    e = F.col("event_id")
    tup = lambda i, st: csv(s(F.lit(st)), "60401", "3032", s((k() + i * 40) % 500), s(F.lit(-70.0) - (e * (i + 1)) % 40), s(F.lit(-60.0)), s(F.lit(-6.0) - (k() + i) % 15))
    umts = csv("CELLMEAS", F.col("tod"), "", "5", "0", s(F.lit(1) + k() % 3), s(k() % 2), "3032", "-65.0", "60401", "3032", s(k() % 500), "-6.5", tup(0, 0), tup(1, 1), tup(2, 2))
    blk = lambda i: csv("0", "3", s(F.lit(1320) + i * 1730), s((k() + i) % 504), "-50.0", s(F.lit(-80.0) - (e * (i + 3)) % 50), s(F.lit(-5.0) - (e % 10)), "777", "1", "0", s((e % 25).cast("double")))
    lte = csv("CELLMEAS", F.col("tod"), "", "7", "0", "1", "1", blk(0), blk(1))
    return F.when(e % 2 == 0, umts).otherwise(lte)


CELLS = """
, e AS (SELECT event_id + 1 AS line_no, event_id AS e, k FROM ev), u AS (SELECT *, unnest([0, 1, 2]) AS i FROM e WHERE e % 2 = 0), ub AS (SELECT line_no, e, k, i, i AS st, (k + i * 40) % 500 AS sc, -70.0 - (e * (i + 1)) % 40 AS rscp, -6.0 - (k + i) % 15 AS ecno, 1 + k % 3 AS a, k % 2 AS m FROM u)
"""


@query("S4_explode_cellmeas", "ev", CELLS + """
SELECT line_no, 'UMTS' AS tech, i::BIGINT AS pos, sc AS cell, CAST(rscp AS DOUBLE) AS level, CAST(ecno AS DOUBLE) AS quality, i = 0 AS is_serving FROM ub UNION ALL
SELECT line_no, 'LTE', i, (k + i) % 504, CAST(-80.0 - (e * (i + 3)) % 50 AS DOUBLE), CAST(-5.0 - e % 10 AS DOUBLE), i = 0 FROM (SELECT *, unnest([0, 1]) AS i FROM e WHERE e % 2 = 1)
""")
def _(v):
    r = nmf.parse_records(lines(v, cell_line()))
    u = nmf.umts_cellmeas(r).select("line_no", F.posexplode("neighbors").alias("pos", "n")).select(
        "line_no", F.lit("UMTS").alias("tech"), F.col("pos").cast("long").alias("pos"), F.col("n.sc").alias("cell"), F.col("n.rscp").alias("level"), F.col("n.ecno").alias("quality"), "n.is_serving")
    t = nmf.lte_cellmeas(r).select("line_no", F.posexplode("neighbors").alias("pos", "n")).select(
        "line_no", F.lit("LTE").alias("tech"), F.col("pos").cast("long").alias("pos"), F.col("n.pci").alias("cell"), F.col("n.rsrp").alias("level"), F.col("n.rsrq").alias("quality"), "n.is_serving")
    return u.unionByName(t)


@query("S4_cellmeas_dominance", "ev", CELLS + """
, r AS (SELECT line_no, rscp, row_number() OVER (PARTITION BY line_no ORDER BY rscp DESC) AS rn FROM ub)
SELECT line_no, CAST(max(rscp) FILTER (WHERE rn = 1) - max(rscp) FILTER (WHERE rn = 2) AS DOUBLE) AS gap, count(*) AS subtype_a, 0::BIGINT AS subtype_b FROM r GROUP BY line_no
""")
def _(v):
    return nmf.cellmeas_dominance(nmf.parse_records(lines(v, cell_line()))).select("line_no", "gap", "subtype_a", "subtype_b")


@query("S5_label_neighbors", "ev", CELLS + """
SELECT line_no, sc, CASE WHEN st = 2 THEN 'D1' WHEN a <= 1 THEN 'M1' ELSE 'A2' END AS label FROM ub WHERE st > 0
""")
def _(v):
    d = nmf.label_neighbors(nmf.umts_cellmeas(nmf.parse_records(lines(v, cell_line()))))
    return d.select("line_no", F.explode("neighbors").alias("n")).select("line_no", "n.sc", "n.label")


@query("S5_flatten_neighbors", "ev", CELLS + """
SELECT line_no, max(sc) FILTER (WHERE st = 1 AND a > 1) AS a2_sc, CAST(max(rscp) FILTER (WHERE st = 1 AND a <= 1) AS DOUBLE) AS m1_rscp, CAST(max(ecno) FILTER (WHERE st = 2) AS DOUBLE) AS d1_ecno FROM ub GROUP BY line_no
""")
def _(v):
    d = nmf.flatten_neighbors(nmf.label_neighbors(nmf.umts_cellmeas(nmf.parse_records(lines(v, cell_line())))), slots=2)
    return d.select("line_no", "a2_sc", "m1_rscp", "d1_ecno")


SIGNALS = ["RADIO_BEARER_SETUP", "RRC_CONNECTION_RELEASE", "ACTIVE_SET_UPDATE_COMPLETE", "MEASUREMENT_REPORT", "RLF_INDICATION", "T310_EXPIRY", "SYSTEM_INFORMATION", "OUT_OF_SYNC"]


def signal_line():
    """RRCSM, L3SM, HOA, RRD, RRA and CAF rows by event number."""
    e = F.col("event_id")
    msg = F.element_at(F.array(*[F.lit(m) for m in SIGNALS]), (k() % 8 + 1).cast("int"))
    rrc = csv("RRCSM", F.col("tod"), "", "5", s(F.lit(1) + e % 2), msg, "DCCH", "10663", s(k() % 512), "0A0B0C0D0E0F00112233")
    l3 = csv("L3SM", F.col("tod"), "", "5", "1", F.when(k() % 2 == 0, "DISCONNECT").otherwise("SETUP"), "CC")
    hoa = csv("HOA", F.col("tod"), "", "7", "", "", "", "", "1320", s(k()), "", "", "", F.when(k() % 2 == 0, "1320").otherwise("3050"), s(k() + 1))
    rrd = csv("RRD", F.col("tod"), "", "5", "", "", s(k() % 6))
    rra = csv("RRA", F.col("tod"), "", "5", "", s(k() % 17))
    caf = csv("CAF", F.col("tod"), "1", "7", "5", "1", s(k() % 3))
    return F.when(e % 6 == 0, rrc).when(e % 6 == 1, l3).when(e % 6 == 2, hoa).when(e % 6 == 3, rrd).when(e % 6 == 4, rra).otherwise(caf)


@query("S6_extract_events", "ev", """
, e AS (SELECT event_id + 1 AS line_no, event_id AS e, k FROM ev)
SELECT line_no, CASE k % 8 WHEN 0 THEN 'HO Command' WHEN 1 THEN 'RRC Release' WHEN 4 THEN 'RLF indication' WHEN 5 THEN 'T310' WHEN 7 THEN 'DL sync loss (Interference / coverage)' ELSE 'HO Completion' END AS event FROM e
 WHERE e % 6 = 0 AND (k % 8 IN (1, 4, 5, 7) OR (k % 8 = 0 AND e % 2 = 1) OR (k % 8 = 2 AND e % 2 = 0))
UNION ALL SELECT line_no, 'CS Release' FROM e WHERE e % 6 = 1 AND k % 2 = 0 UNION ALL SELECT line_no, 'A3/A5 Event' FROM e WHERE e % 6 = 2
UNION ALL SELECT line_no, CASE k % 6 WHEN 1 THEN 'Call Drop' ELSE 'RLF indication' END FROM e WHERE e % 6 = 3 AND k % 6 IN (1, 5)
UNION ALL SELECT line_no, CASE WHEN k % 17 IN (16, 2) THEN 'RLF indication' WHEN k % 17 = 12 THEN 'DL sync loss (Interference / coverage)' ELSE 'UL sync loss (UE can’t reach NodeB)' END FROM e WHERE e % 6 = 4 AND k % 17 IN (16, 2, 12, 4)
UNION ALL SELECT line_no, 'RLF indication' FROM e WHERE e % 6 = 5 AND k % 3 = 2
""")
def _(v):
    return nmf.extract_events(nmf.parse_records(lines(v, signal_line()))).select("line_no", "event")


@query("S7_signalling_rows", "ev", f"""
, e AS (SELECT event_id + 1 AS line_no, event_id AS e, k FROM ev WHERE event_id % 6 < 2)
SELECT line_no, CASE WHEN e % 6 = 0 THEN {SIGNALS}[k % 8 + 1] WHEN k % 2 = 0 THEN 'DISCONNECT' ELSE 'SETUP' END AS message, CASE WHEN e % 6 = 1 OR e % 2 = 0 THEN 'UL' ELSE 'DL' END AS direction, CASE WHEN e % 6 = 0 THEN 'DCCH' ELSE 'CC' END AS channel,
 CASE WHEN e % 6 = 0 THEN 10663.0::DOUBLE END AS freq, CASE WHEN e % 6 = 0 THEN k % 512 END AS sc, CASE WHEN e % 6 = 0 THEN '0A0B0C0D0E0F00112233' END AS payload_hex FROM e
""")
def _(v):
    return nmf.signalling_rows(nmf.parse_records(lines(v, signal_line()))).select("line_no", "message", "direction", "channel", "freq", "sc", "payload_hex")


def identity_line():
    e = F.col("event_id")
    chi3 = csv("CHI", F.col("tod"), "", "5", "0", "0", s(F.lit(29000000) + k()), s(F.lit(8000) + k()), s(k() % 512), "0", "3.0", "100", "5.0", F.when(k() % 2 == 0, "1280").otherwise("77"), "0.5", "100")
    chi4 = csv("CHI", F.col("tod"), "", "7", "0", "0", "0", "0", "0", s(F.lit(51328000) + k()), s(F.lit(8362) + k()))
    edchi = csv("EDCHI", F.col("tod"), "", "5", "0", "0", "0", "0", "0", "0", "10663", s(k()))
    crel = csv("CREL", F.col("tod"), "", "", "", "", "", "", "", "", "5", "", s(F.lit(440) + k() % 7), s(F.lit(29000000) + k()))
    rrd = csv("RRD", F.col("tod"), "", "5", "", "", s(k() % 6))
    return F.when(e % 5 == 0, chi3).when(e % 5 == 1, chi4).when(e % 5 == 2, edchi).when(e % 5 == 3, crel).otherwise(rrd)


@query("S8_identity_track", "ev", """
, e AS (SELECT event_id + 1 AS line_no, event_id AS e, k FROM ev)
SELECT line_no, 'UMTS' AS rat, 29000000 + k AS cid, (29000000 + k) >> 16 AS rnc, 8000 + k AS lac, CASE WHEN k % 512 > 0 THEN k % 512 ELSE 100 END AS psc, 'CHI' AS source, NULL AS event FROM e WHERE e % 5 = 0
UNION ALL SELECT line_no, 'LTE', 51328000 + k, NULL, 8362 + k, NULL, 'CHI', NULL FROM e WHERE e % 5 = 1 UNION ALL SELECT line_no, NULL, NULL, NULL, NULL, k, 'EDCHI', NULL FROM e WHERE e % 5 = 2
UNION ALL SELECT line_no, 'UMTS', 29000000 + k, 440 + k % 7, NULL, NULL, 'CREL', NULL FROM e WHERE e % 5 = 3 UNION ALL SELECT line_no, NULL, NULL, NULL, NULL, NULL, 'RRD_EVENT', CASE k % 6 WHEN 1 THEN 'Call Drop' ELSE 'Call Fail' END FROM e WHERE e % 5 = 4 AND k % 6 IN (1, 5)
""".replace("CASE WHEN k % 512 > 0 THEN k % 512 ELSE 100 END", "CASE WHEN k % 512 > 0 THEN k % 512 END"))
def _(v):
    return nmf.identity_track(nmf.parse_records(lines(v, identity_line()))).select("line_no", "rat", "cid", "rnc", "lac", "psc", "source", "event")


@query("S18_event_1a_history", "ev", """
SELECT event_id + 1 AS line_no, 10::BIGINT AS position, 3.0::DOUBLE AS hysteresis, 100.0::DOUBLE AS threshold_rscp, 5.0::DOUBLE AS range, 1280::BIGINT AS time_to_trigger, 0.5::DOUBLE AS filter_coef, 100.0::DOUBLE AS threshold_ecno FROM ev
WHERE event_id % 5 = 0 AND k % 2 = 0
""")
def _(v):
    return nmf.event_1a_history(nmf.parse_records(lines(v, identity_line()))).drop("log_id")


CONTAINERS = """
, e AS (SELECT user_id % 5 AS log_id, event_id, k, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id % 5) AS n FROM ev)
SELECT log_id, CASE WHEN log_id = 3 THEN '#PRO' ELSE 'NMFS' END AS signature, CASE WHEN log_id = 3 THEN 'text_fallback' ELSE 'metadata_plus_plaintext' END AS decode_mode, CASE WHEN log_id = 3 THEN 0 ELSE 2 + count(*) FILTER (WHERE k % 10 = 0) END AS metadata_count,
 CASE WHEN log_id = 3 THEN 0 ELSE count(*) FILTER (WHERE k % 10 <> 0 AND k % 3 <> 0) END AS record_count, log_id <> 3 AS has_start, false AS has_stop FROM e GROUP BY log_id
"""


@query("S13_container_metadata", "ev", CONTAINERS)
def _(v):
    body = F.when(k() % 10 == 0, F.concat(F.lit("#NOTE,"), s(k()))).when(k() % 3 == 0, "plain words").otherwise(csv("GPS", F.col("tod"), "", s(k())))
    d = lines(v, body).withColumn("raw", F.when(F.col("line_no") == 0, "#START,00:00:00.000,,\"16.12.2025\"").otherwise(F.col("raw")))
    head = d.select("log_id").distinct().select("log_id", F.lit(-1).cast("long").alias("line_no"), F.when(F.col("log_id") == 3, "#PRODUCT,x").otherwise("NMFS\u0001#PRODUCT,x").alias("raw"))
    d = head.unionByName(d).withColumn("line_no", F.col("line_no") + 2)
    return nmf.container_metadata(d).drop("tags")


@query("S13_read_containers", "ev", CONTAINERS)
def _(v):
    """The containers written as files whose payload holds NUL and lone CR bytes, then read back as binary files."""
    words = F.lit("plain\u0000\r#words\rGPS,a,b")
    body = F.when(k() % 10 == 0, F.concat(F.lit("#NOTE,"), s(k()), F.lit("\r"))).when(k() % 3 == 0, words).otherwise(csv("GPS", F.col("tod"), "", F.lit("\u0000\u0002"), s(k())))
    d = lines(v, body).withColumn("raw", F.when(F.col("line_no") == 0, "#START,00:00:00.000,,\"16.12.2025\"").otherwise(F.col("raw")))
    head = d.select("log_id").distinct().select("log_id", F.lit(-1).cast("long").alias("line_no"), F.when(F.col("log_id") == 3, "#PRODUCT,x").otherwise("NMFS\u0001#PRODUCT,x").alias("raw"))
    path = staging_path(v.spark, "containers")
    rows = head.unionByName(d).repartition("log_id").sortWithinPartitions("log_id", "line_no")
    rows.select("log_id", F.col("raw").alias("value")).write.partitionBy("log_id").text(path)  # a file for each log
    found = nmf.container_metadata(nmf.read_containers(v.spark, path)).drop("tags")
    return found.withColumn("log_id", F.regexp_extract("log_id", r"log_id=(\d+)", 1).cast("long"))


@query("S9_sticky_states", "ev", """
, r AS (SELECT user_id % 5 AS log_id, event_id AS line_no, ts_ms, k % 5 AS t, k, event_id AS e FROM ev WHERE k % 5 < 4)
, x AS (SELECT *, CASE WHEN t = 0 THEN CAST((e % 27 - 3) || '.5' AS DOUBLE) END AS tx, CASE WHEN t = 0 THEN k % 3 END AS tpc, CASE WHEN t = 1 THEN e % 40 + 0.25::DOUBLE END AS nb,
   CASE WHEN t = 2 AND e % 2500 <= 2000 THEN CAST(e % 2500 AS DOUBLE) END AS ta,
   CASE WHEN t = 3 AND k % 2 = 0 THEN CAST(CASE WHEN e % 20 BETWEEN 1 AND 15 THEN e % 20 WHEN e % 17 BETWEEN 1 AND 15 THEN e % 17 END AS DOUBLE) END AS cqi FROM r)
SELECT log_id, line_no, last_value(tx IGNORE NULLS) OVER w AS tx, last_value(tpc IGNORE NULLS) OVER w AS tpc, last_value(nb IGNORE NULLS) OVER w AS node_b_tx, last_value(ta IGNORE NULLS) OVER w AS timing_advance,
 last_value(cqi IGNORE NULLS) OVER w AS cqi_dl FROM x WINDOW w AS (PARTITION BY log_id ORDER BY ts_ms, line_no ROWS UNBOUNDED PRECEDING)
""")
def _(v):
    e, t = F.col("event_id").cast("string"), F.col("k") % 5
    raw = (
        F.when(t == 0, F.format_string("TXPC,,,5,%d.5,%d", F.col("event_id") % 27 - 3, F.col("k") % 3)).when(t == 1, F.format_string("RXPC,,,5,,%d.25", F.col("event_id") % 40))
        .when(t == 2, F.format_string("TAD,,,7,%d", F.col("event_id") % 2500))
        .when(t == 3, F.format_string("CQI,,,%d,,,,%d,%d", F.when(F.col("k") % 2 == 0, 7).otherwise(5), F.col("event_id") % 20, F.col("event_id") % 17)).otherwise(F.concat(F.lit("OTHER,"), e))
    )
    d = v.ev.select((F.col("user_id") % 5).alias("log_id"), F.col("event_id").alias("line_no"), "ts_ms", F.split(raw, ",").alias("parts"))
    return nmf.sticky_states(d.withColumn("header", F.col("parts")[0])).select("log_id", "line_no", *nmf.STICKY)
