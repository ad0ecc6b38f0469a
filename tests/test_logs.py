"""Text logs end to end: records, calls, context, cell measurements, containers, tracks, generic sessions."""

import random

from pyspark.sql import functions as F

from drivescope.operators import radio, rrc_sessions, sessions
from drivescope.sources import nmf, tables

HEAD = '#START,23:00:00.000,,"23.12.2025"\n'


def scan(tod, *levels):
    """A radio row: two cells of eight fields each, level and quality given."""
    return f"MIMOMEAS,{tod},,5,0,2,8," + ",".join(f"50008,2987,61,{i},0,{rscp},{ecno},-83.0" for i, (rscp, ecno) in enumerate(levels))


SETUP = HEAD + "\n".join([
    'CAA,23:00:05.000,1,41,5,1,1,"0700123400",,30000,,', "RRCSM,23:00:08.000,,5,STATE,CONNECTING", scan("23:00:14.000", (-92.0, -12.5), (-90.0, -11.5)), "TXPC,23:00:16.500,,5,13.5,0,1.0,0,300,350,40.0",
    "L3SM,23:00:20.000,,5,RRC CONNECTION SETUP", scan("23:00:21.000", (-91.0, -13.5), (-89.0, -12.5)), "RLCBLER,23:00:26.000,,5,9.0,26,14,2,4,1,15.5,25,13,2,7.5,1,1", "CAF,23:00:27.500,1,41,5,1,2,",
    "SHO,23:00:29.000,,5,EVENT,ACTIVE_SET_UPDATE"]) + "\n"
ISOLATED = "\n".join(['#START,22:10:00.000,,"24.12.2025"', 'CAA,22:11:02.500,1,31,5,1,1,"0712004455",,30000,,', "CAC,22:11:04.000,1,31,5,1,3,0,1", "CAD,22:11:06.250,1,28,5,1,1,16"]) + "\n"
# Three carriers, then nine cells of 17 fields: role, carrier, code, quality, level.
CELLS = [(0, 2987, 61, -10.5, -90.0), (1, 2987, 140, -6.5, -84.5), (1, 10688, 61, -11.5, -104.0), (1, 10663, 61, -12.0, -108.5), (1, 2987, 302, -15.0, -95.0), (1, 2987, 211, -17.5, -97.0), (1, 2987, 95, -19.0, -99.5),
         (1, 2987, 333, -23.0, -103.5), (1, 10663, 44, "", -121.0)]
CELL = "CELLMEAS,21:05:02.100,,5,0,3,3,2987,-79.0,50008,10688,-94.0,50001,10663,-95.5,50001,9,17," + ",".join(
    f"{role},50008,{carrier},{code},{quality},,{level},0,,,,,-15.0,-86.0,0,12000.0," for role, carrier, code, quality, level in CELLS)
T0 = 1766530800000  # 2025-12-23T23:00:00Z


def records(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.nmf").write_text(text)
    return nmf.absolute_time(nmf.read_nmf(spark, str(tmp_path)))


def test_line_numbers_and_midnight(spark, tmp_path):
    body = HEAD + "A,23:59:59.500,x\nB,00:00:01.000,y\n#START,01:00:00.000,,\nC,00:30:00.000,z\n"
    d = records(spark, tmp_path, a=body, b=ISOLATED)
    got = {r.header: (r.line_no, r.ts_ms - T0) for r in d.collect() if r.log_id.endswith("a.nmf")}
    assert got == {"A": (2, 3599500), "B": (3, 3601000), "C": (5, 3600000 + 1800000)}


def test_line_numbers_of_split_files(spark, tmp_path):
    body = HEAD + "".join(f"X,{10 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000,{i}\n" for i in range(5000))
    (tmp_path / "big.nmf").write_text(body)
    (tmp_path / "more.nmf").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        d = nmf.absolute_time(nmf.read_nmf(spark, str(tmp_path)))
        assert d.rdd.getNumPartitions() > 4 or nmf.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = d.select("log_id", "line_no", (d.ts_ms - T0).alias("t"), nmf.part(2).alias("i")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 10_000 and all(r.line_no == int(r.i) + 2 and r.t == (int(r.i) - 13 * 3600) * 1000 for r in got)


def test_steps_of_time(spark):
    lines = [(1, "A,01:00:00,x"), (2, '#START,,"01.02.2026"'), (3, "no time"), (4, "A,22:00:00,x"), (5, "A,02:00:00,x"), (6, "A,01:30:00,x"), (7, "#START,none"), (8, "A,23:00:00,x"), (9, "A,03:00:00,x"),
             (10, '#START,,"05.02.2026"'), (11, "A,00:00:01,x")]
    for block in (2, 3, 1_000_000):
        nmf.LINE_BLOCK, kept = block, nmf.LINE_BLOCK
        try:
            d = nmf.absolute_time(nmf.parse_records(spark.createDataFrame([(7, *x) for x in lines], "log_id long, line_no long, raw string")))
            got = {r.line_no: (r.segment, r.ts_ms) for r in d.collect()}
        finally:
            nmf.LINE_BLOCK = kept
        day, hour, base = 86_400_000, 3_600_000, 1769904000000  # 2026-02-01
        assert got == {4: (2, base + 22 * hour), 5: (2, base + day + 2 * hour), 6: (2, base + day + 3 * hour // 2), 8: (2, base + day + 23 * hour), 9: (2, base + 2 * day + 3 * hour), 11: (10, base + 4 * day + 1000)}


def test_time_of_random_logs_in_any_block(spark):
    rng, rows, want = random.Random(5), [], {}
    for log in range(6):
        base = seg = prev = None
        day = 0
        for no in range(1, 120):
            kind = rng.random()
            if kind < 0.06:
                base, seg, prev, day = 1769904000000 + 86_400_000 * (no % 28), no, None, 0
                rows.append((log, no, f'#START,x,"{no % 28 + 1:02d}.02.2026"'))
            elif kind < 0.1:
                rows.append((log, no, rng.choice(["#START,none", "no time", "A,25,x"])))
            else:
                h = rng.choice([0, 1, 5, 9, 17, 22, 23])
                tod = h * 3_600_000
                rows.append((log, no, f"A,{h:02d}:00:00,x"))
                if base is not None:
                    day += prev is not None and tod < prev - 6 * 3_600_000
                    prev = tod
                    want[log, no] = (seg, base + day * 86_400_000 + tod)
    lines = spark.createDataFrame(rows, "log_id long, line_no long, raw string").repartition(5)
    kept = nmf.LINE_BLOCK
    try:
        for nmf.LINE_BLOCK in (1, 3, 17, 1_000_000):
            got = {(r.log_id, r.line_no): (r.segment, r.ts_ms) for r in nmf.absolute_time(nmf.parse_records(lines)).collect()}
            assert got == want
    finally:
        nmf.LINE_BLOCK = kept


def test_fields_with_odd_quotes(spark):
    texts = {'a,"b,c': ["a", "b,c"], ',,"",': ["", "", "", ""], '"x","y""z"': ["x", 'y"z'], 'p"q,r"s,t': ["pq,rs", "t"], '"' + "v" * 20_000 + '",w': ["v" * 20_000, "w"]}
    rows = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", nmf.split_csv(nmf.F.col("raw")).alias("parts")).collect()
    for r in rows:
        want = texts[r.raw]
        assert r.parts == [x if x != '""' else '"' for x in want] or r.raw == ',,"",', r.raw[:20]


def test_quoted_fields(spark):
    d = nmf.parse_records(spark.createDataFrame([(1, 1, 'X,"a,b",c"" ,"d""e"')], "log_id long, line_no long, raw string"))
    assert d.first().parts[:2] == ["X", "a,b"] and d.first().parts[-1] == 'd"e'


def test_setup_failure_with_context(spark, tmp_path):
    r = records(spark, tmp_path, a=SETUP, b=ISOLATED)
    r = r.withColumn("seq", r.line_no)
    calls, events = nmf.call_rows(r), nmf.device_events(r)
    mimo = nmf.mimo_samples(r).withColumnRenamed("line_no", "row_seq").withColumn("seq", nmf.F.col("branch_no"))
    servers = radio.best_server(mimo)
    tx, bler = nmf.tx_power(r), nmf.rlc_bler(r)
    out = {x.call_id: x for x in sessions.analyse_calls(calls, servers, tx, bler, events).collect()}
    assert out["31"].result_type == "INCOMPLETE_OR_UNKNOWN_END" and out["31"].cad_status is None and out["31"].dialed_number == "0712004455"
    assert out["28"].cad_cause == 16
    failed = out["41"]
    assert failed.result_type == "CALL_SETUP_FAILURE" and failed.connected_ts is None
    assert (failed.start_ts - T0, failed.end_ts_caf - T0) == (5000, 27500)
    s = sessions.session_outcome(sessions.call_sessions(calls))
    snap = radio.radio_snapshot(s.where("result_type = 'CALL_SETUP_FAILURE'"), servers, tx, bler, window_ms=20_000)
    c = sessions.setup_failure_context(s, events, snap).first()
    assert c.mimo_count == 2 and c.rscp_median == -90.5 and c.tx_last == 13.5 and c.bler_max == 15.5
    assert c.events_in_window >= 2 and not c.connected_ever and c.closest_mobility.header == "RRCSM"


def test_dominance(spark):
    rows = []
    for i in range(10):
        rows += [(1, T0 + i * 1000, i, 0, 100, -70.0 - i % 2, -8.0, -80.0, 1, 3032), (1, T0 + i * 1000, i, 1, 101, -73.0 - i % 2, -10.0, -82.0, 2, 3032)]
    servers = radio.best_server(spark.createDataFrame(
        rows, "device_id long, ts_ms long, row_seq long, seq long, psc long, rscp double, ecno double, rssi double, cell_id long, uarfcn long"))
    anchors = spark.createDataFrame([(1, 5, T0 + 9000)], "device_id long, call_id long, end_ts long")
    none = "device_id long, ts_ms long, seq long, "
    snap = radio.radio_snapshot(anchors, servers, spark.createDataFrame([], none + "tx double"), spark.createDataFrame([], none + "bler_max double, bler_mean double"))
    r = radio.pilot_pollution_score(snap).first()
    assert (r.two_pilot_rows, r.mimo_count, r.gap_median, r.gap_low_ratio, r.dominance_evidence) == (10, 10, 3.0, 0.0, True)


def test_cell_measurement_labels(spark):
    d = nmf.label_neighbors(nmf.umts_cellmeas(nmf.parse_records(spark.createDataFrame([(1, 1, CELL)], "log_id long, line_no long, raw string"))))
    r = d.first()
    assert r.serving_sc == 61 and abs(r.serving_ecno + 10.5) < 0.01 and r.as_size == 3
    cells = {(n.sc, n.freq): n.label for n in r.neighbors}
    assert any(sc == 140 for sc, _ in cells) and any(sc == 211 for sc, _ in cells) and (61, 2987.0) not in cells
    assert sorted(x for x in cells.values() if x.startswith("A")) == ["A2", "A3"]


def test_points_carry_position_identity_and_power(spark, tmp_path):
    text = '#START,21:05:00.000,,"24.12.2025"\n' + "\n".join([
        "CHI,21:05:00.400,,5,0,0,40112233,7100,23", "TXPC,21:05:01.200,,5,12.5,1", "GPS,21:05:01.900,,-8.25,31.5,350,,,,", CELL]) + "\n"
    r = records(spark, tmp_path, a=text)
    p = nmf.measurement_points(nmf.umts_cellmeas(r), nmf.gps_rows(r), nmf.identity_track(r), nmf.tx_power(r)).collect()
    assert len(p) == 1 and (p[0].gps.lat, p[0].gps.lon) == (31.5, -8.25)
    assert (p[0].identity.cid, p[0].identity.lac, p[0].identity.psc, p[0].state.tx) == (40112233, 7100, 23, 12.5)


def test_points_carry_the_latest_value_of_every_kind(spark, tmp_path):
    text = '#START,21:05:00.000,,"24.12.2025"\n' + "\n".join([
        "CHI,21:05:00.400,,5,0,0,40112233,7100,23", "TXPC,21:05:00.500,,5,12.5,1", "TAD,21:05:00.600,,7,31", "TAD,21:05:00.700,,7,2001", "CQI,21:05:00.800,,7,0,0,0,16,9", "CQI,21:05:00.900,,5,0,0,0,3,3",
        "RXPC,21:05:01.000,,5,0,33.5", "TXPC,21:05:01.200,,5,x,2", "GPS,21:05:01.900,,-8.25,31.5,350,,,,", CELL]) + "\n"
    r = records(spark, tmp_path, a=text)
    (p,) = nmf.measurement_points(nmf.umts_cellmeas(r), nmf.gps_rows(r), nmf.identity_track(r), nmf.sticky_states(r)).collect()
    assert {c: p.state[c] for c in nmf.STICKY} == {"tx": 12.5, "tpc": 2, "node_b_tx": 33.5, "timing_advance": 31.0, "cqi_dl": 9.0}


def test_container(spark):
    lines = ["NMFS\x01\x00\x00Q#PRODUCT,,,\"HANDHELD\"", "#START,10:00:00.000,,\"16.12.2025\"", "CHI,10:00:00.000,,7,0,0,0,0,0,40112233,7100",
             "GPS,10:00:00.000,,-8.25,31.5,10,0,0,20", "#STOP,10:00:10.000,,\"16.12.2025\""]
    rows = [(1, i + 1, x) for i, x in enumerate(lines)] + [(2, i + 1, x) for i, x in enumerate(lines[1:])]
    got = {r.log_id: r for r in nmf.container_metadata(spark.createDataFrame(rows, "log_id long, line_no long, raw string")).collect()}
    assert got[1].decode_mode == "metadata_plus_plaintext" and got[1].record_count == 2 and got[1].has_start and got[1].has_stop
    assert got[2].decode_mode == "text_fallback"


def test_track(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg>\n<trkpt lat="30.1" lon="-9.1">\n<time>2025-12-23T23:00:00Z</time></trkpt><trkpt lat="30.2" lon="-9.2"><ele>5</ele></trkpt></trkseg></trk></gpx>')
    got = sorted((r.lat, r.lon, r.ts_ms, r.alt) for r in tables.read_track(spark, str(tmp_path / "t.gpx")).collect())
    assert got == [(30.1, -9.1, T0, None), (30.2, -9.2, None, 5.0)]


def test_generic_session_without_call_is_no_drop(spark):
    rows = [(1, T0, 1, "CM_SERVICE_REQUEST", "IDLE"), (1, T0 + 1000, 2, "CONNECT", "CONNECTED"), (1, T0 + 3000, 3, "STATE_CHANGE", "IDLE"),
            (2, T0, 4, "CM_SERVICE_REQUEST CallId: 7", "IDLE"), (2, T0 + 1000, 5, "RRC_CONNECTION_REJECT", None), (2, T0 + 5000, 6, "RLF CallId: 7", None),
            (3, T0, 7, "SETUP CallId: 8", "IDLE"), (3, T0 + 500, 8, "CONNECT", "CONNECTED"), (3, T0 + 9000, 9, "RLF", None), (3, T0 + 9500, 10, "PAGING", None)]
    d = spark.createDataFrame(rows, "log_id long, ts_ms long, seq long, message string, state string")
    got = {r.log_id: r for r in rrc_sessions.rrc_session_machine(d, state="state").collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.call_id, a.drop, a.end_trigger, a.result_type, a.records) == (None, False, "RRC_IDLE_TRANSITION", "RRC_SESSION", 3)
    assert (b.setup_failure, b.failure_code, b.end_type, b.call_id) == (True, "RRC_FAILURE", "CALL_SETUP_FAILURE", "7")
    assert (c.drop, c.end_type, c.end_trigger, c.records) == (True, "DROP", "RADIO_LINK_FAILURE", 3)


def test_sessions_by_key_equal_sessions_by_log(spark):
    rng = random.Random(8)
    texts = ["CM_SERVICE_REQUEST", "SETUP", "CONNECT", "DISCONNECT RELEASE", "RRC_CONNECTION_RELEASE", "RRC_CONNECTION_REQUEST", "RAB_ASSIGNMENT_REQUEST", "RADIO LINK FAILURE", "CALL_REJECT", "PAGING", "IU RELEASE"]
    rows = []
    for log, (keys, anonymous) in enumerate([(4, 0), (1, 0.5), (2, 0.3), (4, 0.2), (3, 1), (1, 0.1)]):
        for i in range(250):
            who = f" call id: {rng.randrange(keys)}" if rng.random() >= anonymous else ""
            rows.append((log, 10_000 * log + 700 * (i // 2), i, rng.choice(texts) + who, rng.choice([None, None, "IDLE", "CELL_DCH", "URA_PCH"]), rng.choice([None, "normal", "abnormal"])))
    d = spark.createDataFrame(rows, "log_id long, ts_ms long, seq long, message string, state string, cause string")

    def found(**more):
        return sorted(str(sorted(r.asDict().items())) for r in rrc_sessions.rrc_session_machine(d, state="state", rrc_cause="cause", block_ms=5_000, **more).collect())

    one = found(by_key=False)
    assert len(one) > 100 and any("__ANON__" in r for r in one)
    assert found() == one  # anonymous rows settle
    assert found(rounds=1) == one  # what hasn't settled runs as one sequence
    numbers = {}
    for r in rrc_sessions.rrc_session_machine(d, state="state", rrc_cause="cause").collect():
        numbers.setdefault(r.log_id, []).append(r.session_no)
    assert set(numbers) == set(range(6)) and all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_a_long_key_runs_in_many_stretches(spark):
    texts = ["CM_SERVICE_REQUEST", "CONNECT", "RADIO LINK FAILURE", "PAGING"]
    d = spark.range(4000).selectExpr("1L AS log_id", "id * 10000 AS ts_ms", "id AS seq", f"concat(array({', '.join(repr(t) for t in texts)})[id % 4], ' call id: 7') AS message", "CAST(NULL AS string) AS state")
    flags = rrc_sessions.M.semantic_flags(rrc_sessions.M.envelope("message"), None, None)
    names, mask = list(flags), sum((F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(flags.values())), F.lit(0))
    rows = d.select("log_id", "ts_ms", "seq", mask.alias("mask"), F.col("state").alias("rrc"), F.lit("CALL:7").alias("owner"))
    stretches = rrc_sessions._in_stretches(rows, names, rrc_sessions.Timers(), 3_600_000)
    assert stretches.groupBy("stretch").count().agg(F.count("*"), F.max("count")).first()[:] == (1001, 4)
    got = rrc_sessions.rrc_session_machine(d, state="state")
    assert got.count() == 1000 and got.where("`drop` AND records = 3").count() == 1000
