"""Queries on metric series and on the time-join kit."""

from pyspark.sql import functions as F

from drivescope.operators import ordered, quantiles, series, timejoin
from drivescope.plans.registry import query

SCALED = "CASE WHEN name = 'click' THEN value_num * 1000000 WHEN name = 'view' THEN value_num * 1000 ELSE value_num END"
V_TP = f", v_tp AS (SELECT run_id, name, ts_ms, seq, {SCALED} AS value_num FROM v_series)"


def v_tp(v):
    """Series in mixed units (bps, kbps, Mbps)."""
    scaled = (
        F.when(F.col("name") == "click", F.col("value_num") * 1000000)
        .when(F.col("name") == "view", F.col("value_num") * 1000)
        .otherwise(F.col("value_num"))
    )
    return v.v_series.select("run_id", "name", "ts_ms", "seq", scaled.alias("value_num"))


def r6(c):
    return F.round(c, 6)


def floor_pick(p):
    return f"list_sort(list(x))[CAST(floor({p} * (count(*) - 1)) AS BIGINT) + 1]"


@query("W2_state_changes", "v_series", """
, p AS (SELECT *, lag(value_num) OVER (PARTITION BY run_id, name ORDER BY ts_ms, seq) AS from_value FROM v_series)
SELECT run_id, name, ts_ms, seq, from_value, value_num AS to_value FROM p WHERE abs(value_num - from_value) > 25
""")
def _(v):
    return series.state_changes(v.v_series, threshold=25.0)


DIPS = """
, f AS (SELECT *, row_number() OVER w - 1 AS pos, sum(CASE WHEN {v} < {thr} THEN 0 ELSE 1 END) OVER w AS island FROM {t}
        WINDOW w AS (PARTITION BY run_id, name ORDER BY ts_ms, seq))
, d AS (SELECT run_id, name, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, min({v}) AS min_value, min(pos) AS start_index,
        max(pos) AS end_index, (max(ts_ms) - min(ts_ms)) / 1000.0 AS duration_sec FROM f WHERE {v} < {thr}
        GROUP BY run_id, name, island HAVING (max(ts_ms) - min(ts_ms)) / 1000.0 >= {sec})
"""


@query("W3_detect_dips", "v_series", DIPS.format(v="value_num", t="v_series", thr=60, sec=900) + """
SELECT run_id, name, start_ms, end_ms, min_value, start_index, end_index, duration_sec FROM d
""")
def _(v):
    return series.detect_dips(v.v_series, threshold=60.0, min_duration_sec=900.0)


@query("W4_first_sustained", "v_series", """
, p AS (SELECT *, lead(ts_ms) OVER (PARTITION BY run_id, name ORDER BY ts_ms, seq) AS nx FROM v_series)
SELECT run_id, name, min(CASE WHEN value_num > 150 AND nx - ts_ms >= 3600000 THEN ts_ms END) AS first_ts
FROM p GROUP BY run_id, name
""")
def _(v):
    return series.first_sustained(v.v_series, ["run_id", "name"], F.col("value_num") > 150, 3600000)


@query("W10_downsample", "v_series", """
, p AS (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY ts_ms, seq) - 1 AS pos,
        count(*) OVER (PARTITION BY run_id, name) AS n FROM v_series)
, s AS (SELECT DISTINCT run_id, name, n, CAST(round_even(i * ((n - 1) / 99.0), 0) AS BIGINT) AS pos
        FROM (SELECT DISTINCT run_id, name, n FROM p) g, range(100) t(i))
SELECT p.run_id, p.name, ts_ms, seq, value_num FROM p JOIN s ON p.run_id = s.run_id AND p.name = s.name AND p.pos = s.pos
""")
def _(v):
    d = series.downsample(v.v_series, ["run_id", "name"], 100)
    return d.select("run_id", "name", "ts_ms", "seq", "value_num")


@query("S17_signal_series", "v_kpi", """
, p AS (SELECT run_id, ts_ms, seq, value_num, row_number() OVER (PARTITION BY run_id ORDER BY ts_ms, seq) - 1 AS pos,
        count(*) OVER (PARTITION BY run_id) AS n FROM v_kpi
        WHERE name = 'Radio.Lte.ServingCell[0].Rsrp' AND idx = 3 AND value_num IS NOT NULL)
, s AS (SELECT DISTINCT run_id, n, CAST(round_even(i * ((n - 1) / 49.0), 0) AS BIGINT) AS pos
        FROM (SELECT DISTINCT run_id, n FROM p) g, range(50) t(i))
SELECT p.run_id, ts_ms, seq, value_num FROM p LEFT JOIN s ON p.run_id = s.run_id AND p.pos = s.pos
WHERE p.n <= 50 OR s.pos IS NOT NULL
""")
def _(v):
    from drivescope.operators.catalog import signal_series

    return signal_series(v.v_kpi, "Radio.Lte.ServingCell[0].Rsrp", idx=3, max_points=50).select(
        "run_id", "ts_ms", "seq", "value_num"
    )


@query("A5_interval_stats", "v_series", """
, g AS (SELECT run_id, name, ts_ms - lag(ts_ms) OVER (PARTITION BY run_id, name ORDER BY ts_ms, seq) AS x FROM v_series)
SELECT run_id, name, count(*) AS gap_count, CAST(min(x) AS DOUBLE) AS gap_min,
  CAST(list_sort(list(x))[count(*) // 2 + 1] AS DOUBLE) AS gap_p50,
  CAST(list_sort(list(x))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS DOUBLE) AS gap_p90,
  CAST(max(x) AS DOUBLE) AS gap_max, list_sort(list(x))[count(*) // 2 + 1] <= 2 AS per_tti
FROM g WHERE x > 0 GROUP BY run_id, name
""")
def _(v):
    return series.interval_stats(v.v_series)


NORM = """
, md AS (SELECT run_id, name, list_sort(list(value_num))[count(*) // 2 + 1] AS m FROM v_tp WHERE value_num > 0 GROUP BY ALL)
, nrm AS (SELECT t.run_id, t.name, ts_ms, seq, value_num, CASE WHEN m >= 1e6 THEN 1e6::DOUBLE WHEN m >= 1e3 THEN 1e3::DOUBLE ELSE 1.0::DOUBLE END AS divisor
  FROM v_tp t LEFT JOIN md ON t.run_id = md.run_id AND t.name = md.name)
"""


@query("A9_normalize_throughput", "v_series", V_TP + NORM + """
SELECT run_id, name, ts_ms, seq, divisor, CASE WHEN divisor = 1 THEN 'Mbps (raw)' ELSE 'Mbps' END AS unit_label,
  round(value_num / divisor, 6) AS value_mbps FROM nrm
""")
def _(v):
    return series.normalize_throughput(v_tp(v)).select(
        "run_id", "name", "ts_ms", "seq", "divisor", "unit_label", r6(F.col("value_mbps")).alias("value_mbps")
    )


SUMMARY = f"""
, sm AS (SELECT run_id, name, round(avg(x), 6) AS avg, max(x) AS peak,
  round(count(*) FILTER (WHERE x < 5) / count(*) * 100, 6) AS pct_below, count(*) AS sample_count,
  {floor_pick(0.5)} AS median, {floor_pick(0.1)} AS p10, {floor_pick(0.9)} AS p90
  FROM (SELECT run_id, name, value_num / divisor AS x FROM nrm) GROUP BY run_id, name)
"""


@query("A8_throughput_summary", "v_series", V_TP + NORM + SUMMARY + "SELECT * FROM sm")
def _(v):
    d = series.throughput_summary(series.normalize_throughput(v_tp(v)))
    return d.withColumn("avg", r6("avg")).withColumn("pct_below", r6("pct_below"))


@query("A10_normalize_metric_series", "v_series", V_TP + f"""
, md AS (SELECT run_id, name, {floor_pick(0.5)} AS m FROM (SELECT run_id, name, value_num AS x FROM v_tp) GROUP BY run_id, name)
, c AS (SELECT t.*, m, CASE WHEN t.name IN ('click', 'view') THEN CASE WHEN m >= 1e6 THEN 'bps->Mbps' WHEN m >= 1e3 THEN 'kbps->Mbps'
   ELSE 'already-Mbps' END WHEN t.name = 'signup' THEN CASE WHEN m <= 1.0 THEN 'fraction->percent' ELSE 'already-percent' END
   WHEN t.name = 'error' AND m > 10000 THEN 'warning-possible-microseconds' ELSE 'none' END AS conversion
  FROM v_tp t JOIN md ON t.run_id = md.run_id AND t.name = md.name)
SELECT run_id, name, ts_ms, seq, m AS raw_median, conversion, round(CASE conversion WHEN 'bps->Mbps' THEN value_num / 1e6
  WHEN 'kbps->Mbps' THEN value_num / 1e3 WHEN 'fraction->percent' THEN value_num * 100 ELSE value_num END, 6) AS y,
  CASE WHEN name IN ('click', 'view') THEN 'Mbps' WHEN name = 'signup' THEN '%' WHEN name = 'error' THEN 'ms' ELSE 'unitless' END AS unit
FROM c
""")
def _(v):
    rule = (
        F.when(F.col("name").isin("click", "view"), "Mbps").when(F.col("name") == "signup", "percent")
        .when(F.col("name") == "error", "ms")
    )
    d = series.normalize_metric_series(v_tp(v), rule)
    return d.select("run_id", "name", "ts_ms", "seq", "raw_median", "conversion", r6("y").alias("y"), "unit")


@query("A11_sanity_check", "v_kpi", """
, r AS (SELECT run_id, name, min(x) AS lo, max(x) AS hi, lower(name) AS l FROM (SELECT *, CASE WHEN run_id <> 4 OR name NOT LIKE '%Pci' THEN value_num END AS x FROM v_kpi) GROUP BY run_id, name)
, c AS (SELECT run_id, name, list_filter([
  CASE WHEN l LIKE '%cqi%' THEN CASE WHEN lo < 0 OR hi > 15 THEN printf('CQI: out-of-range [%.2f, %.2f], expected 0..15', lo, hi) ELSE 'CQI: ok' END END,
  CASE WHEN l LIKE '%ri%' OR l LIKE '%rank%' THEN CASE WHEN lo < 0 OR hi > 4 THEN printf('RI/Rank: out-of-range [%.2f, %.2f], expected 0..4', lo, hi) ELSE 'RI/Rank: ok' END END,
  CASE WHEN l LIKE '%mcs%' THEN CASE WHEN lo < 0 OR hi > 31 THEN printf('MCS: out-of-range [%.2f, %.2f], expected 0..31', lo, hi) ELSE 'MCS: ok' END END,
  CASE WHEN l LIKE '%bler%' THEN CASE WHEN lo < 0 OR hi > 100 THEN printf('BLER: out-of-range [%.2f, %.2f], expected 0..100', lo, hi) ELSE 'BLER: ok' END END,
  CASE WHEN l LIKE '%code%' THEN CASE WHEN lo < 0 OR hi > 120 THEN printf('Code rate: out-of-range [%.2f, %.2f], expected 0..120', lo, hi) ELSE 'Code rate: ok' END END,
  CASE WHEN l LIKE '%prb%' OR l LIKE '%rb%' THEN CASE WHEN lo < 0 OR hi > 300 THEN printf('PRB/RB: out-of-range [%.2f, %.2f], expected 0..300', lo, hi) ELSE 'PRB/RB: ok' END END,
  CASE WHEN l LIKE '%rtt%' OR l LIKE '%jitter%' THEN CASE WHEN lo < 0 OR hi > 2000 THEN printf('RTT/Jitter: out-of-range [%.2f, %.2f], expected 0..2000', lo, hi) ELSE 'RTT/Jitter: ok' END END,
  CASE WHEN l LIKE '%loss%' THEN CASE WHEN lo < 0 OR hi > 100 THEN printf('Packet loss: out-of-range [%.2f, %.2f], expected 0..100', lo, hi) ELSE 'Packet loss: ok' END END
  ], lambda x: x IS NOT NULL) AS cs, lo FROM r)
SELECT run_id, name, CASE WHEN lo IS NULL THEN 'No numeric samples' WHEN len(cs) = 0 THEN 'No rule for this KPI key' ELSE array_to_string(cs, '; ') END AS checks,
  lo IS NULL OR len(list_filter(cs, lambda x: contains(x, 'out-of-range'))) = 0 AS pass FROM c
""")
def _(v):
    silent = (F.col("run_id") == 4) & F.col("name").like("%Pci")  # a series without numbers
    d = series.sanity_check(v.v_kpi.withColumn("value_num", F.when(~silent, F.col("value_num"))))
    return d.select("run_id", "name", F.concat_ws("; ", "checks").alias("checks"), "pass")


PAIRS = """
, lb AS (SELECT run_id, ts_ms // 1000 AS sec, arg_max(value_num, (ts_ms, seq)) AS b FROM b0 GROUP BY run_id, ts_ms // 1000)
, pr AS (SELECT a0.run_id, a0.ts_ms, a0.seq, a0.value_num AS a, lb.b FROM a0 JOIN lb ON a0.run_id = lb.run_id AND a0.ts_ms // 1000 = lb.sec)
"""
# One simulated second is a quarter of an hour, so that the sparse probe rows meet.
# Every series has a side: three kinds of events are looked up among the other two.
LEFT = "name IN ('click', 'signup', 'error')"
RIGHT = "name IN ('view', 'purchase')"
SLOW = """
, a0 AS (SELECT run_id, ts_ms // 900 AS ts_ms, seq, value_num FROM v_series WHERE name IN ('click', 'signup', 'error'))
, b0 AS (SELECT run_id, ts_ms // 900 AS ts_ms, seq, value_num FROM v_series WHERE name IN ('view', 'purchase'))
"""


def slow_pair(v):
    s = v.v_series.withColumn("ts_ms", F.floor(F.col("ts_ms") / 900))
    return s.where(LEFT), s.where(RIGHT)


@query("J12_exact_second_join", "v_series", SLOW + PAIRS + "SELECT * FROM pr")
def _(v):
    a, b = slow_pair(v)
    return timejoin.exact_second_join(a, b, ["run_id"])


@query("A12_pearson", "v_series", SLOW + PAIRS + """
SELECT run_id, CASE WHEN count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN round(corr(a, b), 6) END AS correlation, count(*) AS pairs FROM pr GROUP BY run_id
""")
def _(v):
    a, b = slow_pair(v)
    d = series.pearson(timejoin.exact_second_join(a, b, ["run_id"]), ["run_id"])
    return d.withColumn("correlation", r6("correlation"))


VERDICT = f"""
, vd AS (SELECT run_id, count(*) FILTER (WHERE b < a * 0.7) / count(*) * 100 AS app_lt_70_pct, CASE WHEN count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS correlation,
   count(*) AS pairs, {floor_pick(0.5)} AS ratio_median FROM (SELECT *, b / a AS x FROM pr WHERE a > 0) GROUP BY run_id)
"""


@query("A13_mismatch_verdict", "v_series", SLOW + PAIRS + VERDICT + """
SELECT run_id, round(app_lt_70_pct, 6) AS app_lt_70_pct, round(correlation, 6) AS correlation, coalesce(pairs, 0) AS pairs, round(ratio_median, 6) AS ratio_median,
 CASE WHEN ratio_median < 0.7 AND app_lt_70_pct > 40 THEN 'app-limited' WHEN ratio_median >= 0.9 THEN 'radio-limited' ELSE 'mixed' END AS flag
FROM (SELECT run_id FROM a0 UNION SELECT run_id FROM b0) LEFT JOIN vd USING (run_id)
""")
def _(v):
    a, b = slow_pair(v)
    d = series.mismatch_verdict(a, b)
    return d.select("run_id", r6("app_lt_70_pct").alias("app_lt_70_pct"), r6("correlation").alias("correlation"), "pairs",
                    r6("ratio_median").alias("ratio_median"), "flag")


LR = """
, l AS (SELECT run_id, ts_ms, seq FROM v_series WHERE name IN ('click', 'signup', 'error'))
, r AS (SELECT run_id, ts_ms, seq, value_num FROM v_series WHERE name IN ('view', 'purchase'))
"""


ASOF = """
, rl AS (SELECT run_id, ts_ms, max(seq) AS seq FROM r GROUP BY run_id, ts_ms)
, rf AS (SELECT run_id, ts_ms, min(seq) AS seq FROM r GROUP BY run_id, ts_ms)
, pb AS (SELECT l.*, p.ts_ms AS p_ts, p.seq AS p_seq FROM l ASOF LEFT JOIN rl p ON l.run_id = p.run_id AND l.ts_ms >= p.ts_ms)
, nb AS (SELECT pb.*, n.ts_ms AS n_ts, n.seq AS n_seq FROM pb ASOF LEFT JOIN rf n ON pb.run_id = n.run_id AND pb.ts_ms < n.ts_ms)
, bst AS (SELECT *, CASE WHEN n_ts IS NOT NULL AND (p_ts IS NULL OR n_ts - ts_ms < ts_ms - p_ts) THEN n_seq ELSE p_seq END AS m_seq,
  CASE WHEN n_ts IS NOT NULL AND (p_ts IS NULL OR n_ts - ts_ms < ts_ms - p_ts) THEN n_ts - ts_ms ELSE p_ts - ts_ms END AS delta FROM nb)
"""


@query("J1_nearest_join", "v_series", LR + ASOF + """
SELECT bst.run_id, bst.ts_ms, bst.seq, r.value_num AS value, m_seq AS match_seq, delta AS delta_ms
FROM bst JOIN r ON r.seq = m_seq WHERE abs(delta) <= 900000
""")
def _(v):
    s = v.v_series
    left, right = s.where(LEFT).select("run_id", "ts_ms", "seq"), s.where(RIGHT).select(
        "run_id", "ts_ms", "seq", "value_num"
    )
    d = timejoin.nearest_join(left, right, ["run_id"], 900000)
    return d.select("run_id", "ts_ms", "seq", F.col("match.value_num").alias("value"), F.col("match.seq").alias("match_seq"),
                    F.col("match_delta_ms").alias("delta_ms"))


@query("J3_asof_backward", "v_cfg v_series", """
, l AS (SELECT run_id, (k + 1) % 8 AS meas_id, ts_ms, seq FROM v_series)
, r AS (SELECT run_id, meas_id, ts_ms, max(seq) AS seq FROM v_cfg WHERE op = 'add' GROUP BY run_id, meas_id, ts_ms)
, f AS (SELECT run_id, meas_id, arg_min(seq, (ts_ms, seq)) AS fseq FROM (SELECT run_id, meas_id, ts_ms, min(seq) AS seq FROM v_cfg WHERE op = 'add' GROUP BY run_id, meas_id, ts_ms) GROUP BY run_id, meas_id)
SELECT l.run_id, l.ts_ms, l.seq, r.seq AS serving_seq, coalesce(r.seq, f.fseq) AS config_seq
FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.meas_id = r.meas_id AND l.ts_ms >= r.ts_ms LEFT JOIN f ON f.run_id = l.run_id AND f.meas_id = l.meas_id
""")
def _(v):
    left = v.v_series.select("run_id", ((F.col("k") + 1) % 8).alias("meas_id"), "ts_ms", "seq")
    right = v.v_cfg.where("op = 'add'").select("run_id", "meas_id", "ts_ms", "seq")
    d = timejoin.asof_backward(left, right, ["run_id", "meas_id"], value="serving")
    d = timejoin.asof_backward(d, right, ["run_id", "meas_id"], value="config", before_first="first")
    return d.select("run_id", "ts_ms", "seq", F.col("serving.seq").alias("serving_seq"), F.col("config.seq").alias("config_seq"))


@query("J7_window_join", "v_series", LR + """
SELECT l.run_id, l.seq, l.ts_ms, r.seq AS row_seq, r.ts_ms - l.ts_ms AS delta_ms FROM l JOIN r ON l.run_id = r.run_id
AND r.ts_ms >= l.ts_ms - 1800000 AND r.ts_ms <= l.ts_ms + 600000
""")
def _(v):
    s = v.v_series.select("run_id", "ts_ms", "seq", "name")
    d = timejoin.interval_join(s.where(LEFT), s.where(RIGHT), ["run_id"], 1800000, 600000)
    return d.select("run_id", "seq", "ts_ms", F.col("row.seq").alias("row_seq"), (F.col("row.ts_ms") - F.col("ts_ms")).alias("delta_ms"))


MARK_PAIRS = """
, c AS (SELECT p.seq AS point_seq, p.ts_ms, m.seq AS m_seq, m.ts_ms AS m_ts, m.exact_a3 FROM v_points p JOIN v_marks m
  ON p.log_id = m.log_id AND p.device_id = m.device_id AND m.class = '{cls}' AND {rng} {extra})
, b AS (SELECT *, row_number() OVER (PARTITION BY point_seq ORDER BY {order}) AS rn FROM c)
SELECT p.seq AS point_seq, p.ts_ms, b.m_seq AS event_seq, b.m_ts - p.ts_ms AS delta_ms
FROM v_points p LEFT JOIN b ON b.point_seq = p.seq AND rn = 1
"""


def _reduce_marks(v, cls, before, after, agg, classes=(None,), match=None):
    pts = v.v_points.select(F.col("seq").alias("point_seq"), "log_id", "device_id", "ts_ms", "pci")
    marks = v.v_marks.where(F.col("class") == cls).select("log_id", "device_id", "ts_ms", "seq", "tgt_pci", "exact_a3")
    d = timejoin.reduce_nearest(pts, marks, ["log_id", "device_id"], before, after, ["point_seq"], {"best": agg}, classes, match=match)
    return d.select("point_seq", "ts_ms", F.col("best.seq").alias("event_seq"), (F.col("best.ts_ms") - F.col("ts_ms")).alias("delta_ms"))


@query("J4_nearest_event", "v_points v_marks", MARK_PAIRS.format(
    cls="ho_command", rng="abs(m.ts_ms - p.ts_ms) <= 7200000", extra="AND (m.tgt_pci IS NULL OR m.tgt_pci = p.pci)",
    order="abs(m_ts - ts_ms), m_ts, m_seq"))
def _(v):
    return _reduce_marks(v, "ho_command", 7200000, 7200000, timejoin.nearest_event(F.col("ts_ms")), match=("pci", "tgt_pci"))


@query("J5_first_event_after", "v_points v_marks", MARK_PAIRS.format(
    cls="ho_complete", rng="m.ts_ms >= p.ts_ms AND m.ts_ms - p.ts_ms <= 9000000", extra="", order="m_ts, m_seq"))
def _(v):
    return _reduce_marks(v, "ho_complete", 0, 9000000, timejoin.first_event_after(F.col("ts_ms"), 9000000))


@query("J6_preferred_report", "v_points v_marks", MARK_PAIRS.format(
    cls="measurement_report", rng="abs(m.ts_ms - p.ts_ms) <= 7200000", extra="",
    order="CASE WHEN exact_a3 THEN 0 ELSE 1 END, CASE WHEN m_ts <= ts_ms THEN 0 ELSE 1 END, abs(m_ts - ts_ms), m_ts, m_seq"))
def _(v):
    agg = timejoin.preferred_report(F.col("ts_ms"), F.col("row.exact_a3"))
    exact = F.coalesce("exact_a3", F.lit(False))
    return _reduce_marks(v, "measurement_report", 7200000, 7200000, agg, [exact, ~exact])


@query("S9_carry_forward", "v_radio", """
SELECT device_id, seq, ts_ms, last_value(CASE WHEN event_type = 'click' THEN tx END IGNORE NULLS) OVER w AS tx_known,
 last_value(CASE WHEN event_type = 'view' THEN bler END IGNORE NULLS) OVER w AS bler_known,
 last_value(CASE WHEN event_type = 'error' THEN psc END IGNORE NULLS) OVER w AS psc_known
FROM v_radio WINDOW w AS (PARTITION BY device_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def _(v):
    d = ordered.with_last_known(v.v_radio, ["device_id"], {
        "tx_known": F.when(F.col("event_type") == "click", F.col("tx")),
        "bler_known": F.when(F.col("event_type") == "view", F.col("bler")),
        "psc_known": F.when(F.col("event_type") == "error", F.col("psc")),
    })
    return d.select("device_id", "seq", "ts_ms", "tx_known", "bler_known", "psc_known")


@query("P_percentile_rules", "v_series", f"""
SELECT run_id, name, count(*) AS n, list_sort(list(x))[CAST(ceil(0.9 * count(*)) AS BIGINT)] AS p90_nearest_rank,
  {floor_pick(0.5)} AS lower_median, list_sort(list(x))[count(*) // 2 + 1] AS upper_median, round(median(x), 6) AS true_median
FROM (SELECT run_id, name, value_num AS x FROM v_series) GROUP BY run_id, name
""")
def _(v):
    ranks = {"p90_nearest_rank": quantiles.nearest_rank(0.9), "lower_median": quantiles.floor_index(0.5),
             "upper_median": quantiles.upper_median()}
    s, keys = v.v_series, ["run_id", "name"]
    d = quantiles.pick_ranks(s, keys, "value_num", ranks)
    m = quantiles.median(s, keys, "value_num", "true_median").drop("n").withColumn("true_median", r6("true_median"))
    return d.join(m, keys)


# The sparse probe stands still for a while: dips of half an hour, a track of 'error' rows, 15 minutes of tolerance.
@query("K18_throughput_report", "v_series", V_TP + NORM + SUMMARY.replace("x < 5", "x < 40")
       + ", nd AS (SELECT run_id, name, ts_ms, seq, value_num / divisor AS y FROM nrm)"
       + DIPS.format(v="y", t="nd", thr=40, sec=1800)
       + ", dp AS (SELECT run_id, name, count(*) AS dip_count, max(duration_sec) AS longest_dip_sec, min(min_value) AS deepest_dip FROM d GROUP BY run_id, name)"
       + """
, l AS (SELECT s.run_id, n.name, s.ts_ms, s.seq FROM v_series s, (SELECT DISTINCT name FROM v_series) n WHERE s.name = 'error')
, rl AS (SELECT run_id, name, ts_ms, max(seq) AS seq FROM nd GROUP BY ALL)
, rf AS (SELECT run_id, name, ts_ms, min(seq) AS seq FROM nd GROUP BY ALL)
, pb AS (SELECT l.*, p.ts_ms AS p_ts, p.seq AS p_seq FROM l ASOF LEFT JOIN rl p ON l.run_id = p.run_id AND l.name = p.name AND l.ts_ms >= p.ts_ms)
, nb AS (SELECT pb.*, n.ts_ms AS n_ts, n.seq AS n_seq FROM pb ASOF LEFT JOIN rf n ON pb.run_id = n.run_id AND pb.name = n.name AND pb.ts_ms < n.ts_ms)
, bst AS (SELECT *, CASE WHEN n_ts IS NOT NULL AND (p_ts IS NULL OR n_ts - ts_ms < ts_ms - p_ts) THEN n_seq ELSE p_seq END AS m_seq,
  CASE WHEN n_ts IS NOT NULL AND (p_ts IS NULL OR n_ts - ts_ms < ts_ms - p_ts) THEN n_ts - ts_ms ELSE p_ts - ts_ms END AS delta FROM nb)
, lo AS (SELECT bst.run_id, bst.name, count(*) AS located_points, round(avg(nd.y), 6) AS located_avg FROM bst JOIN nd ON nd.seq = m_seq
  WHERE abs(delta) <= 900000 GROUP BY bst.run_id, bst.name)
, a0 AS (SELECT run_id, ts_ms, seq, y AS value_num FROM nd WHERE name = 'click')
, b0 AS (SELECT run_id, ts_ms, seq, y AS value_num FROM nd WHERE name = 'view')
""" + PAIRS + VERDICT + """
SELECT sm.run_id, sm.name, avg, peak, pct_below, sample_count, median, p10, p90, dv.divisor, CASE WHEN dv.divisor = 1 THEN 'Mbps (raw)' ELSE 'Mbps' END AS unit_label,
 coalesce(dip_count, 0) AS dip_count, longest_dip_sec, deepest_dip, coalesce(located_points, 0) AS located_points, located_avg,
 CASE WHEN ratio_median < 0.7 AND app_lt_70_pct > 40 THEN 'app-limited' WHEN ratio_median >= 0.9 THEN 'radio-limited' ELSE 'mixed' END AS flag,
 round(ratio_median, 6) AS ratio_median
FROM sm JOIN (SELECT run_id, name, max(divisor) AS divisor FROM nrm GROUP BY ALL) dv ON dv.run_id = sm.run_id AND dv.name = sm.name
LEFT JOIN dp ON dp.run_id = sm.run_id AND dp.name = sm.name LEFT JOIN lo ON lo.run_id = sm.run_id AND lo.name = sm.name
LEFT JOIN vd ON vd.run_id = sm.run_id
""")
def _(v):
    s = v_tp(v)
    names = F.array(*[F.lit(n) for n in ("signup", "click", "purchase", "error", "view")])
    track = v.v_series.where("name = 'error'").select("run_id", F.explode(names).alias("name"), "ts_ms", "seq")
    d = series.throughput_report(
        s, track, radio_name="click", app_name="view", low_threshold=40.0, min_dip_sec=1800.0, tolerance_ms=900000
    )
    for c in ("avg", "pct_below", "located_avg", "ratio_median"):
        d = d.withColumn(c, r6(c))
    return d
