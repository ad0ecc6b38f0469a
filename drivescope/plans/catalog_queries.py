"""Queries on catalogs, legends, run information, paging and merging."""

from pyspark.sql import functions as F

from drivescope.functions import registry as R
from drivescope.operators import catalog, ordered
from drivescope.plans.registry import query


def r6(c):
    return F.round(c, 6)


def joined(c):
    return F.concat_ws(",", c)


@query("S12_run_events", "v_kpi", """
SELECT run_id, ts_ms, seq, name AS event_name, metric_id, 'value_num' AS p1, value_str AS v2 FROM v_kpi
WHERE regexp_matches(lower(name), 'volte|call|ims|rrc|sip|voice|event|state')
""")
def _(v):
    d = catalog.run_events(v.v_kpi)
    return d.select("run_id", "ts_ms", "seq", "event_name", "metric_id", F.col("params")[0]["param_id"].alias("p1"),
                    F.col("params")[1]["param_value"].alias("v2"))


@query("S14_enum_lookup", "v_kpi", """
SELECT seq, CASE WHEN value_str IS NOT NULL THEN value_str ELSE r_name END AS value_str FROM v_kpi
LEFT JOIN region ON CAST(trunc(value_num / 10) AS BIGINT) = r_regionkey AND k % 2 = 0
""")
def _(v):
    lookups = v.table("region").select(F.lit("names").alias("lookup"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("text"))
    d = v.v_kpi.withColumn("lookup", F.when(F.col("k") % 2 == 0, "names")).withColumn("value_num", F.col("value_num") / 10)
    return catalog.enum_lookup(d, lookups).select("seq", "value_str")


@query("S16_list_runs", "v_kpi v_points v_marks", """
, k AS (SELECT run_id, count(*) AS kpi_count, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM v_kpi GROUP BY run_id)
, e AS (SELECT log_id AS run_id, count(*) AS event_count FROM v_marks GROUP BY log_id), t AS (SELECT log_id AS run_id, count(*) AS track_count FROM v_points GROUP BY log_id)
SELECT k.*, event_count, track_count FROM k JOIN e USING (run_id) JOIN t USING (run_id)
""")
def _(v):
    return catalog.list_runs(v.v_kpi, v.v_marks.withColumnRenamed("log_id", "run_id"), v.v_points.withColumnRenamed("log_id", "run_id"))


@query("C3_inspect_schema", "ev", """
SELECT 'event_id' AS key, count(event_id) AS count FROM ev UNION ALL SELECT 'value', count(value) FROM ev UNION ALL
SELECT 'odd', count(*) FROM ev WHERE k % 2 = 1 UNION ALL SELECT 'props.k', count(*) FROM ev UNION ALL SELECT 'props.big', count(*) FROM ev WHERE k > 50
""")
def _(v):
    props = F.when(F.col("k") > 50, F.create_map(F.lit("k"), F.col("k"), F.lit("big"), F.lit(1).cast("long"))).otherwise(
        F.create_map(F.lit("k"), F.col("k")))
    d = v.ev.select("event_id", "value", F.when(F.col("k") % 2 == 1, 1).alias("odd"), props.alias("props"))
    return catalog.inspect_schema(d, "props")


@query("C5_canonical_metric_list", "v_points", """
SELECT DISTINCT unnest(['Serving PCI', 'Serving EARFCN', 'Serving RSRP', 'a1_rscp', 'Odd Key'] || [event_type]) AS metric FROM v_points
""")
def _(v):
    props = F.create_map(F.lit("A1 RSCP"), F.col("rsrp").cast("string"), F.lit("Time"), F.lit("x"), F.lit("Odd Key"), F.lit("1"))
    d = v.v_points.select("pci", "earfcn", F.col("rsrp").alias("RSRP"), "lat", props.alias("props"), "event_type")
    return catalog.canonical_metric_list(d, ["pci", "earfcn", "RSRP", "lat"], "props", "event_type")


@query("C9_detect_technology", "v_points", """
, f AS (SELECT log_id, CASE WHEN log_id = 0 THEN 10600 + k WHEN log_id = 1 THEN k + 1 WHEN log_id = 2 THEN 140000 + k WHEN log_id = 3 THEN 1300 + k ELSE 0 END AS f
   FROM v_points)
SELECT log_id, CASE WHEN count(*) FILTER (WHERE f > 0) = 0 THEN 'Unknown' WHEN bool_or(f BETWEEN 10500 AND 10900 OR f BETWEEN 2900 AND 3100 OR f BETWEEN 4300 AND 4500)
  THEN '3G (UMTS)' WHEN avg(f) < 1000 THEN '2G (GSM)' WHEN avg(f) > 120000 THEN '5G (NR)' ELSE '4G (LTE)' END AS tech FROM f GROUP BY log_id
""")
def _(v):
    k, g = F.col("k"), F.col("log_id")
    freq = F.when(g == 0, 10600 + k).when(g == 1, k + 1).when(g == 2, 140000 + k).when(g == 3, 1300 + k).otherwise(0)
    return catalog.detect_technology(v.v_points.withColumn("freq", freq))


@query("C10_run_technology", "v_kpi", """
, n AS (SELECT DISTINCT run_id, CASE WHEN run_id = 0 THEN replace(lower(name), '.lte.', '.umts.') WHEN run_id = 1 THEN 'ping' WHEN run_id = 2
  THEN replace(replace(lower(name), '.lte.', '.nr.'), 'rsrp', 'x') ELSE lower(name) END AS n FROM v_kpi)
, s AS (SELECT run_id, max(CAST(n LIKE '%.lte.%' AS INT)) AS short,
   max(CAST(regexp_matches(n, 'rsrp|rsrq|sinr|enodeb|volte|ims') AS INT)) * 4 + count(*) FILTER (WHERE regexp_matches(n, 'rsrp|rsrq|sinr|volte|ims')) AS l,
   max(CAST(regexp_matches(n, '5g|ss-rsrp|ssrsrp|ss-sinr|gnodeb') AS INT)) * 4 + count(*) FILTER (WHERE regexp_matches(n, 'ss-rsrp|ssrsrp|ss-sinr|nr')) AS nr,
   max(CAST(regexp_matches(n, 'umts|wcdma|rscp|ecno|uarfcn|psc') AS INT)) * 4 + count(*) FILTER (WHERE regexp_matches(n, 'rscp|ecno|umts|wcdma')) AS u
   FROM n GROUP BY run_id)
SELECT run_id, CASE WHEN short = 1 THEN 'LTE' WHEN greatest(l, nr, u) <= 0 THEN 'TRP' WHEN l = greatest(l, nr, u) THEN 'LTE'
  WHEN nr = greatest(l, nr, u) THEN '5G NR' ELSE 'UMTS 3G' END AS tech FROM s
""")
def _(v):
    low, g = F.lower("name"), F.col("run_id")
    name = (
        F.when(g == 0, F.regexp_replace(low, r"\.lte\.", ".umts.")).when(g == 1, "ping")
        .when(g == 2, F.regexp_replace(F.regexp_replace(low, r"\.lte\.", ".nr."), "rsrp", "x")).otherwise(low)
    )
    return catalog.run_technology(v.v_kpi.select("run_id", name.alias("name"), F.lit(False).alias("is_event")).distinct())


@query("C27_sample_backed", "v_kpi", "SELECT name, count(*) AS sample_count FROM v_kpi GROUP BY name")
def _(v):
    decl = v.table("region").select(F.col("r_name").alias("name"), F.lit(7).cast("long").alias("metric_id"), F.lit("int").alias("dtype"))
    return catalog.metric_catalog(v.v_kpi, decl).where("sample_count > 0").select("name", "sample_count")


TAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN upper(name) LIKE '%{t}%' THEN '{t}' END" for t in R.TAGS) + "], lambda x: x IS NOT NULL), ',')"


@query("A1_metric_catalog", "v_kpi", f"""
, g AS (SELECT name, count(*) AS sample_count, count(v) AS num_count, count(*) FILTER (WHERE v IS NULL) AS str_count, min(v) AS min, max(v) AS max,
   avg(v) AS avg, arg_min(metric_id, (ts_ms, seq)) AS metric_id FROM (SELECT *, CASE WHEN k % 6 <> 0 THEN value_num END AS v FROM v_kpi)
   WHERE v IS NOT NULL OR value_str IS NOT NULL GROUP BY name)
, d AS (SELECT * FROM g UNION ALL SELECT r_name, 0, 0, 0, NULL, NULL, NULL, 7 FROM region)
SELECT name, sample_count, num_count, str_count, min, max, round(avg, 6) AS avg, metric_id, CASE WHEN sample_count = 0 THEN 'text' END AS dtype,
  CASE WHEN sample_count = 0 THEN 'string' WHEN num_count >= str_count THEN 'numeric' ELSE 'string' END AS value_kind, {TAGS} AS tags,
  array_to_string(string_split(name, '.'), '/') AS path FROM d
""")
def _(v):
    decl = v.table("region").select(F.col("r_name").alias("name"), F.lit(7).cast("long").alias("metric_id"), F.lit("text").alias("dtype"))
    s = v.v_kpi.withColumn("value_num", F.when(F.col("k") % 6 != 0, F.col("value_num")))
    d = catalog.metric_catalog(s, decl)
    return d.select("name", "sample_count", "num_count", "str_count", "min", "max", r6("avg").alias("avg"), "metric_id", "dtype",
                    "value_kind", joined("tags").alias("tags"), F.concat_ws("/", "path_segments").alias("path"))


@query("A2_event_catalog", "v_kpi", """
SELECT name AS event_name, count(*) AS count, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, 'value_num,value_str' AS param_ids FROM v_kpi
WHERE regexp_matches(lower(name), 'volte|call|ims|rrc|sip|voice|event|state') GROUP BY name
""")
def _(v):
    return catalog.event_catalog(catalog.run_events(v.v_kpi)).withColumn("param_ids", joined("param_ids"))


@query("A3_kpi_type_summary", "v_kpi", """
, g AS (SELECT run_id, name, count(*) AS sample_count, min(value_num) AS min, max(value_num) AS max, round(avg(value_num), 6) AS avg FROM v_kpi GROUP BY run_id, name)
SELECT run_id, CASE name WHEN 'Radio.Lte.ServingCell[0].Rsrp' THEN 'rsrp' WHEN 'Radio.Lte.ServingCell[0].Rsrq' THEN 'rsrq' WHEN 'Radio.Lte.ServingCell[0].RsSinr' THEN 'sinr'
  WHEN 'Radio.Lte.ServingCellTotal.Pdsch.Throughput' THEN 'dl_tp' ELSE 'ul_tp' END AS kpi, name, sample_count, min, max, avg FROM g WHERE name IN
  ('Radio.Lte.ServingCell[0].Rsrp', 'Radio.Lte.ServingCell[0].Rsrq', 'Radio.Lte.ServingCell[0].RsSinr', 'Radio.Lte.ServingCellTotal.Pdsch.Throughput', 'Radio.Lte.ServingCellTotal.Pusch.Throughput')
""")
def _(v):
    d = catalog.kpi_type_summary(catalog.metric_catalog(v.v_kpi, keys=["run_id"]), ["run_id"])
    return d.withColumn("avg", r6("avg"))


@query("A4_neighbor_metrics_summary", "v_kpi", r"""
SELECT run_id, name, CAST(regexp_extract(name, '\[(\d+)\]', 1) AS BIGINT) AS neighbor_index, lower(regexp_extract(name, '\]\.(\w+)$', 1)) AS field, count(*) AS sample_count,
 array_to_string(list_sort(list(DISTINCT idx)), ',') AS sample_indexes, count(DISTINCT idx) AS sample_index_count FROM v_kpi WHERE name LIKE 'Radio.Lte.Neighbor%' GROUP BY run_id, name
""")
def _(v):
    d = catalog.neighbor_metrics_summary(v.v_kpi, ["run_id"])
    return d.withColumn("sample_indexes", F.concat_ws(",", F.col("sample_indexes").cast("array<string>")))


SCHED = r"""
, nm AS (SELECT DISTINCT run_id, ts_ms, seq, value_num, name, CASE WHEN n LIKE '%harq%' AND regexp_matches(n, 'harq.*process') THEN 'harq_process' WHEN regexp_matches(n, 'pdsch.*numberofresourceblocks') THEN 'allocated_rb_dl'
   WHEN regexp_matches(n, 'pusch.*tbs') THEN 'tbs_ul' WHEN regexp_matches(n, 'harq.*nack') THEN 'harq_retx' END AS field
  FROM (SELECT *, lower(name) AS n FROM (SELECT run_id, ts_ms, seq, value_num, CASE k % 5 WHEN 0 THEN 'Radio.Lte.ServingCell[0].Pdsch.NumberOfResourceBlocks' WHEN 1 THEN 'Radio.Lte.ServingCell[8].Pusch.Tbs'
   WHEN 2 THEN 'Radio.Lte.Harq.Nack' WHEN 3 THEN 'Radio.Lte.Harq.ProcessId' ELSE 'Radio.Lte.Rsrp' END AS name FROM v_kpi)))
, sf AS (SELECT * FROM nm WHERE field IS NOT NULL)
"""


def sched_samples(v):
    k = F.col("k") % 5
    name = (
        F.when(k == 0, "Radio.Lte.ServingCell[0].Pdsch.NumberOfResourceBlocks").when(k == 1, "Radio.Lte.ServingCell[8].Pusch.Tbs")
        .when(k == 2, "Radio.Lte.Harq.Nack").when(k == 3, "Radio.Lte.Harq.ProcessId").otherwise("Radio.Lte.Rsrp")
    )
    return v.v_kpi.select("run_id", "ts_ms", "seq", "value_num", name.alias("name"))


@query("A6_scheduler_fields", "v_kpi", SCHED + """
, g AS (SELECT run_id, field, ts_ms - lag(ts_ms) OVER (PARTITION BY run_id, field ORDER BY ts_ms, seq) AS x FROM sf)
, st AS (SELECT run_id, field, CAST(min(x) AS DOUBLE) AS gap_min, CAST(list_sort(list(x))[count(*) // 2 + 1] AS DOUBLE) AS gap_p50,
  CAST(list_sort(list(x))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS DOUBLE) AS gap_p90, CAST(max(x) AS DOUBLE) AS gap_max FROM g WHERE x > 0 GROUP BY run_id, field)
SELECT c.run_id, c.field, sample_count, metric_names, gap_min, gap_p50, gap_p90, gap_max, coalesce(gap_p50 <= 2, false) AS per_tti
FROM (SELECT run_id, field, count(*) AS sample_count, array_to_string(list_sort(list(DISTINCT name)), ',') AS metric_names FROM sf GROUP BY run_id, field) c
LEFT JOIN st ON c.run_id = st.run_id AND c.field = st.field
""")
def _(v):
    return catalog.scheduler_fields(sched_samples(v)).withColumn("metric_names", joined("metric_names"))


@query("A6_scheduler_limitations", "v_kpi", """
SELECT run_id, run_id = 2 AS payload_present, false AS any_per_tti, CASE WHEN run_id = 2 THEN 1::BIGINT ELSE 2::BIGINT END AS notes FROM (SELECT DISTINCT run_id FROM v_kpi)
""")
def _(v):
    s = sched_samples(v)
    ev = v.v_kpi.select("run_id", F.when(F.col("run_id") == 2, "Message.Layer2.LteMac.UlGrant").otherwise("Message.Layer3.Errc").alias("event_name"))
    d = catalog.scheduler_limitations(catalog.scheduler_fields(s), catalog.payload_events(ev), s.select("run_id").distinct())
    return d.select("run_id", "payload_present", "any_per_tti", F.size("limitations").cast("long").alias("notes"))


@query("A7_scheduler_at_time", "v_kpi v_points", SCHED + """
, t AS (SELECT log_id AS run_id, seq AS time_id, ts_ms FROM v_points)
, c AS (SELECT t.run_id, time_id, field, value_num AS value, name AS metric, abs(sf.ts_ms - t.ts_ms) AS delta_ms,
   row_number() OVER (PARTITION BY time_id, field ORDER BY abs(sf.ts_ms - t.ts_ms), sf.ts_ms, sf.seq) AS rn
   FROM t JOIN sf ON t.run_id = sf.run_id AND abs(sf.ts_ms - t.ts_ms) <= 3600000)
SELECT run_id, time_id, field, value, metric, delta_ms FROM c WHERE rn = 1
""")
def _(v):
    times = v.v_points.select(F.col("log_id").alias("run_id"), F.col("seq").alias("time_id"), "ts_ms")
    return catalog.scheduler_at_time(sched_samples(v), times, 3600000)


def names_of(v):
    return v.v_kpi.groupBy("run_id", "name").agg(F.min(F.col("ts_ms") * 1000000 + F.col("seq")).alias("first_seq"))


NAMES = ", nm AS (SELECT run_id, name, min(ts_ms * 1000000 + seq) AS first_seq, lower(name) AS n FROM v_kpi GROUP BY run_id, name)"


@query("A14_discover_signals", "v_kpi", NAMES + r"""
, p AS (SELECT run_id, name, CASE n WHEN 'radio.lte.servingcelltotal.pdsch.throughput' THEN 'dl_radio' WHEN 'radio.lte.servingcelltotal.pusch.throughput' THEN 'ul_radio'
  WHEN 'data.http.download.throughput' THEN 'dl_app' WHEN 'data.http.upload.throughput' THEN 'ul_app' END AS key FROM nm)
, d AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY first_seq) AS position FROM nm WHERE regexp_matches(n,
 '(sinr|snr|rsrp|rsrq|cqi|mcs|\bri\b|layers|rank|prb|\brb\b|resource\s*block|bler|harq|rlc.*retx|pdcp.*discard)'))
SELECT run_id, key, name, 100::BIGINT AS score, 1::BIGINT AS position, 'exact' AS source, 1.0::DOUBLE AS confidence FROM p WHERE key IS NOT NULL
UNION ALL SELECT run_id, 'driver', name, 55, position, 'regex', 0.55 FROM d
""")
def _(v):
    return catalog.discover_signals(names_of(v))


@query("A15_registry_match", "v_kpi", r"""
, nm AS (SELECT DISTINCT run_id, name, lower(name) AS n FROM v_kpi)
, h AS (SELECT run_id, name, 'kpi_cqi_dl' AS key, CASE WHEN regexp_matches(n, '(lte).*cqi') THEN 100 WHEN regexp_matches(n, '(servingcell|pcell).*cqi') THEN 102 END AS rank FROM nm
 UNION ALL SELECT run_id, name, 'kpi_mcs_dl', CASE WHEN regexp_matches(n, '(dl).*mcs') THEN 100 WHEN regexp_matches(n, '(pdsch|dlsch).*mcs') THEN 102 END FROM nm
 UNION ALL SELECT run_id, name, 'kpi_mcs_ul', CASE WHEN regexp_matches(n, '(ul).*mcs') THEN 100 WHEN regexp_matches(n, '(pusch|ulsch).*mcs') THEN 102 END FROM nm
 UNION ALL SELECT run_id, name, 'kpi_bler_dl', CASE WHEN regexp_matches(n, '(dl).*bler') THEN 100 WHEN regexp_matches(n, '(pdsch|dlsch).*bler') THEN 101 END FROM nm
 UNION ALL SELECT run_id, name, 'kpi_rank_layers', CASE WHEN regexp_matches(n, 'rank\d+\.feedbackcount') THEN 100 WHEN regexp_matches(n, 'rank.*feedback') THEN 101 END FROM nm
 UNION ALL SELECT run_id, name, 'kpi_pci', CASE WHEN regexp_matches(n, '\bpci\b') THEN 100 END FROM nm
 UNION ALL SELECT run_id, name, 'ev_pci_change', CASE WHEN regexp_matches(n, '\bpci\b') THEN 100 END FROM nm
 UNION ALL SELECT run_id, name, 'kpi_rrc_state', CASE WHEN regexp_matches(n, '\brrc\b.*state') THEN 101 END FROM nm
 UNION ALL SELECT run_id, name, 'ev_rrc_state', CASE WHEN regexp_matches(n, '\brrc\b.*state') THEN 101 END FROM nm)
, b AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY rank, name) AS rn FROM h WHERE rank IS NOT NULL)
SELECT run_id, key, name, CAST(rank AS BIGINT) AS rank, 'regex' AS matched_by FROM b WHERE rn = 1
""")
def _(v):
    return catalog.registry_match(v.v_kpi.select("run_id", "name").distinct(), ["run_id"])


RANK = """CASE WHEN n LIKE '%rsrp%' THEN 100 WHEN n LIKE '%sinr%' THEN 95 WHEN n LIKE '%rsrq%' THEN 90 WHEN n LIKE '%mos%' THEN 88 WHEN n LIKE '%bler%' THEN 75
 WHEN n LIKE '%throughput%' THEN 70 WHEN n LIKE '%volte%' THEN 70 WHEN n LIKE '%lte%' THEN 65 ELSE 0 END"""


@query("A16_metric_order", "v_kpi", f"""
, nm AS (SELECT DISTINCT run_id, name, lower(name) AS n FROM v_kpi), r AS (SELECT run_id, name, CAST({RANK} AS BIGINT) AS rank FROM nm)
SELECT run_id, name, rank, row_number() OVER (PARTITION BY run_id ORDER BY rank DESC, name) AS position FROM r
""")
def _(v):
    return catalog.metric_order(v.v_kpi.select("run_id", "name").distinct(), F.lit("LTE"))


@query("A16_core_metrics", "v_kpi", """
SELECT DISTINCT run_id, CASE name WHEN 'Radio.Lte.ServingCell[0].Rsrp' THEN 'rsrp' WHEN 'Radio.Lte.ServingCell[0].Rsrq' THEN 'rsrq'
  WHEN 'Radio.Lte.ServingCell[0].RsSinr' THEN 'sinr' WHEN 'Radio.Lte.ServingCellTotal.Pdsch.Throughput' THEN 'dl' ELSE 'ul' END AS slot, name,
  CASE WHEN name LIKE '%Throughput' THEN 32::BIGINT ELSE 24::BIGINT END AS score FROM v_kpi WHERE name IN ('Radio.Lte.ServingCell[0].Rsrp', 'Radio.Lte.ServingCell[0].Rsrq',
  'Radio.Lte.ServingCell[0].RsSinr', 'Radio.Lte.ServingCellTotal.Pdsch.Throughput', 'Radio.Lte.ServingCellTotal.Pusch.Throughput')
""")
def _(v):
    return catalog.core_metrics(catalog.metric_order(v.v_kpi.select("run_id", "name").distinct(), F.lit("LTE")))


CORE_RENAMED = {1: [("Radio.Lte", "Radio.Nr"), ("RsSinr", "Ss-Sinr"), ("Rsrp", "Ss-Rsrp"), ("Rsrq", "Ss-Rsrq")], 2: [("Radio.Lte", "Radio.Wcdma"), ("RsSinr", "Sinr"), ("Rsrp", "Rscp"), ("Rsrq", "EcNo")]}


def _renamed(text, number):
    for old, new in CORE_RENAMED[number]:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("A16_core_metrics_by_tech", "v_kpi", f"""
, n AS (SELECT DISTINCT run_id, CASE run_id % 3 WHEN 1 THEN {_renamed('name', 1)} WHEN 2 THEN {_renamed('name', 2)} ELSE name END AS name FROM v_kpi)
, rules(tech, place, slot, words, prefer, avoid) AS (VALUES
  (0, 0, 'rsrp', ['rsrp'], ['servingcell'], ['neighbor']), (0, 1, 'rsrq', ['rsrq'], ['servingcell'], ['neighbor']), (0, 2, 'sinr', ['rs-sinr', 'sinr'], ['servingcell'], ['neighbor']),
  (1, 0, 'rsrp', ['ss-rsrp', 'ssrsrp', 'rsrp'], ['servingcell'], ['neighbor']), (1, 1, 'rsrq', ['ss-rsrq', 'ssrsrq', 'rsrq'], ['servingcell'], ['neighbor']), (1, 2, 'sinr', ['ss-sinr', 'sinr'], [], []),
  (2, 0, 'rsrp', ['rscp', 'rsrp'], [], []), (2, 1, 'rsrq', ['ecno', 'rsrq'], [], []), (2, 2, 'sinr', ['sinr'], [], []))
, through(place, slot, words, prefer, avoid) AS (VALUES
  (3, 'dl', ['dl throughput', 'downlink throughput', 'throughput dl', 'throughput_dl', 'dl rate', 'pdsch.throughput'], ['servingcell', 'pdsch'], ['neighbor', 'http download']),
  (4, 'ul', ['ul throughput', 'uplink throughput', 'throughput ul', 'throughput_ul', 'ul rate', 'pusch.throughput'], ['servingcell', 'pusch'], ['neighbor', 'http upload']))
, every AS (SELECT * FROM rules UNION ALL SELECT t.tech, through.* FROM through, (VALUES (0), (1), (2)) t(tech))
, sc AS (SELECT run_id, slot, place, name, len(list_filter(words, lambda w: contains(lower(name), w))) AS hits, 8 * len(list_filter(prefer, lambda w: contains(lower(name), w))) - 12 * len(list_filter(avoid, lambda w: contains(lower(name), w)))
   + CASE WHEN contains(lower(name), 'servingcell') THEN 6 ELSE 0 END - CASE WHEN contains(lower(name), 'neighbor') THEN 10 ELSE 0 END AS extra FROM n JOIN every ON every.tech = n.run_id % 3)
, bs AS (SELECT run_id, slot, place, arg_min(name, (-10 * hits - extra, name)) AS name, max(10 * hits + extra) AS score FROM sc WHERE hits > 0 AND 10 * hits + extra >= 0 GROUP BY run_id, slot, place)
SELECT run_id, arg_min(slot, place) AS slot, CAST(min(place) AS BIGINT) AS place, name, CAST(arg_min(score, place) AS BIGINT) AS score FROM bs GROUP BY run_id, name
""")
def _(v):
    name, run = F.col("name"), F.col("run_id")
    other = {i: name for i in CORE_RENAMED}
    for i, pairs in CORE_RENAMED.items():
        for old, new in pairs:
            other[i] = F.replace(other[i], F.lit(old), F.lit(new))
    names = v.v_kpi.select("run_id", F.when(run % 3 == 1, other[1]).when(run % 3 == 2, other[2]).otherwise(name).alias("name")).distinct()
    tech = F.when(run % 3 == 1, "5G NR").when(run % 3 == 2, "UMTS 3G").otherwise("LTE")
    return catalog.core_metrics_by_tech(names.withColumn("position", F.col("name")), tech)


@query("A16_labels_and_scores", "v_kpi", """
SELECT name, CASE WHEN n LIKE '%rsrp' AND n NOT LIKE '%neighbor%' THEN 'RSRP' WHEN n LIKE '%rsrq' THEN 'RSRQ' WHEN n LIKE '%sinr' THEN 'SINR'
  WHEN n = 'data.http.download.throughput' THEN 'Application throughput DL' WHEN n = 'data.http.upload.throughput' THEN 'Application throughput UL'
  WHEN n LIKE '%pdsch.throughput' THEN 'DL throughput' WHEN n LIKE '%pusch.throughput' THEN 'UL throughput' WHEN n LIKE '%.pci' THEN 'Physical cell ID' END AS label,
 CAST(CASE WHEN n LIKE '%lock%' THEN -100 ELSE 0 END + CASE WHEN n LIKE '%radio.lte.servingcell%' THEN 50 ELSE 0 END + CASE WHEN n LIKE '%.pci' THEN 30 ELSE 0 END AS BIGINT) AS id_score,
 CASE WHEN n LIKE 'data.http%' THEN 155::BIGINT END AS app_score, CAST(CASE WHEN n LIKE '%call%' THEN 12 WHEN n LIKE '%lte%' THEN 4 WHEN n LIKE '%rrc%' THEN 4 ELSE 0 END AS BIGINT) AS event_score
FROM (SELECT DISTINCT name, lower(name) AS n FROM v_kpi)
""")
def _(v):
    n = F.col("name")
    return v.v_kpi.select("name").distinct().select(
        "name", catalog.friendly_label(n).alias("label"), catalog.identifier_score(n).alias("id_score"),
        catalog.app_throughput_score(n).alias("app_score"), catalog.event_score(n, F.lit("LTE")).alias("event_score"))


@query("A16_default_metrics", "v_kpi", """
, nm AS (SELECT DISTINCT run_id, name, lower(name) AS n FROM v_kpi), f AS (SELECT run_id, arg_min(name, n) AS f FROM nm GROUP BY run_id)
SELECT nm.run_id, coalesce(arg_min(name, n) FILTER (WHERE n LIKE '%rsrp%'), min(f)) AS rsrp_metric, coalesce(arg_min(name, n) FILTER (WHERE n LIKE '%sinr%'), min(f)) AS sinr_metric,
 coalesce(arg_min(name, n) FILTER (WHERE n LIKE '%mos%'), min(f)) AS mos_metric FROM nm JOIN f ON f.run_id = nm.run_id GROUP BY nm.run_id
""")
def _(v):
    return catalog.default_metrics(v.v_kpi.select("run_id", "name").distinct())


LEGEND_SRC = """
, s AS (SELECT CASE event_type WHEN 'view' THEN 'kpi_bler_dl' WHEN 'click' THEN 'kpi_pci' ELSE 'other' END AS key, ts_ms, seq,
   CASE WHEN event_type = 'click' THEN CAST(k % 13 AS DOUBLE) ELSE rsrp + 140 END AS value_num FROM v_points)
"""
LEGEND = LEGEND_SRC + """
, fr AS (SELECT value_num AS v, count(*) AS c, min((ts_ms, seq)) AS f FROM s WHERE key = 'kpi_pci' GROUP BY value_num)
, dy AS (SELECT v, row_number() OVER (ORDER BY c DESC, f) - 1 AS position FROM fr)
, q AS (SELECT list_sort(list(value_num)) AS l, count(*) - 1 AS m FROM s WHERE key = 'other')
, qq AS (SELECT l[CAST(floor(0.1 * m) AS BIGINT) + 1] AS p10, l[CAST(floor(0.3 * m) AS BIGINT) + 1] AS p30, l[CAST(floor(0.7 * m) AS BIGINT) + 1] AS p70, l[CAST(floor(0.9 * m) AS BIGINT) + 1] AS p90 FROM q)
, lg AS (SELECT 'kpi_pci' AS key, position, v AS min, v AS max, CAST(CAST(v AS BIGINT) AS VARCHAR) AS label, 'dynamic' AS source FROM dy
 UNION ALL SELECT 'kpi_bler_dl', p, CAST(lo AS DOUBLE), CAST(hi AS DOUBLE), t, 'preset' FROM (VALUES (0, 0, 1, 'Excellent (≤1%)'), (1, 1, 5, 'Good (1–5%)'), (2, 5, 10, 'OK (5–10%)'), (3, 10, 20, 'Poor (10–20%)'), (4, 20, 100, 'Bad (>20%)')) x(p, lo, hi, t)
 UNION ALL SELECT 'other', p, CASE p WHEN 1 THEN p10 WHEN 2 THEN p30 WHEN 3 THEN p70 WHEN 4 THEN p90 END, CASE p WHEN 0 THEN p10 WHEN 1 THEN p30 WHEN 2 THEN p70 WHEN 3 THEN p90 END, t, 'auto_percentile'
   FROM qq, (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Very High')) x(p, t))
"""


def legend_source(v):
    return v.v_points.select(
        F.when(F.col("event_type") == "view", "kpi_bler_dl").when(F.col("event_type") == "click", "kpi_pci").otherwise("other").alias("key"),
        "ts_ms", "seq",
        F.when(F.col("event_type") == "click", (F.col("k") % 13).cast("double")).otherwise(F.col("rsrp") + 140).alias("value_num"))


@query("A17_legend_bins", "v_points", LEGEND + "SELECT key, CAST(position AS BIGINT) AS position, min, max, label, source FROM lg")
def _(v):
    return catalog.legend_bins(legend_source(v))


@query("A17_legend_stats", "v_points", LEGEND_SRC + """
SELECT key, count(*) AS n, min(value_num) AS min, list_sort(list(value_num))[count(*) // 2 + 1] AS median, max(value_num) AS max FROM s GROUP BY key
""")
def _(v):
    return catalog.legend_stats(legend_source(v))


@query("A18_classify_to_legend", "v_points", LEGEND + """
, la AS (SELECT key, arg_max(label, position) AS last FROM lg GROUP BY key)
, h AS (SELECT s.key, seq, value_num, arg_min(label, position) AS label FROM s JOIN lg ON s.key = lg.key AND value_num >= coalesce(lg.min, -1e300) AND value_num <= coalesce(lg.max, 1e300) GROUP BY s.key, seq, value_num)
SELECT s.key, s.seq, s.value_num, coalesce(h.label, la.last) AS label FROM s LEFT JOIN h ON s.seq = h.seq JOIN la ON la.key = s.key
""")
def _(v):
    d = legend_source(v)
    return catalog.classify_to_legend(d, catalog.legend_bins(d)).select("key", "seq", "value_num", "label")


@query("A19_threshold_distribution", "v_points", """
SELECT log_id, CASE WHEN rsrp > -70 THEN 'Excellent ( > -70 )' WHEN rsrp > -85 THEN 'Good ( -85 to -70 )' WHEN rsrp > -95 THEN 'Fair ( -95 to -85 )'
 WHEN rsrp > -105 THEN 'Poor ( -105 to -95 )' ELSE 'Bad ( < -105 )' END AS label, count(*) AS points FROM v_points GROUP BY ALL
UNION ALL SELECT log_id, CASE WHEN rsrq > -6 THEN 'Excellent ( > -6 )' WHEN rsrq > -10 THEN 'Good ( -10 to -6 )' WHEN rsrq > -14 THEN 'Fair ( -14 to -10 )'
 WHEN rsrq > -18 THEN 'Poor ( -18 to -14 )' ELSE 'Bad ( < -18 )' END, count(*) FROM v_points GROUP BY ALL
UNION ALL SELECT log_id, CAST(pci AS VARCHAR), count(*) FROM v_points GROUP BY ALL
""")
def _(v):
    p, one = v.v_points, catalog.threshold_distribution
    return one(p, "rsrp", "level", ["log_id"]).unionByName(one(p, "rsrq", "quality", ["log_id"])).unionByName(one(p, "pci", None, ["log_id"]))


INFO_NAMES = ["Pocket.General.Device.MaxNumCarriers", "Radio.Lte.ServingSystem.MimoEnabled", "Radio.Lte.ServingCell[8].Rank2.FeedbackCount",
              "Radio.Lte.ServingCell[8].Rank4.FeedbackCount", "Radio.Lte.ServingSystem.Tac", "Radio.Lte.ServingCell[8].Tac"]


@query("A28_run_info", "v_kpi", f"""
, s AS (SELECT run_id, ts_ms, seq, CASE WHEN run_id = 4 AND seq % 6 = 3 THEN 'Radio.Lte.Other' ELSE {INFO_NAMES}[seq % 6 + 1] END AS name, CAST(k % 5 AS DOUBLE) AS v, k FROM v_kpi)
, c AS (SELECT run_id, ts_ms, 'Cat ' || (k % 10 + 1) AS cat, CASE WHEN k % 3 = 0 THEN '2x2' END AS mimo, seq,
   1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS score FROM v_kpi WHERE k % 5 = 3 AND run_id <> 3)
, cb AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ts_ms DESC, seq) AS rn FROM c)
, sib AS (SELECT run_id, arg_max(8000 + k, (ts_ms, seq)) AS tac FROM v_kpi WHERE k % 5 = 4 AND run_id <> 2 GROUP BY run_id)
, k AS (SELECT run_id, CAST(arg_max(v, (ts_ms, seq)) FILTER (WHERE name LIKE '%MaxNumCarriers') AS BIGINT) AS n, max(v) FILTER (WHERE name LIKE '%Rank4%') AS r4, max(v) FILTER (WHERE name LIKE '%Rank2%') AS r2 FROM s GROUP BY run_id)
, md AS (SELECT run_id, name, CAST(v AS BIGINT) AS v, row_number() OVER (PARTITION BY run_id, name ORDER BY count(*) DESC, v) AS rn FROM s WHERE name LIKE '%Tac' GROUP BY run_id, name, v)
, kt AS (SELECT run_id, arg_min(v, CASE WHEN name LIKE '%System.Tac' THEN 0 ELSE 1 END) AS t FROM md WHERE rn = 1 AND v <> 0 GROUP BY run_id)
SELECT k.run_id, cb.cat AS ue_category, cb.mimo AS mimo_capability, CASE WHEN cb.mimo IS NULL THEN CASE WHEN r4 > 0 THEN '4x4 capable (inferred from Rank4 feedback)' ELSE '2x2 capable (inferred from rank feedback)' END END AS mimo_capability_inferred,
 CASE WHEN n >= 2 THEN 'CA capable (MaxNumCarriers=' || n || ')' END AS ca_capability_inferred,
 CASE WHEN cb.cat IS NULL THEN CASE WHEN n >= 2 AND r4 > 0 THEN 'Cat 6+ (inferred from CA + Rank4 feedback)' WHEN n >= 2 THEN 'Cat 6+ (inferred from CA capability)'
   WHEN r4 > 0 THEN 'Cat 5+ (inferred from Rank4 feedback)' ELSE 'Cat 4+ (inferred from rank feedback)' END END AS ue_category_inferred,
 coalesce(sib.tac, kt.t) AS tac FROM k LEFT JOIN cb ON cb.run_id = k.run_id AND rn = 1 LEFT JOIN sib ON sib.run_id = k.run_id LEFT JOIN kt ON kt.run_id = k.run_id
""")
def _(v):
    k = F.col("k")
    name = F.element_at(F.array(*[F.lit(n) for n in INFO_NAMES]), (F.col("seq") % 6 + 1).cast("int"))
    name = F.when((F.col("run_id") == 4) & (F.col("seq") % 6 == 3), "Radio.Lte.Other").otherwise(name)  # a run without rank 4
    samples = v.v_kpi.select("run_id", "ts_ms", "seq", name.alias("name"), (k % 5).cast("double").alias("value_num"))
    p = lambda i, val: F.struct(F.lit(i).alias("param_id"), val.alias("param_value"))
    is_cap, is_sib = (k % 5 == 3) & (F.col("run_id") != 3), (k % 5 == 4) & (F.col("run_id") != 2)  # a run without either shows what is inferred
    event = F.when(is_cap, "Message.Layer3.Errc.DcchUl.UeCapabilityInformation").when(is_sib, "Message.Layer3.Errc.Sib.SystemInformationBlockType1").otherwise("Message.Other")
    params = F.when(is_sib, F.array(p("sib1_summary", F.concat(F.lit('{"trackingAreaCode": "0x'), F.hex(F.lit(8000) + k), F.lit('"}'))))).otherwise(F.array(p("ue_cap_info_summary", F.concat(
            F.lit('{"ueCategory": '), (k % 10 + 1).cast("string"), F.when(k % 3 == 0, ', "mimoCapability": "2x2"').otherwise(""), F.lit("}")))))
    d = catalog.run_info(samples, v.v_kpi.select("run_id", "ts_ms", "seq", event.alias("event_name"), params.alias("params")))
    return d.select("run_id", "ue_category", "mimo_capability", "mimo_capability_inferred", "ca_capability_inferred", "ue_category_inferred", "tac")


@query("A29_earfcn_scale", "v_kpi", """
, r AS (SELECT run_id, CASE WHEN run_id = 1 THEN 2 * (1300 + k % 7) WHEN run_id = 2 THEN 20000 + 2 * k ELSE 1300 + k % 9 END AS v FROM v_kpi WHERE k % 3 = 0)
, sv AS (SELECT DISTINCT run_id, 1300 + k % 5 AS v FROM v_kpi WHERE k % 3 = 1)
, g AS (SELECT r.run_id, count(*) AS n, count(*) FILTER (WHERE r.v % 2 = 0) AS n_even, count(a.v) AS raw_hits, count(b.v) AS half_hits, max(r.v) AS raw_max FROM r
  LEFT JOIN sv a ON a.run_id = r.run_id AND a.v = r.v LEFT JOIN sv b ON b.run_id = r.run_id AND b.v * 2 = r.v GROUP BY r.run_id)
SELECT *, CASE WHEN half_hits > raw_hits OR (raw_max >= 10000 AND n_even / n >= 0.8) THEN 2::BIGINT ELSE 1::BIGINT END AS scale_div FROM g
""")
def _(v):
    k, g = F.col("k"), F.col("run_id")
    name = F.when(k % 3 == 0, "Radio.Lte.Neighbor[64].Earfcn").when(k % 3 == 1, "Radio.Lte.ServingCell[8].Downlink.Earfcn").otherwise("Radio.Lte.Other")
    val = F.when(k % 3 == 1, 1300 + k % 5).otherwise(F.when(g == 1, 2 * (1300 + k % 7)).when(g == 2, 20000 + 2 * k).otherwise(1300 + k % 9))
    return catalog.earfcn_scale(v.v_kpi.select("run_id", name.alias("name"), val.cast("double").alias("value_num")))


@query("A33_bounding_box", "v_points", """
SELECT log_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM v_points WHERE k % 7 <> 0 GROUP BY log_id
""")
def _(v):
    return catalog.bounding_box(v.v_points.withColumn("lat", F.when(F.col("k") % 7 != 0, F.col("lat"))), ["log_id"])


@query("A34_zero_only_series", "v_kpi", """
SELECT run_id, name, min(CASE WHEN name LIKE '%Pci' THEN 0 ELSE value_num END) = 0 AND max(CASE WHEN name LIKE '%Pci' THEN 0 ELSE value_num END) = 0 AS zero_only FROM v_kpi GROUP BY run_id, name
""")
def _(v):
    return catalog.zero_only_series(v.v_kpi.withColumn("value_num", F.when(F.col("name").endswith("Pci"), 0.0).otherwise(F.col("value_num"))))


@query("L1_page", "v_points", """
, p AS (SELECT log_id, seq, ts_ms, row_number() OVER (PARTITION BY log_id ORDER BY ts_ms, seq) AS row_no FROM v_points) SELECT * FROM p WHERE row_no > 100 AND row_no <= 150
""")
def _(v):
    return catalog.page(v.v_points, ["log_id"], 3, 50).select("log_id", "seq", "ts_ms", "row_no")


@query("L2_top_k", "v_points", """
, p AS (SELECT log_id, seq, rsrp, row_number() OVER (PARTITION BY log_id ORDER BY ts_ms DESC, seq DESC) AS rank FROM v_points) SELECT * FROM p WHERE rank <= 20
""")
def _(v):
    return catalog.first_k(v.v_points, ["log_id"], 20, F.desc("ts_ms"), F.desc("seq")).select("log_id", "seq", "rsrp", "rank")


@query("L3_union_rows", "v_points v_marks", """
SELECT log_id, seq, ts_ms, rsrp, NULL AS class FROM v_points UNION ALL SELECT log_id, seq, ts_ms, NULL, class FROM v_marks
""")
def _(v):
    return v.v_points.select("log_id", "seq", "ts_ms", "rsrp").unionByName(v.v_marks.select("log_id", "seq", "ts_ms", "class"), allowMissingColumns=True)


@query("L4_deduplicate", "v_calls v_points", """
SELECT 'distinct' AS kind, CAST(NULL AS BIGINT) AS seq, device_id AS id, ts_ms // 3600000 AS t, header AS v FROM (SELECT DISTINCT device_id, ts_ms // 3600000 AS ts_ms, header FROM v_calls) x(device_id, ts_ms, header)
""".replace("ts_ms // 3600000 AS t", "ts_ms AS t", 1) + """
UNION ALL SELECT 'run', seq, log_id, ts_ms, CAST(pci AS VARCHAR) FROM (SELECT *, lag(pci) OVER (PARTITION BY log_id ORDER BY ts_ms, seq) AS b FROM v_points) WHERE b IS DISTINCT FROM pci
""")
def _(v):
    a = v.v_calls.select(F.lit("distinct").alias("kind"), F.lit(None).cast("long").alias("seq"), F.col("device_id").alias("id"),
                         F.floor(F.col("ts_ms") / 3600000).alias("t"), F.col("header").alias("v")).dropDuplicates()
    b = ordered.with_neighbors(v.v_points, ["log_id"], previous={"b": "pci"}).where(~F.col("b").eqNullSafe(F.col("pci")))
    return a.unionByName(b.select(F.lit("run").alias("kind"), "seq", F.col("log_id").alias("id"), F.col("ts_ms").alias("t"), F.col("pci").cast("string").alias("v")))


@query("L5_overwrite_merge", "v_points", """
, u AS (SELECT 0 AS layer, log_id, pci, max(rsrp) AS rsrp, 'configured' AS src FROM v_points GROUP BY log_id, pci UNION ALL
 SELECT 1, log_id, pci, max(rsrp), 'nearest' FROM v_points WHERE pci < 5 GROUP BY log_id, pci UNION ALL SELECT 2, log_id, pci, max(rsrp), 'exact' FROM v_points WHERE pci < 3 GROUP BY log_id, pci)
SELECT log_id, pci, arg_max(rsrp, layer) AS rsrp, arg_max(src, layer) AS src FROM u GROUP BY log_id, pci
""")
def _(v):
    p = v.v_points
    one = lambda cond, src: p.where(cond).groupBy("log_id", "pci").agg(F.max("rsrp").alias("rsrp")).withColumn("src", F.lit(src))
    return catalog.overwrite_merge([one("true", "configured"), one("pci < 5", "nearest"), one("pci < 3", "exact")], ["log_id", "pci"])


@query("L6_drop_serving", "v_points", """
SELECT seq, n1_pci AS pci, CAST(e AS BIGINT) AS earfcn FROM (SELECT seq, n1_pci, CASE WHEN k % 4 <> 0 THEN n2_earfcn END AS e, k % 3 AS s_pci, CASE WHEN k % 5 <> 0 THEN earfcn END AS s_e FROM v_points)
WHERE NOT coalesce(n1_pci = s_pci AND (e IS NULL OR s_e IS NULL OR e = s_e), false)
""")
def _(v):
    d = v.v_points.select("seq", F.col("n1_pci").alias("pci"), F.when(F.col("k") % 4 != 0, F.col("n2_earfcn")).alias("earfcn"),
                          (F.col("k") % 3).alias("serving_pci"), F.when(F.col("k") % 5 != 0, F.col("earfcn")).alias("serving_earfcn"))
    return catalog.drop_serving(d).select("seq", "pci", "earfcn")


@query("L7_detail_by_id", "v_points", "SELECT seq, log_id, ts_ms, rsrp FROM v_points WHERE seq = (SELECT max(seq) FROM v_points)")
def _(v):
    top = v.v_points.agg(F.max("seq").alias("seq"))
    return v.v_points.join(F.broadcast(top), "seq").select("seq", "log_id", "ts_ms", "rsrp")


@query("L8_stable_sort", "v_calls", """
SELECT device_id, call_id, start_ms, row_number() OVER (PARTITION BY device_id ORDER BY start_ms NULLS LAST, call_id) AS position
FROM (SELECT device_id, call_id, min(CASE WHEN header = 'CAA' THEN ts_ms END) AS start_ms FROM v_calls GROUP BY device_id, call_id)
""")
def _(v):
    d = v.v_calls.groupBy("device_id", "call_id").agg(F.min(F.when(F.col("header") == "CAA", F.col("ts_ms"))).alias("start_ms"))
    # sessions without a start come last, by id; their blocks are as even as the ids
    d = d.withColumn("_t", F.coalesce("start_ms", F.lit(1 << 60) + F.col("call_id") * ordered.HOUR_MS))
    return ordered.with_row_number(d, ["device_id"], "position", ts="_t", seq="call_id").drop("_t")
