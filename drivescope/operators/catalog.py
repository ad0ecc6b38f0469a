"""Catalogs, KPI summaries, scheduler fields, legends, run information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.functions import registry as R
from drivescope.functions import scalars as S
from drivescope.operators import ordered, quantiles, series, timejoin

# Rule tables become array literals of the few columns they touch, so no join is needed for them.


def _any(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def _none(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


# ---- reading --------------------------------------------------------------------------------------------------------


def enum_lookup(samples: DataFrame, lookups: DataFrame) -> DataFrame:
    """Fill a missing text value from the lookup table (lookup, code, text) the sample names."""
    table = lookups.select(F.col("lookup").alias("_lk"), F.col("code").cast("long").alias("_code"), F.col("text").alias("_text"))
    hit = (F.col("lookup") == F.col("_lk")) & (F.col("value_num").cast("long") == F.col("_code")) & F.col("value_str").isNull()
    return (
        samples.join(table, hit, "left")
        .withColumn("value_str", F.coalesce("value_str", "_text"))
        .drop("_lk", "_code", "_text")
    )


def run_events(samples: DataFrame) -> DataFrame:
    """Event rows derived from KPI names that speak of calls, signalling or states."""
    token = "volte|call|ims|rrc|sip|voice|event|state"
    param = lambda i, v, t: F.struct(
        F.lit(i).alias("param_id"), v.cast("string").alias("param_value"), F.lit(t).alias("param_type"))
    return samples.where(F.lower("name").rlike(token)).select(
        "run_id", "ts_ms", "seq", F.col("name").alias("event_name"), "metric_id",
        F.array(param("value_num", F.col("value_num"), "float"), param("value_str", F.col("value_str"), "string")).alias("params"),
    )


def signal_series(
    samples: DataFrame, signal: str, *, run_id: int | None = None, idx: int | None = None, max_points: int | None = None,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """One signal of each run, optionally one sample index; numeric rows must hold a number.

    With ``max_points`` each series is thinned to that many rows (50 000 is the customary number).
    """
    d = samples.where(F.col("name") == signal)
    if run_id is not None:
        d = d.where(F.col("run_id") == run_id)
    if idx is not None:
        d = d.where(F.col("idx") == idx)
    is_text = F.col("dtype") == "str" if "dtype" in samples.columns else F.lit(False)
    d = d.where(is_text | F.col("value_num").isNotNull())
    if max_points is None:
        return d
    same = [c for c in ("ts_ms", "value_num", "value_str", "idx") if c in d.columns]
    return series.downsample(d, keys, max_points, same=same)


def list_runs(samples: DataFrame, events: DataFrame, track: DataFrame) -> DataFrame:
    """Counts and time span per run; each input is reduced before the join."""
    k = samples.groupBy("run_id").agg(
        F.count("*").alias("kpi_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms")
    )
    e = events.groupBy("run_id").agg(F.count("*").alias("event_count"))
    t = track.groupBy("run_id").agg(F.count("*").alias("track_count"))
    return k.join(e, "run_id", "full").join(t, "run_id", "full").fillna(0, ["kpi_count", "event_count", "track_count"])


# ---- catalogs ---------------------------------------------------------------------------------------------------------


def inspect_schema(df: DataFrame, props: str | None = None) -> DataFrame:
    """How often each column, and each key of the property map, is present; one pass over the rows."""
    own = [c for c in df.columns if c != props]
    counts = df.agg(*[F.count(c).alias(c) for c in own]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("count")) for c in own])).alias("x")
    ).select("x.*")
    if props:
        inner = df.select(F.explode(F.map_keys(props)).alias("k")).groupBy("k").count()
        counts = counts.unionByName(inner.select(F.concat(F.lit(f"{props}."), "k").alias("key"), "count"))
    return counts.where("count > 0")


def canonical_key(key: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.lower(key), r"[\s_]+", " "))
    slot = r"^(a|m|d|n)\s*(\d+)\s*(rscp|ecno|sc|freq|rsrp|rsrq|pci|earfcn)$"
    part = lambda i: F.regexp_extract(norm, slot, i)
    out = F.when(norm.rlike(slot), F.concat(part(1), part(2), F.lit("_"), part(3)))
    for spelled, shown in R.CANONICAL.items():
        out = out.when(norm == spelled, shown)
    return out.otherwise(key)


def canonical_metric_list(points: DataFrame, columns: Sequence[str], props: str, event: str | None = None) -> DataFrame:
    """Distinct display names of the metrics that hold a value somewhere, and of the events seen."""
    usable = [c for c in columns if c not in R.EXCLUDED_KEYS]
    own = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.lit(c)) for c in usable]
    banned = r"(?i)^(time|tech|type|lat|lng|lon|long|latitude|longitude|gps|event|message|details|radiosnapshot|rnc/cid)$"
    inner = F.transform(
        F.filter(F.map_entries(props), lambda e: e["value"].isNotNull() & (e["value"] != "") & ~e["key"].rlike(banned)),
        lambda e: e["key"],
    )
    keys = F.concat(F.array_compact(F.array(*own)), F.coalesce(inner, F.array().cast("array<string>")))
    d = points.select(F.explode(keys).alias("k")).distinct().select(canonical_key(F.col("k")).alias("metric"))
    if event:
        d = d.union(points.where(F.col(event).isNotNull()).select(event).distinct())
    return d.distinct()


def value_kind(dtype: Column, num_count: Column, str_count: Column) -> Column:
    d = F.lower(_none(dtype))
    return (
        F.when(d.rlike("int|float|double|num|decimal|long|short"), "numeric")
        .when(d.rlike("string|text|bool|enum"), "string")
        .otherwise(F.when(num_count >= str_count, "numeric").otherwise("string"))
    )


def metric_catalog(samples: DataFrame, declarations: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per metric name: counts, numeric stats, first id/type, path, tags, kind; declared names without samples too."""
    order = F.struct("ts_ms", "seq")
    has_type = "dtype" in samples.columns
    d = samples.where(_none("name") != "").where(F.col("value_num").isNotNull() | F.col("value_str").isNotNull())
    text_only = F.col("value_num").isNull()
    g = d.groupBy(*keys, "name").agg(
        F.count("*").alias("sample_count"), F.count("value_num").alias("num_count"),
        F.sum(F.when(text_only, 1).otherwise(0)).alias("str_count"), F.min("value_num").alias("min"),
        F.max("value_num").alias("max"), F.avg("value_num").alias("avg"), F.min_by("metric_id", order).alias("metric_id"),
        (F.min_by("dtype", order) if has_type else F.lit(None).cast("string")).alias("dtype"),
    )
    if declarations is not None:
        decl = declarations.select(
            *keys, "name", F.col("metric_id").alias("_id"), F.col("dtype").alias("_dtype")
        ).dropDuplicates([*keys, "name"])
        g = g.join(decl, [*keys, "name"], "full").fillna(0, ["sample_count", "num_count", "str_count"])
        g = g.withColumn("metric_id", F.coalesce("metric_id", "_id")).withColumn("dtype", F.coalesce("dtype", "_dtype")).drop("_id", "_dtype")
    tags = F.array_compact(F.array(*[F.when(F.upper("name").contains(t), t) for t in R.TAGS]))
    return (
        g.withColumn("value_kind", value_kind(F.col("dtype"), F.col("num_count"), F.col("str_count")))
        .withColumn("path_segments", F.split("name", r"\."))
        .withColumn("tags", tags)
    )


def event_catalog(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per event name: count, first and last time, sorted distinct parameter ids.

    Two steps that both combine map-side: per (name, id), where the row without id stands for the event itself, then per
    name. A frequent event never gathers more than its distinct ids in one task. Names and times may be null.
    """
    ids = F.filter(F.transform("params", lambda p: p["param_id"]), lambda x: x.isNotNull())
    rows = events.select(*keys, "event_name", "ts_ms", F.explode(F.concat(F.array(F.lit(None)), F.coalesce(F.array_distinct(ids), F.array()))).alias("_id"))
    per_id = rows.groupBy(*keys, "event_name", "_id").agg(F.count("*").alias("_n"), F.min("ts_ms").alias("_from"), F.max("ts_ms").alias("_to"))
    itself = F.col("_id").isNull()
    return per_id.groupBy(*keys, "event_name").agg(
        F.sum(F.when(itself, F.col("_n"))).alias("count"), F.min("_from").alias("first_seen"), F.max("_to").alias("last_seen"),
        F.array_sort(F.collect_list("_id")).alias("param_ids"))


def kpi_type_summary(catalog: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The metric standing for each KPI (exact spelling first, then any case) with its stats."""
    cand = [
        F.struct(F.lit(kpi).alias("kpi"), F.lit(name).alias("cand"), F.lit(i).alias("rank"))
        for kpi, names in R.KPI_CANDIDATES.items() for i, name in enumerate(names)
    ]
    d = catalog.withColumn("_c", F.explode(F.array(*cand))).where(F.lower("name") == F.lower("_c.cand"))
    rank = F.struct(F.when(F.col("name") == F.col("_c.cand"), 0).otherwise(1), F.col("_c.rank"), F.col("name"))
    best = d.groupBy(*keys, F.col("_c.kpi").alias("kpi")).agg(
        F.min_by(F.struct("name", "sample_count", "min", "max", "avg"), rank).alias("m")
    )
    return best.select(*keys, "kpi", "m.*")


def neighbor_metrics_summary(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per neighbour metric: samples and the distinct sample indexes (0..1024, so the set is bounded)."""
    d = samples.withColumn("neighbor_index", S.neighbor_metric_index("name")).where("neighbor_index is not null")
    return d.groupBy(*keys, "name", "neighbor_index", S.neighbor_metric_field("name").alias("field")).agg(
        F.count("*").alias("sample_count"),
        F.array_sort(F.collect_set(F.when(F.col("idx").between(0, 1024), F.col("idx")))).alias("sample_indexes"),
    ).withColumn("sample_index_count", F.size("sample_indexes").cast("long"))


def zero_only_series(samples: DataFrame, keys: Sequence[str] = ("run_id", "name"), value: str = "value_num") -> DataFrame:
    """Whether the only value of a series is 0 (min and max say it without counting distinct values)."""
    return samples.groupBy(*keys).agg(
        F.coalesce((F.min(value) == 0) & (F.max(value) == 0) & (F.count(value) == F.count("*")), F.lit(False)).alias("zero_only")
    )


def bounding_box(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    return points.where(ok).groupBy(*keys).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon")
    )


# ---- scheduler --------------------------------------------------------------------------------------------------------


def scheduler_samples(samples: DataFrame) -> DataFrame:
    """Samples tagged with the scheduler field(s) their name stands for; patterns run once per distinct name."""
    low = F.lower("name")
    hits = [
        F.when(F.col("name").isin(*exact) | _any([low.rlike(p) for p in patterns]), F.lit(field))
        for field, _, _, exact, patterns, _ in R.SCHEDULER_FIELDS
    ]
    names = samples.select("name").distinct().select("name", F.explode(F.array_compact(F.array(*hits))).alias("field"))
    return ordered.attach(samples.where("value_num is not null and ts_ms is not null"), names, ["name"])


def scheduler_fields(samples: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per field: metric names, sample count, gap statistics and the per-TTI flag."""
    d = scheduler_samples(samples)
    counts = d.groupBy(*keys, "field").agg(
        F.count("*").alias("sample_count"), F.array_sort(F.collect_set("name")).alias("metric_names")
    )
    gaps = series.interval_stats(d, [*keys, "field"]).drop("gap_count")
    return counts.join(gaps, [*keys, "field"], "left").fillna({"per_tti": False})


def payload_events(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Distinct names of raw layer 1/2 payload events per run."""
    low = F.lower("event_name")
    hit = low.contains("message.layer1.") | low.contains("message.layer2.") | (
        low.contains("message.") & low.rlike(r"\.(mac|rlc|phy)\.")
    )
    return events.where(hit).select(*keys, "event_name").distinct()


def scheduler_limitations(fields: DataFrame, payload: DataFrame, runs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run: whether raw payload exists, whether any field is per-TTI, and the resulting notes."""
    p = payload.groupBy(*keys).agg(F.lit(True).alias("payload_present"))
    t = fields.groupBy(*keys).agg(F.max("per_tti").alias("any_per_tti"))
    d = runs.join(p, list(keys), "left").join(t, list(keys), "left").fillna(False, ["payload_present", "any_per_tti"])
    notes = F.array_compact(F.array(
        F.when(~F.col("payload_present"), "No Layer1/Layer2 raw message payload events were found in this TRP "
               "(no Message.Layer1/Message.Layer2 stream)."),
        F.when(~F.col("any_per_tti"), "No scheduler counter was sampled at ~1 ms cadence, so exact per-TTI values are unavailable."),
    ))
    return d.withColumn("limitations", notes)


def scheduler_at_time(samples: DataFrame, times: DataFrame, window_ms: int = 2000, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Nearest value of each field around each asked time (table: keys, time_id, ts_ms)."""
    s = scheduler_samples(samples).select(*keys, "field", "ts_ms", "seq", "name", "value_num")
    fields = s.groupBy(*keys).agg(F.collect_set("field").alias("field"))
    # one anchor a time and field, so only the nearest samples of the field meet it
    asked = ordered.attach(times.select(*keys, "time_id", "ts_ms"), fields, keys, by=("ts_ms", "time_id")).withColumn("field", F.explode("field"))
    near = max(1, window_ms)
    pairs = timejoin.nearest_pairs(asked, s, [*keys, "field"], near, near).where("row is not null")
    t = F.col("row.ts_ms")
    order = F.struct(F.abs(t - F.col("ts_ms")), t, F.col("row.seq"))
    return pairs.groupBy(*keys, "time_id", "field").agg(
        F.min_by(F.struct(F.col("row.value_num").alias("value"), F.col("row.name").alias("metric"),
                          F.abs(t - F.col("ts_ms")).alias("delta_ms")), order).alias("b")
    ).select(*keys, "time_id", "field", "b.*")


# ---- signal discovery and naming ----------------------------------------------------------------------------------------


def discover_signals(names: DataFrame, keys: Sequence[str] = ("run_id",), order: str = "first_seq", max_drivers: int | None = None) -> DataFrame:
    """Throughput signals by name score (first best wins) and the driver signals by first sight.

    ``max_drivers`` keeps that many of them (24 is customary).
    """
    low = F.lower("name")
    scored = []
    for key, (exact, part, pattern) in R.THROUGHPUT_SIGNALS.items():
        score = F.when(low == exact, 100).when(low.contains(part), 70).when(low.rlike(pattern), 60)
        scored.append(F.when(score.isNotNull(), F.struct(F.lit(key).alias("key"), score.cast("long").alias("score"))))
    d = names.withColumn("_s", F.explode(F.array_compact(F.array(*scored))))
    best = d.groupBy(*keys, F.col("_s.key").alias("key")).agg(
        F.min_by(F.struct("name", F.col("_s.score").alias("score")), F.struct(-F.col("_s.score"), F.col(order))).alias("b")
    ).select(*keys, "key", "b.name", "b.score", F.lit(1).cast("long").alias("position"))
    w = Window.partitionBy(*keys).orderBy(order)
    drivers = names.where(F.col("name").rlike(R.DRIVERS)).withColumn("position", F.row_number().over(w).cast("long"))
    if max_drivers is not None:
        drivers = drivers.where(F.col("position") <= max_drivers)
    drivers = drivers.select(
        *keys, F.lit("driver").alias("key"), "name", F.lit(55).cast("long").alias("score"), "position"
    )
    source = F.when(F.col("score") == 100, "exact").otherwise("regex")
    return best.unionByName(drivers).withColumn("source", source).withColumn("confidence", F.col("score") / 100)


def registry_match(names: DataFrame, keys: Sequence[str] = (), include_disabled: bool = False, order: str = "name") -> DataFrame:
    """For each registry entry the best name: exact candidates in order, then patterns in order."""
    hits = []
    for key, _, _, _, _, _, exact, patterns, disabled in R.METRICS:
        if disabled and not include_disabled:
            continue
        rank = F
        for i, name in enumerate(exact):
            rank = rank.when(F.col("name") == name, i)
        for i, p in enumerate(patterns):
            rank = rank.when(F.col("name").rlike(f"(?i){p}"), 100 + i)
        rank = rank.otherwise(None)
        hits.append(F.when(rank.isNotNull(), F.struct(F.lit(key).alias("key"), rank.cast("long").alias("rank"))))
    d = names.withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
    best = d.groupBy(*keys, F.col("_h.key").alias("key")).agg(
        F.min_by(F.struct("name", F.col("_h.rank").alias("rank")), F.struct(F.col("_h.rank"), F.col(order))).alias("b")
    )
    return best.select(*keys, "key", "b.name", "b.rank").withColumn("matched_by", F.when(F.col("rank") < 100, "exact").otherwise("regex"))


# Rank of a metric by the first row of its technology with a word in its name; where marked, BOOST is added.
METRIC_RANKS = {
    "LTE": [(["rsrp"], 100, True), (["sinr"], 95, True), (["rsrq"], 90, True), (["mos"], 88, False), (["bler"], 75, False), (["throughput"], 70, False), (["lte", "ims"], 65, True)],
    "5G NR": [(["ss-rsrp", "ssrsrp"], 100, True), (["sinr"], 95, True), (["rsrq"], 90, True), (["mos"], 88, False), (["bler"], 75, False), (["throughput"], 70, False), (["nr", "5g", "ims"], 65, True)],
    "UMTS 3G": [(["rscp"], 100, True), (["ecno"], 95, True), (["mos"], 88, False), (["bler"], 80, False), (["tx"], 70, False), (["umts", "wcdma", "uarfcn", "psc"], 65, True)],
}
BOOST = (["mos", "volte", "ims"], 5)
# Points of a name for words it contains or (with a leading dot) ends with.
IDENTIFIER_POINTS = [
    ("radio.lte.servingcell", 50), ("radio.lte.servingsystem", 40), ("lock", -100), ("override", -100), ("controlfunction", -80), ("device", -50),
]
IDENTIFIER_ENDS = [([".pci"], 30), ([".earfcn"], 30), ([".tac"], 30), ([".cellidentity", ".cellid"], 30)]
# Points of an event for words in its name, whatever the technology and by technology.
EVENT_POINTS = [(["call", "volte", "ims", "sip"], 8), (["drop", "fail", "reject", "release"], 6)]
EVENT_POINTS_BY_TECH = {"LTE": (["lte", "enodeb", "rrc"], 4), "5G NR": (["nr", "5g", "gnodeb"], 4), "UMTS 3G": (["umts", "wcdma", "rnc"], 4)}
# Labels; the first row applies of which each group has a word in the name, and no excluded word is in it.
LABELS = [
    ("RSRP", [["rsrp"]], ["neighbor"]), ("RSRQ", [["rsrq"]], ["neighbor"]), ("SINR", [["sinr"]], []),
    ("Application throughput DL", [["data.http"], ["throughput"], ["download", "downlink"]], []), ("Application throughput UL", [["data.http"], ["throughput"], ["upload", "uplink"]], []),
    ("DL throughput", [["radio.lte.servingcell"], ["pdsch"], ["throughput"]], []), ("UL throughput", [["radio.lte.servingcell"], ["pusch"], ["throughput"]], []),
    ("DL throughput", [["downlink", "dl"], ["throughput"]], []), ("UL throughput", [["uplink", "ul"], ["throughput"]], []),
    ("DL throughput", [["throughput"], ["down"]], []), ("UL throughput", [["throughput"], ["up"]], []),
    ("Cellid", [["cellid", "cell identity", ".cell_id"]], []), ("Physical cell ID", [["physical cell id", ".pci"]], []), ("eNodeB ID", [["enodeb id", ".enodebid"]], []),
    ("Tracking area code", [["tracking area code", ".tac"]], []), ("Downlink EARFCN", [["earfcn"]], []), ("Cell ID", [[" cell id", ".cell.id"]], []),
    ("eNodeB ID", [["__derived_enodeb_id"]], []), ("Cell ID", [["__derived_cell_id"]], []),
]


def _holds(name: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased name contains one of the words."""
    return _any([F.lower(name).contains(w) for w in words])


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def metric_rank(name: Column, tech: Column) -> Column:
    """How central a metric is for a technology."""
    boost, out = _points(_holds(name, BOOST[0]), BOOST[1]), F
    for technology, rows in METRIC_RANKS.items():
        for words, rank, boosted in rows:
            out = out.when((tech == technology) & _holds(name, words), boost + rank if boosted else F.lit(rank))
    return out.otherwise(boost).cast("long")


def metric_order(names: DataFrame, tech: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Names of each run by rank for its technology, then alphabetically."""
    d = names.withColumn("rank", metric_rank(F.col("name"), tech))
    w = Window.partitionBy(*keys).orderBy(F.desc("rank"), "name")
    return d.withColumn("position", F.row_number().over(w).cast("long"))


def keyword_score(name: Column, keywords: Sequence[str], prefer: Sequence[str] = (), avoid: Sequence[str] = ()) -> Column:
    """10 per keyword, +8 per preferred word, -12 per avoided one; null without a keyword."""
    n = F.lower(name)
    one = lambda x, w: F.when(n.contains(x), w).otherwise(0)
    hits = sum([one(k, 1) for k in keywords], F.lit(0))
    score = hits * 10
    for x in prefer:
        score = score + one(x, 8)
    for x in avoid:
        score = score + one(x, -12)
    score = score + one("servingcell", 6) + one("neighbor", -10)
    return F.when((hits > 0) & (score >= 0), score.cast("long"))


# Core metrics of an LTE run; keywords, preferred and avoided words.
LTE_CORE = {
    "rsrp": (["rsrp"], ["servingcell"], ["neighbor"]),
    "rsrq": (["rsrq"], ["servingcell"], ["neighbor"]),
    "sinr": (["rs-sinr", "sinr"], ["servingcell"], ["neighbor"]),
    "dl": (["dl throughput", "downlink throughput", "throughput dl", "throughput_dl", "dl rate", "pdsch.throughput"],
           ["servingcell", "pdsch"], ["neighbor", "http download"]),
    "ul": (["ul throughput", "uplink throughput", "throughput ul", "throughput_ul", "ul rate", "pusch.throughput"],
           ["servingcell", "pusch"], ["neighbor", "http upload"]),
}


# Radio slots of other technologies; what isn't listed (throughput) is as for LTE.
CORE_BY_TECH = {
    "5G NR": LTE_CORE | {"rsrp": (["ss-rsrp", "ssrsrp", "rsrp"], ["servingcell"], ["neighbor"]), "rsrq": (["ss-rsrq", "ssrsrq", "rsrq"], ["servingcell"], ["neighbor"]),
                         "sinr": (["ss-sinr", "sinr"], [], [])},
    "UMTS 3G": LTE_CORE | {"rsrp": (["rscp", "rsrp"], [], []), "rsrq": (["ecno", "rsrq"], [], []), "sinr": (["sinr"], [], [])},
}


def core_metrics_by_tech(ordered_names: DataFrame, tech: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Core slots by the run's technology: ``slot, place, name, score``; a name that wins several slots keeps the first.

    Technologies without rules of their own, null too, are read as LTE. Partial bests meet before the shuffle, so a hot run
    costs no more than its slots.
    """
    scored = []
    for place, slot in enumerate(LTE_CORE):
        s = F
        for technology, rules in CORE_BY_TECH.items():
            s = s.when(tech == technology, keyword_score(F.col("name"), *rules[slot]))
        s = s.otherwise(keyword_score(F.col("name"), *LTE_CORE[slot]))
        scored.append(F.when(s.isNotNull(), F.struct(F.lit(place).cast("long").alias("place"), F.lit(slot).alias("slot"), s.alias("score"))))
    d = ordered_names.withColumn("_s", F.explode(F.array_compact(F.array(*scored))))
    best = d.groupBy(*keys, F.col("_s.slot").alias("slot"), F.col("_s.place").alias("place")).agg(
        F.min_by(F.struct("name", F.col("_s.score").alias("score")), F.struct(-F.col("_s.score"), F.col("position"))).alias("b"))
    return best.select(*keys, "slot", "place", "b.*").groupBy(*keys, "name").agg(F.min_by(F.struct("slot", "place", "score"), "place").alias("b")).select(
        *keys, "b.slot", "b.place", "name", "b.score")


def core_metrics(ordered_names: DataFrame, keys: Sequence[str] = ("run_id",), rules: Mapping = LTE_CORE) -> DataFrame:
    """The best-scoring name per core slot; on equal scores the earlier one in ``position``."""
    scored = []
    for slot, (kw, pre, avoid) in rules.items():
        s = keyword_score(F.col("name"), kw, pre, avoid)
        scored.append(F.when(s.isNotNull(), F.struct(F.lit(slot).alias("slot"), s.alias("score"))))
    d = ordered_names.withColumn("_s", F.explode(F.array_compact(F.array(*scored))))
    return d.groupBy(*keys, F.col("_s.slot").alias("slot")).agg(
        F.min_by(F.struct("name", F.col("_s.score").alias("score")), F.struct(-F.col("_s.score"), F.col("position"))).alias("b")
    ).select(*keys, "slot", "b.name", "b.score")


def identifier_score(name: Column) -> Column:
    """How likely a name is that of the serving cell's identifier."""
    score = F.lit(0)
    for word, points in IDENTIFIER_POINTS:
        score = score + _points(_holds(name, [word]), points)
    for ends, points in IDENTIFIER_ENDS:
        score = score + _points(_any([F.lower(name).endswith(e) for e in ends]), points)
    return score.cast("long")


def app_throughput_score(name: Column) -> Column:
    """Score of an application throughput name, null for others; direction in :func:`app_direction`."""
    n = F.lower(name)
    w = lambda x, v: F.when(n.contains(x), v).otherwise(0)
    score = w("data.http", 80) + w("http", 30) + w("throughput", 20) + 25 + w("application", 10)
    return F.when(n.contains("throughput") & n.contains("http") & app_direction(name).isNotNull(), score.cast("long"))


def app_direction(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("download") | n.contains("downlink"), "dl").when(n.contains("upload") | n.contains("uplink"), "ul")


def event_score(name: Column, tech: Column) -> Column:
    """How telling an event is for a technology."""
    score = F.lit(0)
    for words, points in EVENT_POINTS:
        score = score + _points(_holds(name, words), points)
    for technology, (words, points) in EVENT_POINTS_BY_TECH.items():
        score = score + _points((tech == technology) & _holds(name, words), points)
    return score.cast("long")


def friendly_label(name: Column) -> Column:
    """Short label of a metric name; null where no row applies."""
    out = F
    for label, groups, excluded in LABELS:
        applies = F.lit(True)
        for words in groups:
            applies = applies & _holds(name, words)
        out = out.when(applies & ~_holds(name, excluded) if excluded else applies, label)
    return out.otherwise(None)


def default_metrics(names: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Alphabetically first metric containing rsrp / sinr / mos, else the first metric of the run."""
    low = F.lower("name")
    agg = [
        F.coalesce(F.min_by("name", F.when(low.contains(w), low)), F.min_by("name", low)).alias(f"{w}_metric")
        for w in ("rsrp", "sinr", "mos")
    ]
    return names.groupBy(*keys).agg(*agg)


def run_technology(names: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Technology of a run from its metric and event names (column ``name``; ``is_event`` rows only count as text)."""
    n = F.lower("name")
    has = lambda *xs: _any([n.contains(x) for x in xs])
    metric = ~F.col("is_event")
    one = lambda c: F.sum(F.when(metric & c, 1).otherwise(0))
    seen = lambda p: F.max(n.rlike(p).cast("int"))
    g = names.groupBy(*keys).agg(
        F.max(n.contains(".lte.").cast("int")).alias("_short"),
        (seen("rsrp|rsrq|sinr|enodeb|volte|ims") * 4 + one(has("rsrp", "rsrq", "sinr", "volte", "ims"))).alias("_lte"),
        (seen("5g|ss-rsrp|ssrsrp|ss-sinr|gnodeb") * 4 + one(has("ss-rsrp", "ssrsrp", "ss-sinr", "nr"))).alias("_nr"),
        (seen("umts|wcdma|rscp|ecno|uarfcn|psc") * 4 + one(has("rscp", "ecno", "umts", "wcdma"))).alias("_umts"),
    )
    top = F.greatest("_lte", "_nr", "_umts")
    tech = (
        F.when(F.col("_short") == 1, "LTE").when(top <= 0, "TRP").when(F.col("_lte") == top, "LTE")
        .when(F.col("_nr") == top, "5G NR").otherwise("UMTS 3G")
    )
    return g.select(*keys, tech.alias("tech"))


def detect_technology(
    points: DataFrame, keys: Sequence[str] = ("log_id",), freq: str = "freq", first: int | None = None, tabular: bool = False,
    level_column: str | None = None,
) -> DataFrame:
    """Technology of a log from the frequencies of its points, or of its ``first`` ones (50 is customary)."""
    d = points if first is None else first_k(points, keys, first, "ts_ms", "seq")
    f = F.when(F.col(freq) > 0, F.col(freq))
    umts = f.between(10500, 10900) | f.between(2900, 3100) | f.between(4300, 4500)
    g = d.groupBy(*keys).agg(
        F.max(umts.cast("int")).alias("_3g"), F.avg(f).alias("_avg"), F.min(f).alias("_min"), F.max(f).alias("_max")
    )
    if tabular:
        low = (level_column or "").lower()
        guess = "3G (Excel)" if "rscp" in low and "rsrp" not in low else "4G (Excel)"
        tech = (
            F.when(F.col("_avg").isNull(), guess).when(F.col("_3g") == 1, "3G (Excel)").when(F.col("_min") < 1000, "2G (Excel)")
            .when(F.col("_max") > 120000, "5G (NR)").otherwise("4G (Excel)")
        )
    else:
        tech = (
            F.when(F.col("_avg").isNull(), "Unknown").when(F.col("_3g") == 1, "3G (UMTS)").when(F.col("_avg") < 1000, "2G (GSM)")
            .when(F.col("_avg") > 120000, "5G (NR)").otherwise("4G (LTE)")
        )
    return g.select(*keys, tech.alias("tech"))


# ---- legends ----------------------------------------------------------------------------------------------------------


def number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def legend_bins(
    series_df: DataFrame, keys: Sequence[str] = ("key",), value: str = "value_num", top: int | None = None, min_values: int = 10,
) -> DataFrame:
    """Legend rows (key, position, min, max, label, source): preset, dynamic categories, percentile bins, or one bin.

    Unbounded ends are null. ``top`` keeps the most frequent categories (8 is customary); percentiles need ``min_values`` values.
    """
    key = keys[-1]
    d = series.numeric_only(series_df, value)
    row = lambda i, lo, hi, label: F.struct(
        F.lit(i).cast("long").alias("position"),
        (F.lit(lo) if not isinstance(lo, Column) else lo).cast("double").alias("min"),
        (F.lit(hi) if not isinstance(hi, Column) else hi).cast("double").alias("max"), F.lit(label).alias("label"))
    preset = F
    for k, bins in R.LEGEND_BINS.items():
        preset = preset.when(F.col(key) == k, F.array(*[row(i, lo, hi, t) for i, (lo, hi, t) in enumerate(bins)]))
    for k, cats in R.LEGEND_CATEGORIES.items():
        preset = preset.when(F.col(key) == k, F.array(*[row(i, None, None, t) for i, (_, t) in enumerate(cats)]))
    is_dynamic = F.col(key).isin(*R.LEGEND_DYNAMIC)
    # dynamic: most frequent values, first seen first on a tie
    freq = d.where(is_dynamic).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.min(F.struct("ts_ms", "seq")).alias("_f"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_c"), F.col("_f"))
    dyn = freq.withColumn("position", F.row_number().over(w).cast("long") - 1)
    if top is not None:
        dyn = dyn.where(F.col("position") < top)
    dyn = dyn.select(
        *keys, "position", F.col(value).cast("double").alias("min"), F.col(value).cast("double").alias("max"),
        number_text(F.col(value)).alias("label"), F.lit("dynamic").alias("source"),
    )
    ranks = {f"p{p}": quantiles.floor_index(p / 100) for p in (10, 30, 70, 90)}
    stats = quantiles.pick_ranks(d.where(~is_dynamic), keys, value, ranks)
    auto = F.when(F.col("n") >= min_values, F.array(
        row(0, None, F.col("p10"), "Very Low"), row(1, F.col("p10"), F.col("p30"), "Low"), row(2, F.col("p30"), F.col("p70"), "Medium"),
        row(3, F.col("p70"), F.col("p90"), "High"), row(4, F.col("p90"), None, "Very High"),
    )).otherwise(F.array(row(0, None, None, "All values")))
    fixed = stats.select(
        *keys, F.explode(F.coalesce(preset.otherwise(None), auto)).alias("b"),
        F.when(preset.otherwise(None).isNotNull(), "preset").when(F.col("n") >= min_values, "auto_percentile").otherwise("auto_flat").alias("source"),
    ).select(*keys, "b.*", "source")
    return fixed.unionByName(dyn)


def legend_stats(series_df: DataFrame, keys: Sequence[str] = ("key",), value: str = "value_num") -> DataFrame:
    """min, max and upper median that go with a legend."""
    ranks = {"min": lambda n: F.lit(1), "median": quantiles.upper_median(), "max": lambda n: n}
    return quantiles.pick_ranks(series_df, keys, value, ranks)


def classify_to_legend(df: DataFrame, legend: DataFrame, keys: Sequence[str] = ("key",), value: str = "value_num") -> DataFrame:
    """Label of each value: the first bin that holds it (ends included), else the last bin.

    A legend has a handful of rows per key: they are folded to one array per key and joined once.
    """
    arr = legend.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "min", "max", "label"))).alias("_bins"))
    inside = lambda b: (F.col(value) >= F.coalesce(b["min"], F.lit(float("-inf")))) & (
        F.col(value) <= F.coalesce(b["max"], F.lit(float("inf"))))
    hit = F.filter("_bins", inside)
    label = F.when(F.size(hit) > 0, hit[0]["label"]).otherwise(F.element_at("_bins", -1)["label"])
    return df.join(arr, list(keys), "left").withColumn("label", label).drop("_bins")


def threshold_label(value: Column, which: str = "level") -> Column:
    out = F
    for lo, hi, label in R.THRESHOLDS[which]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (value > lo)
        if hi is not None:
            cond = cond & (value <= hi)
        out = out.when(cond, label)
    return F.when(value.isNotNull(), out.otherwise(None))


def threshold_distribution(points: DataFrame, value: str, which: str | None = "level", keys: Sequence[str] = ()) -> DataFrame:
    """Points per threshold label; with ``which=None`` per identity value."""
    label = threshold_label(F.col(value), which) if which else F.col(value).cast("string")
    d = points.select(*keys, label.alias("label")).where("label is not null")
    return d.groupBy(*keys, "label").agg(F.count("*").alias("points"))


# ---- run information --------------------------------------------------------------------------------------------------

_SCELL = "Radio.Lte.ServingCell[8]"
_TAC_METRICS = ["Radio.Lte.ServingSystem.Tac", f"{_SCELL}.TrackingAreaCode", f"{_SCELL}.Tac",
                "Radio.Lte.ServingCellTotal.TrackingAreaCode", "Radio.Lte.ServingCellTotal.Tac"]


def _usable(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "n/a", "na", "nan", "-", "unknown", "none", "null", "undefined"), t)


def ca_label(max_carriers: Column, combos: Column, shown: int | None = None) -> Column:
    """Carrier-aggregation label: band combinations, number of carriers; beyond ``shown`` combinations (4 is customary) "(+n more)"."""
    n = F.size(combos)
    listed, more = combos, F.lit("")
    if shown is not None:
        listed = F.slice(combos, 1, shown)
        more = F.when(n > shown, F.concat(F.lit(" (+"), (n - shown).cast("string"), F.lit(" more)"))).otherwise("")
    part = F.when(n > 0, F.concat(F.lit("band combos: "), F.array_join(listed, ", "), more))
    carriers = F.when(max_carriers >= 2, F.concat(F.lit("MaxNumCarriers="), max_carriers.cast("string")))
    inner = F.when(part.isNotNull() | carriers.isNotNull(), F.concat_ws("; ", part, carriers))
    return F.concat(F.lit("CA capable ("), inner, F.lit(")"))


def run_info(samples: DataFrame, events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """UE category, MIMO and CA capability, TAC of each run: decoded messages first, KPI fallbacks second."""
    keys = list(keys)
    name, text = F.lower("event_name"), lambda p: S.param_ci("params", p)
    once = lambda value: F.explode_outer(F.array(value))  # noqa: E731  (a filter on what is read isn't pushed below a generator and computed again there)
    # capability messages
    summary = F.coalesce(text("ue_cap_info_summary"), text("rrc_message_summary"))
    js = lambda k: F.get_json_object("_sum", f"$.{k}")
    asked = ("ueCategoryLabel", "ueCategory", "mimoCapability", "maxNumCarriers", "supportedBandCombinations", "caCapability")
    read = lambda k: F.col(f"_read.{k}")
    combos = F.coalesce(F.from_json(read("supportedBandCombinations"), "array<string>"), F.array().cast("array<string>"))
    cat_no = read("ueCategory").try_cast("long")
    found = F.struct(
        F.coalesce(_usable(read("ueCategoryLabel")), F.when(cat_no.between(1, 64), F.concat(F.lit("Cat "), cat_no.cast("string")))).alias("cat"),
        _usable(read("mimoCapability")).alias("mimo"),
        F.coalesce(ca_label(read("maxNumCarriers").try_cast("long"), combos), _usable(read("caCapability"))).alias("ca"))
    cap = (
        events.where(name.contains("uecapabilityinformation")).withColumn("_sum", once(summary)).where("_sum is not null")
        .select(*keys, "ts_ms", "seq", once(F.struct(*[js(k).alias(k) for k in asked])).alias("_read"))
        .select(*keys, "ts_ms", "seq", once(found).alias("_found")).select(*keys, "ts_ms", "seq", "_found.*")
        .withColumn("score", sum([F.col(c).isNotNull().cast("int") for c in ("mimo", "ca")], F.col("cat").isNotNull().cast("int")))
        .where("score > 0")
        .groupBy(*keys)
        .agg(F.max_by(F.struct("cat", "mimo", "ca", "ts_ms"), F.struct("score", "ts_ms", -F.col("seq"))).alias("cap"))
    )
    # tracking area from system information
    places = F.array(
        text("sib1_tac"), text("trackingAreaCode"), *[F.get_json_object(text(p), "$.trackingAreaCode") for p in ("sib1_summary", "rrc_message_summary")])
    is_sib1 = name.contains("systeminformationblocktype1") | name.contains("sib1") | (F.lower(text("rrc_message_id")) == "sib1")
    told = F.transform(F.filter(places, lambda x: x.isNotNull()), lambda x: S.once(F.upper(F.trim(x)), S.parse_tac))
    tac = F.try_element_at(F.filter(told, lambda x: x.isNotNull()), F.lit(1))
    sib = events.where(is_sib1).select(*keys, "ts_ms", "seq", once(tac).alias("_tac")).where("_tac is not null").groupBy(*keys).agg(
        F.max_by("_tac", F.struct("ts_ms", "seq")).alias("sib_tac")
    )
    # KPI fallbacks
    latest = lambda m: F.max_by("value_num", F.when((F.col("name") == m) & F.col("value_num").isNotNull(), F.struct("ts_ms", "seq")))
    top = lambda r: F.coalesce(F.max(F.when(F.col("name") == f"{_SCELL}.Rank{r}.FeedbackCount", F.col("value_num"))), F.lit(0.0))
    kpi = samples.groupBy(*keys).agg(
        latest("Pocket.General.Device.MaxNumCarriers").cast("long").alias("carriers"),
        latest("Radio.Lte.ServingSystem.MimoEnabled").alias("mimo_on"), *[top(r).alias(f"rank{r}") for r in (2, 3, 4)],
    )
    place = F
    for i, m in enumerate(_TAC_METRICS):
        place = place.when(F.col("name") == m, i)
    counted = samples.where(F.col("name").isin(*_TAC_METRICS) & F.col("value_num").isNotNull()).groupBy(
        *keys, place.otherwise(None).alias("_place"), F.col("value_num").cast("long").alias("_v")
    ).agg(F.count("*").alias("_c"))
    mode = counted.groupBy(*keys, "_place").agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias("_v"))
    kpi_tac = mode.where("_v <> 0").groupBy(*keys).agg(F.min_by("_v", "_place").alias("kpi_tac"))

    d = kpi.join(cap, keys, "full").join(sib, keys, "left").join(kpi_tac, keys, "left")
    r2, r3, r4, n = F.col("rank2"), F.col("rank3"), F.col("rank4"), F.col("carriers")
    mimo_inf = (
        F.when(r4 > 0, "4x4 capable (inferred from Rank4 feedback)")
        .when((r3 > 0) | (r2 > 0), "2x2 capable (inferred from rank feedback)")
        .when(F.abs(F.col("mimo_on")) >= 1, "MIMO enabled (inferred)")
    )
    cat_inf = (
        F.when((n >= 2) & (r4 > 0), "Cat 6+ (inferred from CA + Rank4 feedback)").when(n >= 2, "Cat 6+ (inferred from CA capability)")
        .when(r4 > 0, "Cat 5+ (inferred from Rank4 feedback)").when((r2 > 0) | (r3 > 0), "Cat 4+ (inferred from rank feedback)")
    )
    ca_inf = F.when(n >= 2, F.concat(F.lit("CA capable (MaxNumCarriers="), n.cast("string"), F.lit(")")))
    return d.select(
        *keys, F.col("cap.cat").alias("ue_category"), F.col("cap.mimo").alias("mimo_capability"),
        F.col("cap.ca").alias("ca_capability"), F.col("cap.ts_ms").alias("ue_capability_ts"),
        F.when(F.col("cap.cat").isNull(), cat_inf).alias("ue_category_inferred"),
        F.when(F.col("cap.mimo").isNull(), mimo_inf).alias("mimo_capability_inferred"),
        F.when(F.col("cap.ca").isNull(), ca_inf).alias("ca_capability_inferred"),
        F.coalesce("sib_tac", "kpi_tac").alias("tac"), F.when(F.col("sib_tac").isNotNull(), "decoded_sib1").alias("tac_source"),
    )


_NEIGHBOR_EARFCN = ["radio.lte.neighbor[64].earfcn", "radio.lte.neighbor[64].frequency"]


def serving_earfcns(samples: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    low = F.lower("name")
    hit = low.contains("radio.lte.servingcell") & low.contains("earfcn") & ~low.contains("neighbor")
    return samples.where(hit & F.col("value_num").isNotNull()).select(*keys, F.col("value_num").cast("long").alias("earfcn")).distinct()


def earfcn_scale(samples: DataFrame, keys: Sequence[str] = ("run_id",), distinct: bool = False) -> DataFrame:
    """1 or 2: whether neighbour EARFCNs are doubled, judged by hits in the serving set or by size and parity."""
    keys = list(keys)
    raw = (
        samples.where(F.lower("name").isin(*_NEIGHBOR_EARFCN) & F.col("value_num").isNotNull())
        .groupBy(*keys, F.col("value_num").cast("long").alias("v"))
        .agg((F.lit(1).cast("long") if distinct else F.count("*")).alias("c"))
    )
    serving = serving_earfcns(samples, keys)
    raw = raw.join(serving.select(*keys, F.col("earfcn").alias("v"), F.lit(True).alias("raw_hit")), [*keys, "v"], "left")
    half = serving.select(*keys, (F.col("earfcn") * 2).alias("v"), F.lit(True).alias("half_hit"))
    raw = raw.join(half, [*keys, "v"], "left")
    even = F.col("v") % 2 == 0
    g = raw.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.when(even, F.col("c")).otherwise(0)).alias("n_even"),
        F.sum(F.when(F.col("raw_hit"), F.col("c")).otherwise(0)).alias("raw_hits"),
        F.sum(F.when(even & F.col("half_hit"), F.col("c")).otherwise(0)).alias("half_hits"), F.max("v").alias("raw_max"),
    )
    doubled = (F.col("half_hits") > F.col("raw_hits")) | ((F.col("raw_max") >= 10000) & (F.col("n_even") / F.col("n") >= 0.8))
    out = samples.select(*keys).distinct().join(g, keys, "left")
    return out.withColumn("scale_div", F.when(doubled, 2).otherwise(1).cast("long"))


# ---- paging and small relational pieces ---------------------------------------------------------------------------------


def page(df: DataFrame, keys: Sequence[str], number: int = 1, size: int = 100) -> DataFrame:
    """One page of each key's rows in time order."""
    number, size = max(1, number), max(1, size)
    lo = (number - 1) * size
    d = ordered.with_row_number(df, keys, "row_no")
    return d.where((F.col("row_no") > lo) & (F.col("row_no") <= lo + size))


def first_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str) -> DataFrame:
    """Top k per key; Spark cuts each task's groups to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def overwrite_merge(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keyed union of layers in which a later layer replaces an earlier row of the same key."""
    both = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("_layer", F.lit(i))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_layer"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_layer").alias("r")).select(*keys, "r.*")


def drop_serving(neighbors: DataFrame, pci: str = "pci", freq: str = "earfcn", s_pci: str = "serving_pci", s_freq: str = "serving_earfcn") -> DataFrame:
    """Neighbours that are not the serving cell; an unknown frequency on either side counts as equal."""
    same_freq = F.col(freq).isNull() | F.col(s_freq).isNull() | (F.col(freq) == F.col(s_freq))
    return neighbors.where(~F.coalesce((F.col(pci) == F.col(s_pci)) & same_freq, F.lit(False)))
