"""Column resolution for exports of unknown shape, and normalisation to points and events."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.functions import scalars as S


def header_key(name: str) -> str:
    return re.sub(r"[\s_.]", "", name.lower())


# Words of a header that is certainly the serving cell's; words that hold "as" without meaning the active set.
SERVING_WORDS = ["serving", "bestactive"]
HARMLESS_WORDS = ["meas", "class", "phase", "pass", "alias"]


NUMBERED_NEIGHBOR = re.compile(r"\bn\d")


def is_other_cell(key: str, words: Sequence[str] = ()) -> bool:
    """Does a header name a cell other than the serving one? The words are those of other cells for the field in question."""
    holds = lambda texts: any(t in key for t in texts)
    about_active_set = holds(["as"]) and not holds(HARMLESS_WORDS)
    about_others = about_active_set or holds(words) or NUMBERED_NEIGHBOR.search(key) is not None
    return about_others and not holds(SERVING_WORDS)


def resolve_column(columns: Sequence[str], candidates: Sequence[str], exclusions: Sequence[str] = ()) -> str | None:
    """The column of the best match: by rank of the candidate, equality before containment, place. Runs once a header."""
    open_keys = [(place, header_key(c)) for place, c in enumerate(columns) if not is_other_cell(header_key(c), exclusions)]
    for candidate in candidates:
        spellings = {candidate, header_key(candidate)}
        equal = [place for place, key in open_keys if key in spellings]
        holding = [place for place, key in open_keys if candidate in key]
        if equal or holding:
            return columns[(equal or holding)[0]]
    return None


# Candidate headers of the primary columns, and words that disqualify a header.
_NB = ["active", "set", "neighbor"]
PRIMARY = {
    "sc": (["servingcellsc", "servingsc", "primarysc", "primarypci", "dl_pci", "dl_sc", "bestsc", "bestpci", "sc", "pci", "psc", "scramblingcode", "physicalcellid",
            "physicalcellidentity", "phycellid"], [*_NB, "target", "candidate"]),
    "level": (["servingcellrsrp", "servingrsrp", "rsrp", "bestactiverscp", "rscp", "level"], _NB),
    "ecno": (["servingcellrsrq", "servingrsrq", "rsrq", "bestactiveec/n0", "bestactiveecn0", "bestecno", "ecno", "sinr"], _NB),
    "freq": (["servingcelldlearfcn", "earfcn", "uarfcn", "freq", "channel", "ch"], _NB),
    "band": (["band"], _NB),
    "cell_id": (["enodeb id-cell id", "enodebid-cellid", "nodeb id-cell id", "cellid", "ci", "cid", "cell_id", "identity"], [*_NB, "target"]),
    "throughput_dl": (["averagedlthroughput", "dlthroughput", "downlinkthroughput"], []),
    "throughput_ul": (["averageulthroughput", "ulthroughput", "uplinkthroughput"], []),
}


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    """Column per primary field, with time and position."""
    def first(strict: str, loose: str) -> str | None:
        return next((c for c in columns if re.match(strict, header_key(c)) or re.search(loose, header_key(c))), None)

    out = {k: resolve_column(columns, cand, excl) for k, (cand, excl) in PRIMARY.items()}
    out["time"] = first(r"^(time|timestamp|date|datetime)$", "time")
    out["lat"] = first(r"^(lat|latitude|ycoord|y|cgpslat|cgpslatitude)$", "latitude")
    out["lon"] = first(r"^(lon|long|longitude|lng|xcoord|x|cgpslon|cgpslongitude)$", "longitude")
    return {k: v for k, v in out.items() if v}


def time_text(value: Column) -> Column:
    """Time as text; a serial date or a day fraction becomes HH:MM:SS.mmm."""
    t = F.trim(value.cast("string"))
    n = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))
    ms = F.floor(F.pmod(n, F.lit(1.0)) * S.DAY_MS + 0.5)
    serial = ((n > 20000) & (n < 90000)) | ((n >= 0) & (n < 1))
    return F.when(serial, S.format_ms_of_day(ms)).when((t != "") & t.isNotNull(), t)


_SLOT = re.compile(r"^([amnd])(\d+)(sc|psc|pci|identity|rscp|rsrp|ecno|rsrq|freq|uarfcn|earfcn|rxlev|rxqual)$")
_FIELD = {"sc": "pci", "psc": "pci", "pci": "pci", "identity": "pci", "rscp": "rsrp", "rsrp": "rsrp", "rxlev": "rsrp", "ecno": "rsrq", "rsrq": "rsrq", "rxqual": "rsrq",
          "freq": "earfcn", "uarfcn": "earfcn", "earfcn": "earfcn"}


def neighbor_columns(columns: Sequence[str]) -> dict[tuple[str, str], dict[str, str]]:
    """Neighbour slots found in the headers: (label, technology) to field to column."""
    slots: dict[tuple[str, str], dict[str, str]] = {}
    for c in columns:
        key = re.sub(r"^(lte|4g|3g|umts|wcdma|2g|gsm|gprs)", "", header_key(c))
        m = _SLOT.match(key)
        if not m or int(m[2]) < 1:
            continue
        prefix = c.strip().lower()
        rat = "E-UTRA" if re.match(r"(lte|4g)\s", prefix) else "UTRA" if re.match(r"(3g|umts|wcdma)\s", prefix) else "GSM" if re.match(r"(2g|gsm|gprs)\s", prefix) else None
        rat = rat or ("GSM" if m[3] in ("rxlev", "rxqual") else "E-UTRA" if m[3] == "earfcn" else "UTRA")
        slots.setdefault((f"{m[1].upper()}{m[2]}", rat), {})[_FIELD[m[3]]] = c
    return slots


_SLOT_FIELDS = {"pci": "long", "earfcn": "long", "rsrp": "double", "rsrq": "double"}


def _as_points(df: DataFrame, keep: Sequence[Column], text: Callable[[str], Column], neighbors: Column) -> DataFrame:
    """Points of raw fields; ``text`` gives the raw value of a primary field, null where a row has none."""
    number = lambda f: S.to_number(text(f), decimal_comma=True)
    cell = text("cell_id").cast("string")
    halves = [F.regexp_extract(cell, r"^\s*(\d+)\s*/\s*(\d+)\s*$", i) for i in (1, 2)]
    long_id = F.when(~cell.contains("/"), F.regexp_extract(cell, r"^\s*(\d+)", 1).try_cast("long"))
    d = df.select(
        *keep, number("lat").alias("lat"), number("lon").alias("lon"), time_text(text("time")).alias("time"), number("level").alias("level"),
        number("ecno").alias("ecno"), number("sc").cast("long").alias("sc"), number("freq").alias("freq"), text("band").cast("string").alias("band"), cell.alias("cell_id"),
        F.when(halves[0] != "", halves[0].try_cast("long")).when(long_id > 65535, S.long_cid_rnc(long_id)).alias("rnc"),
        F.when(halves[1] != "", halves[1].try_cast("long")).when(long_id > 65535, S.long_cid_cell(long_id)).otherwise(long_id).alias("cid"),
        (number("throughput_dl") * 1000).alias("throughput_dl"), (number("throughput_ul") * 1000).alias("throughput_ul"),
        F.filter(neighbors, lambda n: n["pci"].isNotNull() | n["earfcn"].isNotNull()).alias("neighbors"))
    return d.where((F.col("lat").isNotNull() & F.col("lon").isNotNull()) | F.col("time").isNotNull())


def _slot(role: Column, rat: Column, text: Callable[[str], Column]) -> Column:
    values = [S.to_number(text(f), True).cast(t).alias(f) for f, t in _SLOT_FIELDS.items()]
    return F.struct(role.alias("role"), rat.alias("rat"), *values)


def tabular_points(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Export rows to points: primary fields, RNC/CID, throughput in kbps, neighbours; rows need a position or a time."""
    cols = resolve_columns([c for c in df.columns if c not in keep])
    raw = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    slots = [_slot(F.lit(label), F.lit(rat), lambda x, f=f: raw(f.get(x))) for (label, rat), f in neighbor_columns(df.columns).items()]
    none = F.array().cast("array<struct<role:string,rat:string,pci:bigint,earfcn:bigint,rsrp:double,rsrq:double>>")
    return _as_points(df, [raw(c).alias(c) for c in keep], lambda f: raw(cols.get(f)), F.array(*slots) if slots else none)


#: What a header says: the place of each field (kept columns as ``keep <name>``), and the places of each neighbour's fields.
PLACES = "fields map<string,int>, slots array<struct<role:string,rat:string,pci:int,earfcn:int,rsrp:int,rsrq:int>>"


def header_places(names: Sequence[str | None], keep: Sequence[str] = ()) -> dict:
    """``PLACES`` of one header row; of columns with the same name the first counts."""
    names = [(n or "").strip() for n in names]
    place = {n: i for i, n in reversed(list(enumerate(names)))}
    fields = {f: place[c] for f, c in resolve_columns([n for n in names if n not in keep]).items()}
    fields |= {f"keep {k}": place[k] for k in keep if k in place}
    slots = [{"role": label, "rat": rat, **{x: place[f[x]] if x in f else None for x in _SLOT_FIELDS}} for (label, rat), f in neighbor_columns(names).items()]
    return {"fields": fields, "slots": slots}


def positional_points(df: DataFrame, keep: Sequence[str] = (), parts: str = "parts", places: str = "places") -> DataFrame:
    """Rows of split fields to points, each row by the ``places`` of its own file's header; see ``tabular_points``."""
    def at(place: Column) -> Column:
        value = F.get(F.col(parts), place)
        return F.when(F.trim(value) != "", value)

    text = lambda f: at(F.try_element_at(F.col(places)["fields"], F.lit(f)))
    slots = F.transform(F.col(places)["slots"], lambda s: _slot(s["role"], s["rat"], lambda f: at(s[f])))
    return _as_points(df, [text(f"keep {k}").alias(k) for k in keep], text, slots)


# Spellings per field of points and events, first usable value counts.
ALIASES = {
    "time": ["ts", "timestamp", "time", "Time"], "lat": ["lat", "latitude", "Latitude"], "lon": ["lon", "lng", "longitude", "Longitude", "Lng"],
    "tech": ["technology", "tech", "Tech"], "pci": ["serving_pci", "pci", "Physical cell ID", "Serving PCI", "Serving SC", "SC"],
    "earfcn": ["serving_earfcn", "earfcn", "Downlink EARFCN", "Serving EARFCN", "Serving Freq", "EARFCN", "Freq"],
    "eci": ["serving_ecgi", "serving_eci", "eci", "ecgi", "Cell ID", "Cellid"],
    "name": ["serving_cell_name", "Serving cell name", "Serving Cell Name", "Cell Name", "cellName", "siteName", "name"],
    "rsrp": ["serving_rsrp", "rsrp", "Serving RSRP", "RSRP"], "rsrq": ["serving_rsrq", "rsrq", "Serving RSRQ", "RSRQ"],
    "sinr": ["serving_sinr", "sinr", "Serving SINR", "SINR"], "band": ["serving_band", "band", "Serving Band", "Band"],
    "a3_offset": ["a3_offset", "A3 offset", "A3 Offset", "rrc_recfg_a3_offset_db"], "a2_threshold": ["a2_threshold", "A2 threshold", "A2 Threshold", "rrc_recfg_a2_threshold_dbm"],
    "a4_threshold": ["a4_threshold", "A4 threshold", "A4 Threshold", "rrc_recfg_a4_threshold_dbm"],
    "a5_threshold1": ["a5_threshold1", "A5 serving threshold", "A5 Threshold1", "rrc_recfg_a5_serving_threshold_est_dbm"],
    "a5_threshold2": ["a5_threshold2", "A5 neighbor threshold", "A5 Threshold2", "rrc_recfg_a5_neighbor_threshold_est_dbm"],
    "ttt_ms": ["ttt_ms", "HO TTT", "Time-to-Trigger", "Time To Trigger", "rrc_recfg_ttt_ms"],
    "hysteresis_db": ["hysteresis", "HO hysteresis", "Hysteresis", "rrc_recfg_hysteresis_db"], "serving_cio": ["source_cio", "serving_cio", "Serving CIO", "CIO serving"],
    "target_cio": ["target_cio", "Target CIO", "CIO target"], "measurement_gap": ["measurement_gap_configured", "Measurement Gap Configured", "measurement_gap"],
    "l3_filter_coeff": ["l3_filter_coefficient", "L3 Filter Coefficient", "L3 filter coefficient"],
    "session_active": ["session_active", "Session Active", "Data Session Active"], "volte_call_active": ["volte_call_active", "VoLTE Call Active", "IMS Call Active"],
    "kind": ["event_type", "event", "Event", "message_type", "message", "Message", "type", "Type"], "subtype": ["subtype", "Subtype", "kind", "Kind"],
    "src_pci": ["HO source PCI", "rrc_recfg_src_pci", "Serving PCI"], "src_earfcn": ["HO source EARFCN", "rrc_recfg_src_earfcn", "Serving EARFCN"],
    "tgt_pci": ["HO target PCI", "rrc_recfg_tgt_pci", "Target PCI"], "tgt_earfcn": ["HO target EARFCN", "rrc_recfg_tgt_earfcn", "Target EARFCN"],
    "a3_json": ["measurement_report_a3_eval_json"],
}


Lookup = Callable[[str], Column]


def aliased(df: DataFrame, names: Sequence[str], props: str | None = None, lookup: Lookup | None = None) -> Column:
    """First usable value among the spellings: own columns (any case), then the property map (any case), read by ``lookup`` if given."""
    picks = []
    by_low = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        c = n if n in df.columns else by_low.get(n.lower())
        if c and c != props:
            t = F.col(f"`{c}`").cast("string")
            picks.append(F.when(F.trim(t) != "", t))
    def from_props(name: str) -> Column:
        hit = F.filter(F.map_entries(props), lambda e: (F.lower(e["key"]) == name.lower()) & (F.trim(e["value"]) != ""))
        return F.try_element_at(hit, F.lit(1))["value"]

    if props:
        picks += [(lookup or from_props)(n) for n in names]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def _with_properties(props: str | None, body: Callable[[Lookup | None], Column]) -> Column:
    """``body(lookup)``, where ``lookup`` finds usable values in a property map whose keys are lowered once a row."""
    if not props:
        return body(None)
    usable = F.filter(F.map_entries(props), lambda e: F.trim(e["value"]) != "")
    split = S.once(usable, lambda es: F.struct(F.transform(es, lambda e: F.lower(e["key"])).alias("keys"), F.transform(es, lambda e: e["value"]).alias("texts")))

    def at(found: Column) -> Lookup:
        return lambda name: F.get(found["texts"], F.array_position(found["keys"], name.lower()).cast("int") - 1)

    return S.once(split, lambda found: body(at(found)))


_LONG = ("pci", "earfcn")
_TEXT = ("eci", "name", "band")
_BOOL = ("measurement_gap", "session_active", "volte_call_active")


def normalize_points(df: DataFrame, keys: Sequence[str] = ("log_id", "device_id", "seq"), props: str | None = None, mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of any spelling to points with typed serving, configuration and neighbour columns; rows without time are dropped."""
    m = {**ALIASES, **(mapping or {})}
    get = lambda f: F.col(f"_t.{f}")
    fields = ["pci", "earfcn", "eci", "name", "rsrp", "rsrq", "sinr", "band", "a2_threshold", "a3_offset", "a4_threshold", "a5_threshold1", "a5_threshold2", "ttt_ms",
              "hysteresis_db", "serving_cio", "target_cio", "measurement_gap", "l3_filter_coeff", "session_active", "volte_call_active"]

    def typed(f):
        v = get(f)
        return S.to_int(v) if f in _LONG else v if f in _TEXT else F.coalesce(F.lower(v).isin("true", "1", "yes"), F.lit(False)) if f in _BOOL else S.to_number(v)

    nb = F.col("neighbors") if "neighbors" in df.columns else header_neighbors(df, props)
    texts = _with_properties(props, lambda lookup: F.struct(*[aliased(df, m[f], props, lookup).alias(f) for f in ("time", "lat", "lon", "tech", *fields)]))
    # behind a generator, so the columns and the filter on time don't read the texts again
    d = df.select(*keys, F.explode(F.array(F.struct(texts.alias("t"), nb.alias("n")))).alias("_r")).select(*keys, F.col("_r.t").alias("_t"), F.col("_r.n").alias("neighbors"))
    d = d.select(*keys, S.parse_ts(get("time")).alias("ts_ms"), S.to_number(get("lat")).alias("lat"), S.to_number(get("lon")).alias("lon"),
                 S.normalize_tech(get("tech")).alias("tech"), *[typed(f).alias(f) for f in fields], "neighbors")
    return d.where("ts_ms is not null")


def header_neighbors(df: DataFrame, props: str | None = None) -> Column:
    """Neighbours from columns or properties named like ``A1 PCI`` or ``M2 RSRP``."""
    pat = r"(?i)^([AMDN]\d+)\s+(PCI|SC|EARFCN|FREQ|RSRP|RSCP|RSRQ|ECNO|SINR|ECGI|ECI|CELL NAME|NAME)$"
    entry = lambda k, v: F.struct(*[F.upper(F.regexp_extract(k, pat, i)).alias(n) for i, n in ((1, "role"), (2, "field"))], v.alias("value"))
    own = [entry(F.lit(c), F.col(f"`{c}`").cast("string")) for c in df.columns if re.match(pat, c)]
    pairs = F.array(*own) if own else F.array().cast("array<struct<role:string,field:string,value:string>>")
    if props:
        more = F.filter(F.transform(F.map_entries(props), lambda e: entry(e["key"], e["value"])), lambda e: e["role"] != "")
        pairs = F.concat(pairs, F.coalesce(more, F.array().cast("array<struct<role:string,field:string,value:string>>")))

    def cell(role, mine):
        val = lambda *names: F.try_element_at(F.filter(mine, lambda e: e["field"].isin(*names)), F.lit(-1))["value"]
        number = lambda to, *names: S.once(val(*names), lambda x: to(x))
        return F.struct(role.alias("role"), number(S.to_int, "PCI", "SC").alias("pci"), number(S.to_int, "EARFCN", "FREQ").alias("earfcn"), val("ECGI", "ECI").alias("eci"),
                        val("CELL NAME", "NAME").alias("name"), number(S.to_number, "RSRP", "RSCP").alias("rsrp"), number(S.to_number, "RSRQ", "ECNO").alias("rsrq"),
                        number(S.to_number, "SINR").alias("sinr"))

    cells = S.once(pairs, lambda es: F.transform(
        F.array_distinct(F.transform(es, lambda e: e["role"])), lambda role: S.once(F.filter(es, lambda e: e["role"] == role), lambda mine: cell(role, mine))))
    return F.filter(cells, lambda n: n["pci"].isNotNull() | n["earfcn"].isNotNull())


def normalize_events(df: DataFrame, keys: Sequence[str] = ("log_id", "device_id", "seq"), props: str | None = None, mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of any spelling to classified events with the cells and configuration a command names."""
    from drivescope.functions.messages import classify_event_name

    m = {**ALIASES, **(mapping or {})}
    get = lambda f: F.col(f"_t.{f}")
    fields = ["time", "lat", "lon", "kind", "subtype", "src_pci", "src_earfcn", "tgt_pci", "tgt_earfcn", "a3_offset", "hysteresis_db", "ttt_ms", "serving_cio", "target_cio", "a3_json"]
    texts = _with_properties(props, lambda lookup: F.struct(
        *[aliased(df, m[f], props, lookup).alias(f) for f in fields], aliased(df, ["message"]).alias("own_message"),
        (aliased(df.select(props), ["Message"], props, lookup) if props else F.lit(None).cast("string")).alias("message")))
    d = df.select(*keys, F.explode(F.array(texts)).alias("_t"))  # behind a generator, so the columns and the filter on time don't read the texts again
    msg = F.coalesce(get("own_message"), get("message"), get("kind"))
    d = d.select(
        *keys, S.parse_ts(get("time")).alias("ts_ms"), S.to_number(get("lat")).alias("lat"), S.to_number(get("lon")).alias("lon"), F.coalesce(F.trim(get("kind")), F.lit("event")).alias("kind"),
        F.trim(get("subtype")).alias("subtype"), F.trim(msg).alias("message"), *[S.to_int(get(f)).alias(f) for f in ("src_pci", "src_earfcn", "tgt_pci", "tgt_earfcn")],
        *[S.to_number(get(f)).alias(f) for f in ("a3_offset", "hysteresis_db", "ttt_ms", "serving_cio", "target_cio")], get("a3_json").alias("a3_json"))
    return d.where("ts_ms is not null").withColumn("class", classify_event_name("kind", "subtype", "message"))


def missing_fields(points: DataFrame) -> DataFrame:
    """What a table of points lacks for handover analysis, one row."""
    none = lambda c, name: F.when(F.count(c) == 0, name)
    return points.agg(F.array_compact(F.array(
        F.when(F.count_if(F.col("tech") == "LTE") == 0, "technology=LTE"), none("pci", "serving_pci"), none("earfcn", "serving_earfcn"), none("rsrp", "serving_rsrp"))).alias("missing"))


def metric_value(df: DataFrame, metric: str, serving: str | None = None, props: str | None = None) -> Column:
    """A metric of a point: own column, level or quality family, any spelling, the serving struct, the properties."""
    low = metric.lower()
    flat = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    usable = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    own = {c: F.col(f"`{c}`") for c in df.columns if c not in (serving, props)}
    sub = {f.name: F.col(f"{serving}.{f.name}") for f in df.schema[serving].dataType.fields} if serving else {}
    prop = lambda k: F.try_element_at(F.col(props), F.lit(k)) if props else None
    picks = [own.get(metric)]
    if any(w in low for w in ("rscp", "rsrp", "signallevel")):
        picks += [own.get(c) for c in ("level", "rscp", "rsrp")] + [sub.get(c) for c in ("level", "rscp", "rsrp")] + [prop("Serving RSCP"), prop("Serving RSRP")]
    if any(w in low for w in ("ecno", "quality", "rsrq")) or low == "qual":
        picks += [own.get(c) for c in ("ecno", "qual", "rsrq")] + [sub.get(c) for c in ("ecno", "qual", "rsrq")] + [prop("EcNo"), prop("Serving EcNo"), prop("RSRQ")]
    if low.startswith("active_set_"):
        picks.append(own.get(low.removeprefix("active_set_")))
    for table in (own, sub):
        picks += [c for n, c in table.items() if n.lower() == low] + [c for n, c in table.items() if flat(n) == flat(low)]
    if props:
        picks.append(prop(metric))
        spelled = F.filter(F.map_entries(props), lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "") == flat(metric))
        picks.append(F.try_element_at(spelled, F.lit(1))["value"])
    found = [usable(p) for p in picks if p is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
