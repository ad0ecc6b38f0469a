"""Column expressions: numbers, time, radio scales, identifiers, geometry."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(x: Column | str, decimal_comma: bool = False) -> Column:
    """Lenient number: blank, N/A, '-' and non-finite become null."""
    txt = F.trim(_c(x).cast("string"))
    if decimal_comma:
        txt = F.regexp_replace(txt, ",", ".")
    n = txt.try_cast("double")
    return F.when(~F.lower(txt).isin("", "n/a", "-") & ~F.isnan(n) & (F.abs(n) < float("inf")), n)


def to_int(x: Column | str) -> Column:
    """Rounded lenient number (half up, as the readers of the logs do)."""
    return F.floor(to_number(x) + 0.5).cast("long")


# ---- time -----------------------------------------------------------------------------------------------------------

_TOD = r"^(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?$"


def time_of_day_ms(x: Column | str) -> Column:
    """``H:MM:SS[.,mmm]`` to milliseconds of the day, else null."""
    t = F.trim(_c(x))
    part = lambda i: F.regexp_extract(t, _TOD, i)
    ms = F.rpad(F.when(part(4) == "", "0").otherwise(part(4)), 3, "0")
    total = ((part(1).cast("long") * 60 + part(2).cast("long")) * 60 + part(3).cast("long")) * 1000 + ms.cast("long")
    return F.when(t.rlike(_TOD), total)


def parse_ts(x: Column | str) -> Column:
    """Number as is; time of day to ms of day; ISO text to epoch ms; else null."""
    t = F.trim(_c(x).cast("string"))
    return (
        F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.round(t.try_cast("double")).cast("long"))
        .when(t.rlike(_TOD), time_of_day_ms(t))
        .otherwise(F.unix_millis(F.try_to_timestamp(t)))
    )


def format_ms_of_day(ms: Column | str) -> Column:
    m = F.pmod(_c(ms).cast("long"), F.lit(DAY_MS))
    two = lambda v: F.lpad(v.cast("long").cast("string"), 2, "0")
    return F.concat(
        two(F.floor(m / 3600000)), F.lit(":"), two(F.floor(F.pmod(m, F.lit(3600000)) / 60000)), F.lit(":"),
        two(F.floor(F.pmod(m, F.lit(60000)) / 1000)), F.lit("."),
        F.lpad(F.pmod(m, F.lit(1000)).cast("string"), 3, "0"),
    )


def format_iso(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---- technology and bands -------------------------------------------------------------------------------------------


def normalize_tech(x: Column | str) -> Column:
    t = F.upper(F.trim(_c(x)))
    return (
        F.when((t == "") | t.isNull(), None)
        .when(t.contains("LTE") | (t == "4G"), "LTE")
        .when(t.contains("NR") | t.contains("5G"), "NR")
        .when(t.contains("UMTS") | t.contains("WCDMA") | (t == "3G"), "UMTS")
        .when(t.contains("GSM") | (t == "2G"), "GSM")
        .otherwise(t)
    )


# LTE band by EARFCN range, UMTS band by UARFCN range.
LTE_BANDS = [
    (0, 599, "B1 (2100)"), (600, 1199, "B2 (1900)"), (1200, 1949, "B3 (1800)"), (2400, 2649, "B5 (850)"),
    (2750, 3449, "B7 (2600)"), (3450, 3799, "B8 (900)"), (6150, 6449, "B20 (800)"),
]
UMTS_BANDS = [(10562, 10838, "B1 (2100)"), (2937, 3088, "B8 (900)")]


def _band(x: Column, table, other: str | None) -> Column:
    out = F
    for lo, hi, name in table:
        out = out.when(x.between(lo, hi), name)
    return out.otherwise(other)


def band_from_earfcn(x: Column | str) -> Column:
    return _band(_c(x), LTE_BANDS, "Unknown")


def band_from_uarfcn(x: Column | str) -> Column:
    return _band(_c(x), UMTS_BANDS, None)


# ---- reported indices to physical values ------------------------------------------------------------------------------


def _scale(idx: Column | str, lo: float, step: float, top: int) -> Column:
    i = _c(idx)
    return F.when(i.between(0, top), F.lit(float(lo)) + i * F.lit(float(step)))


def rsrp_idx_to_dbm(i):
    return _scale(i, -140, 1, 97)


def rsrq_idx_to_db(i):
    return _scale(i, -19.5, 0.5, 34)


def utra_rscp_idx_to_dbm(i):
    return _scale(i, -120, 1, 96)


def utra_ecno_idx_to_db(i):
    return _scale(i, -24, 0.5, 49)


def geran_rxlev_to_dbm(i):
    return _scale(i, -110, 1, 63)


def _only(text: Column, alphabet: str) -> Column:
    """Whether the text is made of these characters, one at least."""
    return (text != "") & (F.translate(text, alphabet, "") == "")


def enum_db(x: Column | str) -> Column:
    """A number with ``dB`` before or behind it, or a plain one."""
    t = F.trim(_c(x))
    unit = F.lower(t)
    bare = F.trim(F.when(unit.startswith("db"), F.substr(t, F.lit(3))).when(unit.endswith("db"), F.left(t, F.length(t) - 2)))
    return F.when(_only(bare, "+-.0123456789"), bare.try_cast("double")).otherwise(t.try_cast("double"))


def enum_ms(x: Column | str) -> Column:
    """A whole number, with or without ``ms`` before it."""
    t = F.trim(_c(x))
    bare = F.trim(F.when(F.lower(t).startswith("ms"), F.substr(t, F.lit(3))))
    return F.when(_only(bare, "0123456789"), bare.try_cast("long")).otherwise(t.try_cast("long"))


# ---- identifiers ------------------------------------------------------------------------------------------------------


def enb_id(eci: Column | str) -> Column:
    e = _c(eci).cast("long")
    return F.when(e > 255, F.floor(e / 256))


def enb_cell(eci: Column | str) -> Column:
    e = _c(eci).cast("long")
    return F.when(e > 255, F.pmod(e, F.lit(256)))


def enb_label(eci: Column | str) -> Column:
    return F.concat_ws("-", enb_id(eci).cast("string"), enb_cell(eci).cast("string"))


def long_cid_rnc(cid: Column | str) -> Column:
    return F.shiftright(_c(cid).cast("long"), 16)


def long_cid_cell(cid: Column | str) -> Column:
    return _c(cid).cast("long").bitwiseAND(F.lit(0xFFFF))


def parse_tac(x: Column | str) -> Column:
    """Decimal 0..65535, ``0x..``, four hex digits, or a bit string ``'..'B``; else null."""
    t = F.upper(F.trim(_c(x)))
    sign = F.left(t, F.lit(1)).isin("+", "-")
    decimal = F.when(_only(F.when(sign, F.substr(t, F.lit(2))).otherwise(t), "0123456789"), t.try_cast("long"))
    digits = F.when(t.startswith("0X"), F.substr(t, F.lit(3))).when(F.length(t) == 4, t)
    hexa = F.when(_only(digits, "0123456789ABCDEF") & (F.length(digits) <= 8), F.conv(digits, 16, 10).cast("long"))
    # One B at the end, or before the quotes, and nothing else but bits.
    bits = F.translate(t, "'B", "")
    framed = (F.translate(t, "01'", "") == "B") & (t.endswith("B") | (t.startswith("B'") & t.endswith("'")))
    binary = F.when(framed & _only(bits, "01") & F.length(bits).between(8, 32), F.conv(bits, 2, 10).cast("long"))
    value = F.coalesce(F.when(decimal.between(0, 65535), decimal), hexa, binary)
    return F.when(value.between(0, 65535), value)


# Call release causes.
CAUSES = {
    16: "Normal call clearing", 17: "User busy", 18: "No user responding", 19: "No answer from user", 21: "Call rejected",
    27: "Destination out of order", 34: "No circuit/channel available", 41: "Temporary failure",
    42: "Switching equipment congestion", 47: "Resource unavailable", 102: "Setup timeout (timer expiry)",
}


def cause_label(x: Column | str) -> Column:
    out = F
    for code, label in CAUSES.items():
        out = out.when(_c(x) == code, label)
    return out.otherwise("Unknown cause")


def normalize_bsic(json_or_text: Column | str) -> Column:
    """``ncc-bcc`` from a JSON object, its flat ``bsic``/``value``, or the text itself."""
    t = F.trim(_c(json_or_text))
    get = lambda *keys: F.coalesce(*[F.get_json_object(t, f"$.{k}").try_cast("long") for k in keys])
    ncc, bcc = get("networkColourCode", "ncc", "NCC"), get("baseStationColourCode", "bcc", "BCC")
    obj = F.when(ncc.isNotNull() & bcc.isNotNull(), F.concat_ws("-", ncc.cast("string"), bcc.cast("string"))).otherwise(
        get("bsic", "BSIC", "value").cast("string")
    )
    return F.when(t.startswith("{"), obj).when((t != "") & (F.lower(t) != "[object object]"), t)


def utra_psc(json_or_text: Column | str) -> Column:
    """Primary scrambling code from an integer, ``{"fdd": n}`` or ``{"tdd": n}``."""
    t = F.trim(_c(json_or_text))
    keys = ("fdd", "tdd", "psc", "physCellId")
    return F.coalesce(t.try_cast("long"), *[F.get_json_object(t, f"$.{k}").try_cast("long") for k in keys])


def strip_accents_upper_alpha(x: Column | str) -> Column:
    """Accents folded, upper case, letters A-Z only."""
    return F.regexp_replace(F.upper(F.translate(_c(x), *_marked_letters())), "[^A-Z]", "")


@cache
def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks, by their Unicode decomposition, and their base letters, position by position."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, base) for c, base in pairs if c != base and base.isascii() and base.isalpha()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


# ---- geometry ---------------------------------------------------------------------------------------------------------


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres; a missing coordinate gives null (read as: unknown, infinitely far)."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(6371000.0) * 2 * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    d = F.radians(_c(lon2) - _c(lon1))
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)))
    return F.pmod(deg + 360, F.lit(360.0))


def destination_point(lat, lon, bearing, dist) -> Column:
    """struct(lat, lon) at ``dist`` metres, flat earth with 111 111 m per degree."""
    b = F.radians(_c(bearing))
    return F.struct(
        (_c(lat) + F.cos(b) * dist / 111111).alias("lat"),
        (_c(lon) + F.sin(b) * dist / (F.lit(111111) * F.cos(F.radians(_c(lat))))).alias("lon"),
    )


def sector_polygon(lat, lon, azimuth, beam, radius) -> Column:
    """Centre and the two edge points of a sector; just the centre of an omni cell (beam > 300)."""
    az, bm = _c(azimuth), _c(beam)
    centre = F.struct(_c(lat).cast("double").alias("lat"), _c(lon).cast("double").alias("lon"))
    edges = F.array(
        centre, destination_point(lat, lon, az - bm / 2, radius), destination_point(lat, lon, az + bm / 2, radius)
    )
    return F.when(bm > 300, F.array(centre)).otherwise(edges)


def square_footprint(x, y, half: float = 25.0) -> Column:
    return F.struct(
        (_c(x) - half).alias("x_min"), (_c(y) - half).alias("y_min"), (_c(x) + half).alias("x_max"), (_c(y) + half).alias("y_max")
    )


def effective_delta(serving, target, serving_cio=None, target_cio=None) -> Column:
    """(target + its offset) - (serving + its offset); missing offsets count as 0, a missing level gives null."""
    zero = F.lit(0.0)
    sc = zero if serving_cio is None else F.coalesce(_c(serving_cio), zero)
    tc = zero if target_cio is None else F.coalesce(_c(target_cio), zero)
    return (_c(target) + tc) - (_c(serving) + sc)


# ---- parameter lists --------------------------------------------------------------------------------------------------


def params_map(params: Column | str) -> Column:
    """Parameter list to map; of equal ids the first wins, blank ids are dropped."""
    p = F.filter(_c(params), lambda x: F.trim(F.coalesce(x["param_id"], F.lit(""))) != "")
    ids = F.transform(p, lambda x: F.trim(x["param_id"]))
    first = F.filter(p, lambda x, i: F.array_position(ids, F.trim(x["param_id"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(F.trim(x["param_id"]), x["param_value"])))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def param_ci(params: Column | str, name: str) -> Column:
    """Value of the first parameter with this id, case-insensitive."""
    hit = F.filter(_c(params), lambda x: F.lower(F.trim(x["param_id"])) == name.lower())
    return F.try_element_at(hit, F.lit(1))["param_value"]


def neighbor_metric_index(name: Column | str) -> Column:
    got = F.regexp_extract(_c(name), r"(?i)^Radio\.Lte\.Neighbor\[(\d+)\]\.(Pci|Rsrp|Rsrq|Cinr|Earfcn|Frequency)$", 1)
    return F.when(got != "", got.cast("long"))


def neighbor_metric_field(name: Column | str) -> Column:
    got = F.lower(F.regexp_extract(_c(name), r"(?i)^Radio\.Lte\.Neighbor\[(\d+)\]\.(Pci|Rsrp|Rsrq|Cinr|Earfcn|Frequency)$", 2))
    return F.when(got == "frequency", "earfcn").when(got != "", got)


def index_qualifier_base(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(name), r"(?i)\|idx=-?\d+$", ""))


def index_qualifier(name: Column | str) -> Column:
    got = F.regexp_extract(_c(name), r"(?i)\|idx=(-?\d+)$", 1)
    return F.when(got != "", got.cast("long"))


# Names of an index inside a text.
INDEX_NAMES = ["idx", "index", "slot"]


def sample_index(*candidates: Column, text: Column | str | None = None) -> Column:
    """First valid (0..1024) index among explicit columns, else the ``idx=n`` in the text value."""
    valid = lambda c: F.when(c.between(0, 1024), c)
    picks = [valid(c.try_cast("long")) for c in candidates]
    if text is not None:
        got = F.regexp_extract(_c(text), rf"(?i)(?:{'|'.join(INDEX_NAMES)})\s*[:=]\s*(-?\d+)", 1)
        picks.append(valid(got.try_cast("long")))
    return F.coalesce(*picks)
