"""Summaries of decoded signalling messages given as JSON text of any nesting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators.catalog import ca_label

_PAIR = r'"([^"\\]+)"\s*:\s*(?:"([^"\\]*)"|(-?\d+(?:\.\d+)?|true|false))'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; the value is computed once a row however often it stands there, which a lambda would repeat for every entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyed_values(json: Column | str) -> Column:
    """Every scalar of a JSON text with its key, in document order: array<struct<key, value>>."""
    part = lambda t, i: F.regexp_extract_all(t, F.lit(_PAIR), F.lit(i))
    return _once(_c(json), lambda t: F.zip_with(
        part(t, 1), F.zip_with(part(t, 2), part(t, 3), lambda a, b: F.when(a != "", a).otherwise(b)), lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def first_value(pairs: Column, *keys: str) -> Column:
    """Value of the first listed key that is present."""
    def one(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(1))["value"]

    return F.coalesce(*[one(k) for k in keys])


def has_key(json: Column | str, key: str) -> Column:
    return F.coalesce(_c(json).contains(f'"{key}"'), F.lit(False))


def rlf_report_summary(json: Column | str) -> Column:
    """struct(has_report, root_cause, causes map, timers map) of a UE-information message."""
    found = lambda t: F.regexp_instr(t, F.lit(r'(?i)"[^"]*rlf_report[^"]*"\s*:'))
    scope = lambda t, at: F.when(at > 0, F.substr(t, at)).otherwise(t)
    spoken = lambda p: F.lower(p["key"]).contains("cause") & ~F.lower(F.trim(p["value"])).isin("", "none", "null", "n/a", "na", "-", "0")
    k = lambda p: F.regexp_replace(F.lower(p["key"]), "[_-]", "")
    name = lambda p, k: (
        F.when(k.contains("timeconnfailure"), "timeConnFailureMs").when(k.contains("timesincefailure"), "timeSinceFailureMs")
        .when(k.contains("timesincerlf"), "timeSinceRlfMs").when(k.contains("reest") & k.contains("time"), "reestablishmentTimeMs")
        .when(k.contains("t310"), "t310").when(k.contains("t311"), "t311").when(k.contains("t312"), "t312").when(k.contains("t301"), "t301")
        .when(k.contains("t304"), "t304").when(k.contains("timer"), p["key"]))
    entry = lambda p: _once(k(p), lambda x: F.struct(name(p, x).alias("key"), p["value"].try_cast("long").alias("value")))
    named = lambda pairs: F.filter(F.transform(pairs, entry), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    counted = lambda causes: F.map_from_entries(
        F.transform(F.array_distinct(causes), lambda c: F.struct(c, F.size(F.filter(causes, lambda x: x == c)).cast("long"))))
    first = lambda entries: _once(F.transform(entries, lambda p: p["key"]), lambda keys: F.map_from_entries(
        F.filter(entries, lambda p, i: F.array_position(keys, p["key"]) == i + 1)))
    summary = lambda at, pairs: _once(
        F.transform(F.filter(pairs, spoken), lambda p: F.trim(p["value"])), lambda causes: F.struct(
            (at > 0).alias("has_report"), F.try_element_at(causes, F.lit(1)).alias("root_cause"), counted(causes).alias("causes"),
            _once(named(pairs), first).alias("timers")))
    return _once(_c(json), lambda t: _once(found(t), lambda at: _once(keyed_values(scope(t, at)), lambda pairs: summary(at, pairs))))


def band_combinations(json: Column | str) -> Column:
    """Distinct combinations like ``B3+B7`` in order of appearance."""
    t = _c(json)
    at = F.regexp_instr(t, F.lit(r'(?i)"[^"]*supportedbandcombination[^"]*"\s*:\s*\['))
    listing = F.regexp_replace(F.substr(t, at), r'(?s)^"[^"]*"\s*:\s*', "")
    combos = F.when(at > 0, F.from_json(listing, "array<string>"))
    bands = lambda c: F.array_sort(F.array_distinct(F.filter(
        F.transform(F.regexp_extract_all(c, F.lit(r'(?i)"[^"]*bandeutra[^"]*"\s*:\s*(\d+)'), F.lit(1)), lambda b: b.cast("int")), lambda b: b.between(1, 256))))
    text = F.transform(combos, lambda c: F.array_join(F.transform(bands(c), lambda b: F.concat(F.lit("B"), b.cast("string"))), "+"))
    return F.coalesce(F.array_distinct(F.filter(text, lambda x: x != "")), F.array().cast("array<string>"))


def ue_capability_summary(json: Column | str) -> Column:
    """struct(ue_category, category_label, layers, mimo, max_carriers, combos, ca) of a UE-capability message."""
    pairs = keyed_values(json)
    number = lambda *keys: first_value(pairs, *keys).try_cast("long")
    cat = number("ue-Category", "ue_Category", "ue-Category-v1020", "ue_Category_v1020")
    cat = F.when(cat.between(1, 64), cat)
    layers = number("maxNumberMIMO-LayersPDSCH-r10", "maxNumberMIMO_LayersPDSCH_r10", "maxNumberMIMO-LayersPDSCH", "maxNumberMIMO_LayersPDSCH",
                    "maxNumLayersMIMO-r10", "maxNumLayersMIMO")
    four = first_value(pairs, "fourAntennaPortActivated-r10", "fourAntennaPortActivated", "fourAntennaPortActivated_r10")
    layers = F.coalesce(layers, F.when(F.lower(four).isin("true", "1", "yes"), 4))
    carriers = number("maxNumCarriers-r10", "maxNumCarriers", "maxNumCarriers_r10", "maxNumberConfiguredCCs-r13", "maxNumberConfiguredCCs-r10",
                      "maxNumberConfiguredCCs", "maxNumberConfiguredCCs_r13", "maxNumberConfiguredCCs_r10")
    combos = band_combinations(json)
    mimo = F.when(layers >= 4, "4x4 capable (decoded UE capability)").when(layers >= 2, "2x2 capable (decoded UE capability)").when(
        layers == 1, "1x1 (decoded UE capability)")
    return F.struct(
        cat.alias("ue_category"), F.concat(F.lit("Cat "), cat.cast("string")).alias("category_label"), layers.alias("layers"), mimo.alias("mimo"),
        carriers.alias("max_carriers"), combos.alias("combos"), ca_label(carriers, combos).alias("ca"))


# Scalar picks per message profile; output name and keys, first present counts.
PROFILES = {
    "sib1": {"trackingAreaCode": ["trackingAreaCode", "trackingAreaCode-r8", "trackingAreaCode_r8", "trackingAreaCode-v1130", "trackingAreaCode_v1130", "tac"]},
    "sib3": {"qHyst": ["q-Hyst"], "cellReselectionPriority": ["cellReselectionPriority"], "sIntraSearch": ["s-IntraSearch"], "sNonIntraSearch": ["s-NonIntraSearch"],
             "threshServingLow": ["threshServingLow"], "qRxLevMin": ["q-RxLevMin"], "qQualMin": ["q-QualMin-r9", "q-QualMin"], "tReselectionEutra": ["t-ReselectionEUTRA"],
             "tReselectionEutraSfHigh": ["sf-High"], "tReselectionEutraSfMedium": ["sf-Medium"], "sIntraSearchP": ["s-IntraSearchP-r9"],
             "sIntraSearchQ": ["s-IntraSearchQ-r9"], "sNonIntraSearchP": ["s-NonIntraSearchP-r9"], "sNonIntraSearchQ": ["s-NonIntraSearchQ-r9"]},
    "sib5": {"dlCarrierFreq": ["dl-CarrierFreq"], "cellReselectionPriority": ["cellReselectionPriority"], "qRxLevMin": ["q-RxLevMin"], "threshXHigh": ["threshX-High"],
             "threshXLow": ["threshX-Low"], "tReselectionEutra": ["t-ReselectionEUTRA"], "allowedMeasBandwidth": ["allowedMeasBandwidth"]},
    "rrc_release": {"releaseCause": ["releaseCause"]},
    "rrc_connection_request": {"establishmentCause": ["establishmentCause", "establishmentCause-r15"]},
    "rrc_setup_complete": {"selectedPLMNIdentity": ["selectedPLMN-Identity", "selectedPLMN_Identity"]},
    "rrc_reestablishment_request": {"reestablishmentCause": ["reestablishmentCause"]},
    "rrc_recfg_complete": {"rlfInfoAvailable": ["rlf_InfoAvailable_r10", "rlf_InfoAvailable_r9"]},
}
# Presence flags per message profile.
PRESENCE = {
    "rrc_release": {"hasIdleModeMobilityControlInfo": "idleModeMobilityControlInfo", "hasRedirectedCarrierInfo": "redirectedCarrierInfo"},
    "rrc_setup_complete": {"hasDedicatedInfoNAS": "dedicatedInfoNAS"}, "security_mode_command": {"hasSecurityConfigSMC": "securityConfigSMC"},
    "ue_information_request": {"rlfReportReq": "rlf_ReportReq_r9", "rachReportReq": "rach_ReportReq_r9"},
    "ue_information_response": {"hasRachReport": "rach_Report_r9", "hasConnEstFailReport": "connEstFailReport_r11"},
}


def rrc_message_summary(message_id: Column | str, json: Column | str) -> Column:
    """Map of the picked fields of a message by its profile; fields that are absent are left out."""
    mid, pairs = _c(message_id), keyed_values(json)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    out = F
    for profile in {**PROFILES, **PRESENCE}:
        rows = [entry("rrcTransactionIdentifier", first_value(pairs, "rrc-TransactionIdentifier", "rrc_TransactionIdentifier"))]
        for name, keys in PROFILES.get(profile, {}).items():
            v = first_value(pairs, *keys)
            rows.append(entry(name, S.parse_tac(v) if name == "trackingAreaCode" else v))
        rows += [entry(name, has_key(json, key)) for name, key in PRESENCE.get(profile, {}).items()]
        out = out.when(mid == profile, F.map_from_entries(F.filter(F.array(*rows), lambda e: e["value"].isNotNull())))
    return out.otherwise(None)


def sib5_carriers(json: Column | str) -> Column:
    """Inter-frequency carriers of a SIB5 message: array of struct(freq, priority)."""
    t = _c(json)
    at = F.regexp_instr(t, F.lit(r'"interFreqCarrierFreqList"\s*:\s*\['))
    rows = F.when(at > 0, F.from_json(F.regexp_replace(F.substr(t, at), r'(?s)^"[^"]*"\s*:\s*', ""), "array<string>"))
    return F.transform(rows, lambda r: F.struct(
        F.regexp_extract(r, r'"dl-CarrierFreq"\s*:\s*(\d+)', 1).try_cast("long").alias("freq"),
        F.regexp_extract(r, r'"cellReselectionPriority"\s*:\s*(\d+)', 1).try_cast("long").alias("priority")))
