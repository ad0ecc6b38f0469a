"""Column expressions over signalling text: event classes, semantic flags, identifiers, RRC states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Patterns over the lower-cased "kind subtype message".
_COMMAND = r"a3/a5 event|\bhoa\b|ho command|handover command|rrcconnectionreconfiguration"
_REPORT = r"measurementreport|measurement report"
_COMPLETE = r"handover complete|ho complete|rrcconnectionreconfigurationcomplete|\bhos\b|\bhoi\b"
_FAILURE = r"rlf|radio link failure|re-establishment|reestablishment|call drop|drop call|hof|handover failure"
_ACCESS = r"rach|target access|sync"
INTERESTING = r"(?i)(rrc|idle|connected|handover|\bho\b|rlf|re-?establish|cell|pci|earfcn)"


def classify_event_name(kind, subtype=None, message=None, legacy_order: bool = False) -> Column:
    """Mobility class of an event. "...ReconfigurationComplete" counts as completion unless ``legacy_order``."""
    blank = F.lit("")
    parts = [F.coalesce(_c(x), blank) if x is not None else blank for x in (kind, subtype, message)]
    name = F.lower(F.concat_ws(" ", *parts))
    rules = [(_COMMAND, "ho_command"), (_REPORT, "measurement_report"), (_COMPLETE, "ho_complete")]
    if not legacy_order:
        rules = [rules[2], rules[0], rules[1]]
    out = F
    for pattern, label in [*rules, (_FAILURE, "failure"), (_ACCESS, "access")]:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("other")


def interesting(event_name) -> Column:
    return _c(event_name).rlike(INTERESTING)


def envelope(*texts) -> Column:
    """Upper-cased texts joined by " | ", nulls and blanks left out."""
    return F.concat_ws(" | ", *[F.upper(F.when(_c(t) != "", _c(t))) for t in texts])


# Texts that raise a flag. "any": one of these is contained; "word": this stands alone; "unless": none of these is contained.
FLAG_TEXTS: dict[str, dict[str, list[str]]] = {
    "cm_service_request": {"any": ["CM_SERVICE_REQUEST", "CM SERVICE REQUEST"]},
    "cm_service_reject": {"any": ["CM_SERVICE_REJECT", "CM SERVICE REJECT"]},
    "setup": {"word": ["SETUP"], "unless": ["SETUP_COMPLETE", "RRC_CONNECTION_SETUP", "RRC SETUP"]},
    "call_proceeding": {"any": ["CALL_PROCEEDING", "CALL PROCEEDING"]},
    "call_reject": {"any": ["CALL_REJECT", "CALL REJECT"]},
    "call_control": {"any": ["CC ", "CALL CONTROL"]},
    "connect": {"word": ["CONNECT"], "unless": ["RRC_CONNECTION", "SETUP_COMPLETE"]},
    "disconnect": {"word": ["DISCONNECT"]},
    "release": {"word": ["RELEASE"]},
    "rrc_connection_request": {"any": ["RRC_CONNECTION_REQUEST", "RRC CONNECTION REQUEST"]},
    "rrc_setup_complete": {"any": ["RRC_CONNECTION_SETUP_COMPLETE", "RRC CONNECTION SETUP COMPLETE"]},
    "rrc_reject": {"any": ["RRC_CONNECTION_REJECT", "RRC CONNECTION REJECT"]},
    "rrc_release": {"any": ["RRC_CONNECTION_RELEASE", "RRC CONNECTION RELEASE"]},
    "rab_assignment_request": {"any": ["RAB_ASSIGNMENT_REQUEST", "RAB ASSIGNMENT REQUEST", "RAB_ASSIGNMENT_REQ"]},
    "rab_assign_complete": {"any": ["RAB_ASSIGNMENT_COMPLETE", "RAB ASSIGNMENT COMPLETE", "RAB ASSIGN COMPLETE"]},
    "rab_assign_failure": {"any": ["RAB_ASSIGNMENT_FAILURE", "RAB ASSIGNMENT FAILURE", "RAB ASSIGN FAIL"]},
    "rab_release": {"any": ["RAB RELEASE"]},
    "iu_release": {"any": ["IU RELEASE", "IU-CS RELEASE", "IUCS RELEASE"]},
    "rlf": {"any": ["RADIO LINK FAILURE", "RLF"]},
    "ho_failure": {"any": ["HANDOVER FAILURE", "HO FAILURE", "HO_FAIL", "HOF", "INTER-RAT HO FAILURE", "IRAT HO FAILURE"]},
}
# Words of a release cause, and flags that hold where a release of this kind has such a cause.
CAUSE_WORDS = {"normal": ["NORMAL"], "abnormal": ["ABNORMAL", "FAIL", "ERROR", "RLF"]}
RELEASES = {"rrc_release_normal": ("rrc_release", "normal"), "rrc_release_abnormal": ("rrc_release", "abnormal"), "iu_release_abnormal": ("iu_release", "abnormal")}
# Flags any of which means call control, and names of a call's identifier.
CALL_CONTROL = ["cm_service_request", "setup", "call_proceeding", "call_control"]
CALL_ID_NAMES = [r"call\s*id", r"transaction\s*id", r"trans\s*id", "tid"]


def _raised(text: Column, rule: dict[str, list[str]]) -> Column:
    found = [text.contains(x) for x in rule.get("any", [])] + [text.rlike(rf"(?i)\b{x}\b") for x in rule.get("word", [])]
    return _any(*found) & ~_any(F.lit(False), *[text.contains(x) for x in rule.get("unless", [])])


def semantic_flags(message, rrc_cause=None, cs_cause=None) -> dict[str, Column]:
    """Boolean columns over one upper-cased message envelope and the release causes."""
    none = F.lit("")
    causes = F.upper(F.concat_ws(" ", *[F.coalesce(_c(c), none) if c is not None else none for c in (rrc_cause, cs_cause)]))
    flags = {name: _raised(_c(message), rule) for name, rule in FLAG_TEXTS.items()}
    flags["nas_call_control"] = _any(*[flags[name] for name in CALL_CONTROL])
    del flags["call_control"]
    for name, (release, kind) in RELEASES.items():
        flags[name] = flags[release] & _any(*[causes.contains(x) for x in CAUSE_WORDS[kind]])
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def _any(*cols: Column) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def rab_phase(text) -> Column:
    t = F.upper(_c(text))
    start = _any(*[t.contains(x) for x in ("SETUP", "ASSIGN", "ESTABLISH", "ADD")])
    end = _any(*[t.contains(x) for x in ("RELEASE", "REMOVE", "DELETE")])
    return F.when(t.contains("RAB"), F.when(end, "END").when(start, "START").otherwise("UPDATE"))


def _clean(x: Column) -> Column:
    t = F.trim(x)
    return F.when((t != "") & ~F.upper(t).isin("N/A", "UNKNOWN"), t)


def call_id(text, *columns) -> Column:
    named = rf"(?i)\b(?:{'|'.join(CALL_ID_NAMES)})\s*[:=]\s*([A-Za-z0-9_-]+)"
    return F.coalesce(*[_clean(_c(c)) for c in columns], _clean(F.regexp_extract(_c(text), named, 1)))


def imsi(text, *columns) -> Column:
    return F.coalesce(
        *[_clean(_c(c)) for c in columns], _clean(F.regexp_extract(_c(text), r"(?i)\bimsi\s*[:=]\s*([0-9]{5,20})\b", 1))
    )


def tmsi(text, *columns) -> Column:
    return F.coalesce(
        *[_clean(_c(c)) for c in columns], _clean(F.regexp_extract(_c(text), r"(?i)\btmsi\s*[:=]\s*([A-Fa-f0-9]{4,16})\b", 1))
    )


def prop_by_key(props, *normalised: str) -> Column:
    """First map value whose key, without punctuation and case, is one of the given names."""
    entries = F.filter(
        F.map_entries(_c(props)), lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").isin(*normalised)
    )
    return F.when(F.size(entries) > 0, entries[0]["value"])


def correlation_key(call, imsi_, tmsi_) -> Column:
    call, imsi_, tmsi_ = _c(call), _c(imsi_), _c(tmsi_)
    return (
        F.when(call.isNotNull(), F.concat(F.lit("CALL:"), call))
        .when(imsi_.isNotNull() & tmsi_.isNotNull(), F.concat(F.lit("IMSI:"), imsi_, F.lit("|TMSI:"), tmsi_))
        .when(imsi_.isNotNull(), F.concat(F.lit("IMSI:"), imsi_))
        .when(tmsi_.isNotNull(), F.concat(F.lit("TMSI:"), tmsi_))
        .otherwise("__ANON__")
    )


RRC_STATES = ["IDLE", "CELL_DCH", "CELL_FACH", "CELL_PCH", "URA_PCH", "CONNECTED", "INACTIVE"]


def rrc_state(message, explicit=None) -> Column:
    """State named explicitly, else the one a message implies, else null."""
    m = F.upper(F.coalesce(_c(message), F.lit("")))
    implied = (
        F.when(m.contains("RRC_CONNECTION_RELEASE") | m.contains("RRC RELEASE"), "IDLE")
        .when(m.contains("CELL_UPDATE"), "CELL_FACH")
        .when(m.contains("PAGING"), "CELL_PCH")
        .when(m.contains("RRC_CONNECTION_SETUP") | m.contains("RADIO_BEARER_SETUP"), "CONNECTED")
    )
    if explicit is None:
        return implied
    e = _clean(_c(explicit))
    return F.when(F.upper(e).isin(*RRC_STATES), e).otherwise(implied)


def release_kind(cause) -> Column:
    """'normal' or 'abnormal' for a usable cause text, else null."""
    c = _c(cause)
    return F.when(c.isNotNull() & ~c.isin("", "N/A", "-"), F.when(F.lower(c).contains("normal"), "normal").otherwise("abnormal"))
