"""Generic RRC/call sessions from signalling rows: a state machine per correlation key.

A row with an identity looks at its own key's sessions and state only. A row without one joins the only named key with an open
session, if there is exactly one, and the key of the anonymous rows otherwise. So keys run side by side, once it is known to
which key each anonymous row belongs, and that is found by rounds: from the sessions of the last round the open ones are
counted ahead of every anonymous row; rows that belong elsewhere move, and only the keys they touch run again. What a row
belongs to depends on earlier rows alone, so every round settles at least the earliest row that was wrong, and rows that stand
still are where the machine would have put them one by one. A log that hasn't settled after ``rounds`` runs as one sequence.

A key's rows are cut into stretches, so that a key may hold a large share of a log: after a row that ends any session, once
the last connection request is too old to count, nothing but the radio state reaches a later row, and Spark carries that
along. Spark derives flags, owners and stretches; the machine streams over sorted stretches and keeps only open sessions.
Sessions are numbered afterwards, by the row that opened them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.functions import messages as M
from drivescope.operators import ordered
from drivescope.operators.staging import materialize

ANON = "__ANON__"
IDLE = ("IDLE", "CELL_PCH", "URA_PCH")

OUTPUT = (
    "log_id long, key string, call_id string, imsi string, tmsi string, start_ts long, end_ts long, duration_ms long, start_trigger string, "
    "end_trigger string, end_type string, result_type string, drop boolean, setup_failure boolean, ignored boolean, incomplete boolean, has_connect boolean, "
    "failure_code string, records long, opened_ts long, opened_seq long, closed_seq long"
)
# Facts that end whatever session is open, alone or together.
ENDINGS = (("rlf",), ("iu_release_abnormal",), ("rrc_release_abnormal",), ("rrc_release_normal",), ("cm_service_reject",), ("call_reject",), ("disconnect", "release"),
           ("ho_failure", "release"), ("ho_failure", "rrc_release"), ("ho_failure", "iu_release"))


@dataclass(frozen=True)
class Timers:
    rrc_nas_ms: int = 5_000
    min_attempt_ms: int = 2_000
    max_setup_ms: int = 30_000


@dataclass
class _Session:
    key: str
    start: int
    end: int
    trigger: str
    opened: tuple[int, int]
    ids: dict = field(default_factory=dict)
    seen: set = field(default_factory=set)
    records: int = 0
    connected: bool = False
    disconnecting: bool = False


# What a session remembers; "early" facts only count before the call is connected.
_REMEMBER = ("rrc_setup_complete", "rrc_reject", "cm_service_reject", "call_reject", "rab_assign_failure")
_EARLY = {"rab_release": "early_rab_release", "rlf": "early_rlf"}


def _ending(f: frozenset, s: _Session, left_idle: bool) -> tuple[str, str] | None:
    """(trigger, kind) of the first rule that ends the session; kind: loss, drop, normal or fail."""
    freed = bool(f & {"release", "rrc_release", "iu_release"})
    rules = (
        ("rlf" in f, "RADIO_LINK_FAILURE", "loss"),
        ("iu_release_abnormal" in f, "IU_RELEASE_ABNORMAL", "loss"),
        ("rrc_release_abnormal" in f, "RRC_CONNECTION_RELEASE_ABNORMAL", "loss"),
        ("ho_failure" in f and freed, "HANDOVER_FAILURE_RELEASE", "loss"),
        (s.connected and "iu_release" in f and not s.disconnecting, "MSC_RELEASE_WITHOUT_DISCONNECT", "drop"),
        ("rrc_release_normal" in f or ("rrc_release" in f and s.disconnecting), "RRC_CONNECTION_RELEASE_NORMAL", "normal"),
        ("cm_service_reject" in f, "CM_SERVICE_REJECT", "fail"),
        ("call_reject" in f, "CALL_REJECT", "fail"),
        ("rab_release" in f and not s.connected, "RAB_RELEASE", "fail"),
        ("iu_release" in f and not s.connected, "IU_RELEASE", "fail"),
        ("disconnect" in f and "release" in f, "DISCONNECT_RELEASE", "normal"),
        (left_idle and (s.disconnecting or "release" in f), "RETURN_TO_IDLE", "normal"),
        (left_idle, "RRC_IDLE_TRANSITION", "normal"),
    )
    return next(((trigger, kind) for hit, trigger, kind in rules if hit), None)


def _failure(seen: set) -> str:
    if "rrc_reject" in seen and "rrc_setup_complete" not in seen:
        return "RRC_FAILURE"
    if {"cm_service_reject", "call_reject"} <= seen:
        return "CORE_NAS_REJECT"
    if {"rab_assign_failure", "early_rab_release"} <= seen:
        return "RAB_SETUP_FAILURE"
    return "EARLY_RADIO_FAILURE" if "early_rlf" in seen else "UNKNOWN_FAILURE"


class _Log:
    """Open sessions and radio state of a log, or of a stretch of one key's rows that begins in the state ``before``."""

    def __init__(self, log_id, timers: Timers, key: str | None = None, before: str | None = None):
        self.log_id, self.timers, self.whole = log_id, timers, key is None
        self.state: dict[str, str] = {key: before} if before else {}
        self.pending: dict[str, int] = {}
        self.open: dict[str, _Session] = {}

    def _start(self, key: str, ts: int, seq: int, f: frozenset, was_idle: bool) -> _Session | None:
        asked = self.pending.get(key)
        follows = asked is not None and "nas_call_control" in f and 0 <= ts - asked <= self.timers.rrc_nas_ms
        triggers = (
            (was_idle and "cm_service_request" in f, "CM_SERVICE_REQUEST", ts), (was_idle and "setup" in f, "SETUP", ts),
            (was_idle and "rab_assignment_request" in f, "RAB_ASSIGNMENT_REQUEST", ts), (was_idle and "call_proceeding" in f, "CALL_PROCEEDING", ts),
            (follows, "RRC_CONNECTION_REQUEST_PLUS_NAS_CC", asked),
        )
        for hit, trigger, start in triggers:
            if hit:
                self.pending.pop(key, None)
                self.open[key] = _Session(key, start, start, trigger, (ts, seq))
                return self.open[key]
        return None

    def feed(self, ts: int, seq: int, key: str, f: frozenset, rrc: str | None, ids: dict) -> dict | None:
        if self.whole and key == ANON:
            named = [k for k in self.open if k != ANON]
            key = named[0] if len(named) == 1 else ANON
        was_idle = self.state.get(key, "IDLE").upper() in IDLE
        if rrc:
            self.state[key] = rrc
        idle = self.state.get(key, "IDLE").upper() in IDLE
        s = self.open.get(key)
        if s is None:
            if was_idle and "rrc_connection_request" in f:
                self.pending[key] = ts
            s = self._start(key, ts, seq, f, was_idle)
        if s is None:
            return None
        s.records += 1
        s.start, s.end = min(s.start, ts), max(s.end, ts)
        for name, value in ids.items():
            if value and name not in s.ids:
                s.ids[name] = value
        s.seen |= f & set(_REMEMBER)
        s.seen |= {fact for flag, fact in _EARLY.items() if flag in f and not s.connected}
        s.connected |= "connect" in f
        s.disconnecting |= "disconnect" in f
        end = _ending(f, s, not was_idle and idle)
        if end is None:
            return None
        del self.open[key]
        s.end = ts
        return self._row(s, *end, seq)

    def _row(self, s: _Session, trigger: str | None = None, kind: str | None = None, closed: int | None = None) -> dict:
        ended, length = kind is not None, s.end - s.start
        lost = kind == "drop" or (kind == "loss" and s.connected)
        known_call = bool(s.ids.get("call_id"))
        short = ended and not s.connected and length < self.timers.min_attempt_ms
        long = ended and not s.connected and length > self.timers.max_setup_ms
        failed = ended and not s.connected and not short and not long
        drop = lost and known_call
        if short:
            end_type = "IGNORED_SHORT_ATTEMPT"
        elif long:
            end_type = "INCOMPLETE_OR_ONGOING"
        elif failed:
            end_type = "CALL_SETUP_FAILURE"
        elif lost:
            end_type = "DROP" if known_call else "RRC_SESSION_ABNORMAL_END"
        else:
            end_type = {"normal": "NORMAL", "loss": "CALL_SETUP_FAILURE", "fail": "CALL_SETUP_FAILURE"}.get(kind)
        return {
            "log_id": self.log_id, "opened_ts": s.opened[0], "opened_seq": s.opened[1], "key": s.key, "call_id": s.ids.get("call_id"), "imsi": s.ids.get("imsi"), "tmsi": s.ids.get("tmsi"), "start_ts": s.start,
            "end_ts": s.end, "duration_ms": length if ended else None, "start_trigger": s.trigger, "end_trigger": trigger, "end_type": end_type,
            "result_type": "RRC_SESSION_ABNORMAL_END" if drop else "RRC_SESSION", "drop": drop and s.connected, "setup_failure": failed, "ignored": short, "incomplete": long,
            "has_connect": s.connected, "failure_code": _failure(s.seen) if failed else None, "records": s.records, "closed_seq": closed}

    def close(self) -> list[dict]:
        return [self._row(s) for s in self.open.values()]


_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def _machine(names: list[str], timers: Timers):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log: _Log | None = None
        now = None
        flags: dict[int, frozenset] = {}
        for batch in batches:
            rows = []
            cols = (batch[c].tolist() for c in ("log_id", "owner", "stretch", "before", "ts_ms", "seq", "key", "mask", "rrc", "call_id", "imsi", "tmsi"))
            for log_id, owner, stretch, before, ts, seq, key, mask, rrc, call, imsi, tmsi in zip(*cols):
                if log is None or now != (log_id, owner, stretch):
                    rows += log.close() if log else []
                    log, now = _Log(log_id, timers, owner, before), (log_id, owner, stretch)
                if mask not in flags:
                    flags[mask] = frozenset(n for i, n in enumerate(names) if mask >> i & 1)
                done = log.feed(ts, seq, owner or key, flags[mask], rrc, {"call_id": call, "imsi": imsi, "tmsi": tmsi})
                if done:
                    rows.append(done)
            if rows:
                yield _frame(rows)
        if log and log.open:
            yield _frame(log.close())

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"duration_ms": "Int64", "closed_seq": "Int64"})


def _has(names: list[str], *facts: str) -> Column:
    bits = sum(1 << names.index(f) for f in facts)
    return F.col("mask").bitwiseAND(F.lit(bits)) == bits


def _in_stretches(rows: DataFrame, names: list[str], timers: Timers, block_ms: int) -> DataFrame:
    """Adds ``before``, the radio state ahead of a row of its owner, and ``stretch``, the owner's stretch the row belongs to."""
    ends = F.lit(False)
    for facts in ENDINGS:
        ends = ends | _has(names, *facts)
    known = ordered.with_last_known(rows, ["log_id", "owner"], {"before": "rrc", "asked": F.when(_has(names, "rrc_connection_request"), F.col("ts_ms")), "ended": ends},
                                    block_ms=block_ms, include_current=False)
    cut = F.col("ended") & F.coalesce(F.col("ts_ms") - F.col("asked") > timers.rrc_nas_ms, F.lit(True))
    return ordered.with_running_sum(known, ["log_id", "owner"], {"stretch": cut.cast("int")}, block_ms=block_ms).drop("asked", "ended")


def _run(rows: DataFrame, names: list[str], timers: Timers, block_ms: int) -> DataFrame:
    """Sessions of rows that know their owner."""
    dealt = _in_stretches(rows, names, timers, block_ms).repartition("log_id", "owner", "stretch").sortWithinPartitions("log_id", "owner", "stretch", "ts_ms", "seq")
    return dealt.mapInPandas(_machine(names, timers), OUTPUT)


def _owners(anonymous: DataFrame, sessions: DataFrame, block_ms: int) -> DataFrame:
    """The anonymous rows with the owner that these sessions give them: a running count of open named sessions and of their numbers."""
    named = sessions.where(F.col("key") != ANON)
    moves = F.array(F.struct(F.col("opened_ts").alias("ts_ms"), F.col("opened_seq").alias("seq"), F.lit(1).alias("sign")),
                    F.struct(F.col("end_ts").alias("ts_ms"), F.col("closed_seq").alias("seq"), F.lit(-1).alias("sign")))
    steps = named.select("log_id", F.col("opened_seq").alias("number"), F.explode(moves).alias("m")).where("m.seq is not null")
    # An anonymous row stands ahead of what it causes itself.
    steps = steps.select("log_id", F.col("m.ts_ms").alias("ts_ms"), (F.col("m.seq") * 2 + 1).alias("seq"), F.col("m.sign").alias("sign"), (F.col("m.sign") * F.col("number")).alias("number"))
    asked = anonymous.select("log_id", "ts_ms", (F.col("seq") * 2).alias("seq"), F.lit(None).cast("int").alias("sign"), F.lit(0).cast("long").alias("number"))
    marked = asked.unionByName(steps).withColumn("asks", F.col("sign").isNull())
    at = ordered.with_running_sum(marked, ["log_id"], {"open": "sign", "only": "number"}, block_ms=block_ms).where("asks")
    at = at.select("log_id", "ts_ms", (F.col("seq") / 2).cast("long").alias("seq"), F.when(F.col("open") == 1, F.col("only")).alias("only"))
    sole = named.select("log_id", F.col("opened_seq").alias("only"), F.col("key").alias("sole"))
    found = at.where("only is not null").join(sole, ["log_id", "only"], "left").select("log_id", "ts_ms", "seq", "sole")
    return anonymous.join(found, ["log_id", "ts_ms", "seq"], "left").withColumn("new_owner", F.coalesce("sole", F.lit(ANON))).drop("sole")


def _settled(rows: DataFrame, names: list[str], timers: Timers, rounds: int, block_ms: int) -> DataFrame:
    """Sessions of all rows, each under its owner."""
    named = rows.where(F.col("key") != ANON).withColumn("owner", F.col("key"))
    anonymous = rows.where(F.col("key") == ANON).withColumn("owner", F.lit(ANON))
    sessions = materialize(_run(named.unionByName(anonymous), names, timers, block_ms), "sessions")
    for _ in range(rounds):
        moved = materialize(_owners(anonymous, sessions, block_ms), "owners")
        changed = moved.where("owner != new_owner")
        touched = materialize(changed.select("log_id", F.explode(F.array("owner", "new_owner")).alias("owner")).distinct(), "touched")
        if touched.isEmpty():
            return sessions
        anonymous = moved.withColumn("owner", F.col("new_owner")).drop("new_owner")
        again = named.unionByName(anonymous).join(touched, ["log_id", "owner"], "left_semi")
        kept = sessions.join(touched.withColumnRenamed("owner", "key"), ["log_id", "key"], "left_anti")
        sessions = materialize(kept.select(*_COLUMNS).unionByName(_run(again.select(*named.columns), names, timers, block_ms)), "sessions")
    late = materialize(_owners(anonymous, sessions, block_ms).where("owner != new_owner").select("log_id").distinct(), "late")
    whole = _whole(rows.join(late, "log_id", "left_semi").select(*rows.columns), names, timers)
    return sessions.join(late, "log_id", "left_anti").select(*_COLUMNS).unionByName(whole)


def _whole(rows: DataFrame, names: list[str], timers: Timers) -> DataFrame:
    """Sessions of logs that run as one sequence each."""
    none = F.lit(None).cast("string")
    dealt = rows.select("*", none.alias("owner"), F.lit(0).cast("long").alias("stretch"), none.alias("before")).repartition("log_id").sortWithinPartitions("log_id", "ts_ms", "seq")
    return dealt.mapInPandas(_machine(names, timers), OUTPUT)


def rrc_session_machine(
    rows: DataFrame, *, message: str = "message", details: str | None = None, state: str | None = None, rrc_cause: str | None = None, cs_cause: str | None = None,
    timers: Timers = Timers(), extra_text: Sequence[str] = (), by_key: bool = True, rounds: int = 12, block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """Sessions of every log from its time-ordered signalling rows (``log_id, ts_ms, seq`` and texts).

    ``seq`` numbers the rows of a log. ``by_key=False`` runs every log as one sequence, with the same result.
    """
    texts = [message, *([details] if details else []), *extra_text]
    flags = M.semantic_flags(M.envelope(*texts), rrc_cause, cs_cause)
    names = list(flags)
    mask = F.lit(0).cast("long")
    for i, n in enumerate(names):
        mask = mask + F.when(flags[n], F.lit(1 << i)).otherwise(0)
    pool = F.concat_ws(" | ", *texts)
    d = rows.select(
        F.col("log_id").cast("long").alias("log_id"), "ts_ms", F.col("seq").cast("long").alias("seq"), M.call_id(pool).alias("call_id"), M.imsi(pool).alias("imsi"), M.tmsi(pool).alias("tmsi"), mask.alias("mask"),
        M.rrc_state(message, state).alias("rrc")).where("ts_ms is not null")
    d = d.withColumn("key", M.correlation_key("call_id", "imsi", "tmsi"))
    found = _settled(materialize(d, "signalling"), names, timers, rounds, block_ms) if by_key else _whole(d, names, timers)
    found = ordered.with_row_number(found, ["log_id"], "session_no", ts="opened_ts", seq="opened_seq", block_ms=block_ms)
    return found.drop("opened_ts", "opened_seq", "closed_seq")
