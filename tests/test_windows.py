"""Windows that share their samples, against one look at all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from drivescope.operators import handover as H
from drivescope.operators import neighbors, ranges, timejoin

NEIGHBOR = "pci long, earfcn long, eci string, rsrp double, rsrq double, sinr double"
POINT = f"log_id long, device_id long, seq long, ts_ms long, pci long, earfcn long, rsrp double, rsrq double, sinr double, neighbors array<struct<{NEIGHBOR}>>"
CELL = "ts_ms long, eci string, rsrp double, rsrq double, sinr double, pci long, earfcn long, neighbors array<struct<" + NEIGHBOR + ">>"
HO = (f"log_id long, device_id long, transition_no long, start_ts long, command_ts long, anchor_ts long, report_ts long, complete_ts long, fail_ts long, a3_json string, "
      f"source_pci long, source_earfcn long, target_pci long, target_earfcn long, serving_cio double, target_cio double, a3_offset double, source struct<{CELL}>, target struct<{CELL}>")


def test_ranges_equal_plain_looks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 64, 65):
        values = rng.integers(0, 9, n).astype(float)
        values[rng.random(n) < 0.1] = np.nan
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 200)), axis=0)
        best = ranges.best_in(values, lo, hi)
        total = ranges.sum_in(values, lo, hi)
        k = np.array([rng.integers(0, max(1, b - a)) for a, b in zip(lo, hi)])
        some = hi > lo
        found = ranges.kth_in(values, lo[some], hi[some], k[some])
        for i, (a, b) in enumerate(zip(lo, hi)):
            part = values[a:b]
            rank = [(x != x, 0 if x != x else x) for x in part]
            assert best[i] == (a + rank.index(max(rank)) if len(rank) else -1)
            np.testing.assert_equal(total[i], part.sum())
        for x, a, b, j in zip(found, lo[some], hi[some], k[some]):
            np.testing.assert_equal(x, np.sort(values[a:b])[j])
    assert ranges.first_from(np.array([False, True, False]), np.array([0, 1, 2, 3])).tolist() == [1, 1, 3, 3]
    assert ranges.sum_in(np.array([1.0, np.inf, -np.inf]), np.array([0, 0, 1, 0]), np.array([1, 2, 3, 0])).tolist()[:2] == [1.0, math.inf]
    assert [x.tolist() for x in ranges.of_one_kind(np.array([1.0, np.nan, 1.0, np.nan]), np.array([1, 2, 1, 3]))] == [[0, 2], [1], [3]]


def evidence(h, points, cfg):
    """The evidence of one handover by a look at every sample of its window."""
    a, tp, te, sp, se = h["anchor_ts"], h["target_pci"], h["target_earfcn"], h["source_pci"], h["source_earfcn"]
    own = sorted((p for p in points if p["device_id"] == h["device_id"] and p["ts_ms"] is not None), key=lambda p: (p["ts_ms"], p["seq"]))
    in_w = [p for p in own if a - cfg.window_before_ms <= p["ts_ms"] <= a + cfg.window_after_ms]
    in_x = [p for p in own if a - max(cfg.window_before_ms, cfg.inter_window_before_ms) <= p["ts_ms"] <= a + cfg.window_after_ms]
    cells = lambda p: p["neighbors"] or []
    sc, tc = h["serving_cio"] or 0.0, h["target_cio"] or 0.0

    def target(p):
        if p["pci"] is not None and p["pci"] == tp and (te is None or p["earfcn"] == te):
            return p["rsrp"]
        return next((n["rsrp"] for n in cells(p) if (tp is None or n["pci"] == tp) and (te is None or n["earfcn"] == te)), None)

    on = lambda p: [n for n in cells(p) if n["earfcn"] is not None and te in (None, n["earfcn"])]
    eci = h["target"]["eci"]
    chosen = lambda p: next((n["rsrp"] for n in on(p) if (tp is None or n["pci"] == tp) and (eci is None or n["eci"] is None or n["eci"] == eci)), None)
    first = lambda some, cond: next((p["ts_ms"] for p in some if cond(p)), None)
    known = lambda *x: None not in x
    levels = [p for p in in_x if known(target(p), p["rsrp"])]
    held = {id(p): q["ts_ms"] - p["ts_ms"] >= cfg.sustained_stronger_ms for p, q in zip(levels, levels[1:])}
    eff = lambda p: (target(p) + tc) - (p["rsrp"] + sc)
    after = lambda some, cond: first([p for p in some if held.get(id(p))], cond)

    def near(at):
        close = [p for p in own if at is not None and abs(p["ts_ms"] - at) <= cfg.max_sample_gap_ms]
        return min(close, key=lambda p: (abs(p["ts_ms"] - at), p["ts_ms"], p["seq"]), default=None)

    def other(some, ref, freq, without):
        best = None
        for p in some:
            if ref is None or p["rsrp"] is None or not p["ts_ms"] - cfg.alternative_after_ms <= ref <= p["ts_ms"] + cfg.mr_to_command_max_ms:
                continue
            for n in cells(p):
                if n["rsrp"] is not None and freq in (None, n["earfcn"]) and (n["pci"] is None or n["pci"] not in without):
                    delta = n["rsrp"] - (p["rsrp"] + sc)
                    best = (delta, n["pci"], n["rsrq"]) if best is None or delta > best[0] else best
        return best

    pick = lambda *x: next((y for y in x if y is not None), None)
    report, fail = near(pick(h["report_ts"], h["command_ts"], h["start_ts"])), near(h["fail_ts"])
    post = near(pick(h["complete_ts"], h["command_ts"], h["start_ts"]) + min(cfg.stable_dwell_ms, cfg.window_after_ms))
    visible = [p for p in in_x if on(p)]
    delta = None if report is None or not known(target(report), report["rsrp"]) else eff(report)
    strongest = lambda p: max((n["rsrp"] for n in on(p) if n["rsrp"] is not None), default=None)
    any_ = bool(in_x or report or post or fail)
    return {
        "effective_delta_at_report": delta, "serving_rsrp_at_failure": fail and fail["rsrp"],
        "post_ho_gain_db": None if post is None or not known(post["rsrp"], h["source"]["rsrp"]) else post["rsrp"] - h["source"]["rsrp"],
        "better_ts": after(in_w, lambda p: p in levels and target(p) > p["rsrp"]),
        "a3_like_ts": after(in_w, lambda p: p in levels and eff(p) >= pick(h["a3_offset"], cfg.default_a3_offset_db)),
        "trigger_like_ts": after(in_x, lambda p: p in levels and eff(p) >= cfg.significant_delta_db),
        "serving_weak_ts": first(in_x, lambda p: known(p["rsrp"]) and p["rsrp"] <= cfg.serving_weak_rsrp_dbm),
        "target_visible_ts": first(in_x, on), "target_chosen_ts": first(in_x, lambda p: known(chosen(p))),
        "target_better_ts": first(in_x, lambda p: known(chosen(p), p["rsrp"]) and chosen(p) > p["rsrp"]),
        "significant_better_ts": first(in_x, lambda p: known(strongest(p), p["rsrp"]) and strongest(p) - p["rsrp"] >= 4),
        "window_points": len(in_x) if any_ else None, "visible_count": len(visible) if any_ else None,
        "chosen_count": sum(known(chosen(p)) for p in in_x) if any_ else None,
        "longest_gap_ms": max((q["ts_ms"] - p["ts_ms"] for p, q in zip(visible, visible[1:])), default=None),
        "alt_intra": other(in_w, pick(h["report_ts"], h["command_ts"], h["source"]["ts_ms"]), se, (tp, sp)),
        "alt_inter": other(in_x, h["source"]["ts_ms"], te, (tp,)),
    }


def test_handover_evidence_without_pairs(spark, monkeypatch):
    """Nulls everywhere, samples of one time, handovers across a stretch's edge, empty windows and unknown devices."""
    monkeypatch.setattr(timejoin, "window_pairs", lambda *a, **k: pytest.fail("all pairs of a window"))
    rng = random.Random(11)
    maybe = lambda x, share=0.15: None if rng.random() < share else x
    cfg = H.HoConfig()
    level = lambda: maybe(float(rng.randint(-115, -85)))
    cell = lambda: dict(pci=maybe(rng.randint(1, 3)), earfcn=maybe(rng.choice([1320, 3050])), eci=maybe(rng.choice("ab"), 0.4), rsrp=level(), rsrq=level(), sinr=None)
    points = [dict(log_id=1, device_id=maybe(rng.randint(0, 1), 0.03), seq=i, ts_ms=maybe(3_580_000 + 250 * rng.randint(0, 160), 0.03), pci=maybe(rng.randint(1, 3)),
                   earfcn=maybe(rng.choice([1320, 3050])), rsrp=level(), rsrq=None, sinr=None, neighbors=maybe([cell() for _ in range(rng.randint(0, 3))], 0.1)) for i in range(300)]
    hos = []
    for i in range(120):
        start = 3_575_000 + 250 * rng.randint(0, 200) if i else 50_000
        command = maybe(start + 500 * rng.randint(-4, 4), 0.4)
        anchor = start if command is None else command
        side = lambda ts: dict(cell(), ts_ms=ts, neighbors=[cell()])
        hos.append(dict(
            log_id=1, device_id=maybe(rng.randint(0, 2), 0.05), transition_no=i, start_ts=start, command_ts=command, anchor_ts=anchor, report_ts=maybe(anchor - 250 * rng.randint(-8, 8), 0.4),
            complete_ts=maybe(anchor + 250 * rng.randint(0, 12), 0.3), fail_ts=maybe(anchor + 250 * rng.randint(0, 20), 0.5), a3_json=None, source_pci=maybe(rng.randint(1, 3)),
            source_earfcn=maybe(rng.choice([1320, 3050])), target_pci=maybe(rng.randint(1, 3)), target_earfcn=maybe(rng.choice([1320, 3050])), serving_cio=maybe(1.0, 0.6),
            target_cio=maybe(2.0, 0.6), a3_offset=maybe(2.0, 0.6), source=side(start - 1000), target=side(start)))
    got = {r.transition_no: r for r in H.ho_enrich(spark.createDataFrame(hos, HO), spark.createDataFrame(points, POINT), cfg).collect()}
    assert len(got) == len(hos)
    for h in hos:
        want = evidence(h, points if h["device_id"] is not None else [], cfg)
        r = got[h["transition_no"]].asDict()
        mine = {c: r[c] and (r[c].delta, r[c].pci, r[c].rsrq) if c.startswith("alt_") else r[c] for c in want}
        if h["report_ts"] is not None:
            mine["a3_like_ts"] = r["a3_like_ts"]
        assert mine == want, h


def test_call_flags_and_timeline_equal_a_look_at_all_entries(spark, monkeypatch):
    """Entries of other calls, repeated entries, unknown headers and ends before the start; no timeline is formed for the flags."""
    from drivescope.operators import sessions

    rng = random.Random(3)
    maybe = lambda x, share=0.1: None if rng.random() < share else x
    heads, raws = ["CAA", "CAD", "RRC", "SHO", "L3SM"], ["HANDOVER x", "ADMISSION", "REJECT", "Paging", "SETUP"]
    events = [(maybe(rng.randint(1, 3)), maybe(rng.randint(0, 9)), maybe(rng.randint(0, 60)), i, maybe(rng.choice(heads)), maybe(rng.choice(raws))) for i in range(160)]
    calls = [(rng.randint(1, 4), i, maybe(rng.randint(0, 50)), maybe(rng.randint(0, 60))) for i in range(40)] + [(None, 99, 0, 60)]
    e = spark.createDataFrame(events, "device_id long, call_id long, ts_ms long, seq long, header string, raw string")
    s = spark.createDataFrame(calls, "device_id long, call_id long, start_ts long, end_ts long")
    timeline = sessions.session_timeline(s, e, bucket_ms=7)
    want = {}
    for d, c, start, end in calls:
        for dev, call, t, seq, head, raw in events:
            if None in (d, start, end, t) or dev != d or not start <= t <= end or not (call == c or (head is not None and head not in sessions.CALL_HEADERS)):
                continue
            want[d, c, t, head, raw] = min(seq, want.get((d, c, t, head, raw), seq))
    assert {(r.device_id, r.call_id, r.ts_ms, r.header, r.raw): r.seq for r in timeline.collect()} == want and timeline.count() == len(want)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))
    flags = order(sessions.timeline_flags(timeline).collect())
    monkeypatch.setattr(timejoin, "span_join", lambda *a, **k: pytest.fail("whole timelines"))
    assert len(flags) > 10 and order(sessions.session_flags(s, e, block_ms=9).collect()) == flags


def test_radio_windows_without_pairs(spark, monkeypatch):
    """Power and block errors of a window with nulls, ties and repeated times."""
    from drivescope.operators import radio

    rng = random.Random(4)
    maybe = lambda x, share=0.15: None if rng.random() < share else x
    tx = [(maybe(rng.randint(1, 2)), maybe(rng.randint(0, 300)), i, maybe(float(rng.randint(-5, 20)))) for i in range(250)]
    bler = [(maybe(rng.randint(1, 2)), maybe(rng.randint(0, 300)), i, maybe(float(rng.randint(0, 100))), maybe(rng.randint(0, 100) / 4)) for i in range(120)]
    calls = [(rng.randint(1, 3), i, maybe(rng.randint(-20, 340))) for i in range(60)]
    servers = spark.createDataFrame([], "device_id long, ts_ms long, row_seq long, psc long, rscp double, ecno double, rssi double, cell_id long, uarfcn long, pilots long, gap double")
    joined, plain = [], timejoin.interval_join
    monkeypatch.setattr(timejoin, "interval_join", lambda a, rows, *x, **k: joined.append(rows.columns) or plain(a, rows, *x, **k))
    d = radio.radio_snapshot(
        spark.createDataFrame(calls, "device_id long, call_id long, end_ts long"), servers, spark.createDataFrame(tx, "device_id long, ts_ms long, seq long, tx double"),
        spark.createDataFrame(bler, "device_id long, ts_ms long, seq long, bler_max double, bler_mean double"), window_ms=40)
    got = {r.call_id: r for r in d.collect()}
    assert joined == [servers.columns]
    assert set(got) == {c for _, c, end in calls if end is not None}
    for dev, c, end in calls:
        if end is None:
            continue
        inside = lambda rows: sorted((r for r in rows if r[0] == dev and r[1] is not None and end - 40 <= r[1] <= end), key=lambda r: r[1:3])
        p, b = [r for r in inside(tx) if r[3] is not None], inside(bler)
        worst, mean = [r[3] for r in b if r[3] is not None], [r[4] for r in b if r[4] is not None]
        r = got[c]
        assert (r.tx_count, r.tx_last, r.last_tx_ts, r.tx_max) == ((len(p), p[-1][3], p[-1][1], max(x[3] for x in p)) if p else (0, None, None, None))
        assert r.tx_p90 == (sorted(x[3] for x in p)[math.ceil(0.9 * len(p)) - 1] if p else None)
        assert (r.bler_rows, r.bler_max) == (len(b), max(worst, default=None))
        assert r.bler_mean == (pytest.approx(sum(mean) / len(mean)) if mean else None)
        assert r.bler_trend == (b[-1][4] - b[0][4] if b and None not in (b[-1][4], b[0][4]) else None)


def _anchored(rows, span):
    """Buckets of sorted rows, (time, ...) each, as lists."""
    out = []
    for r in rows:
        if not out or r[0] - out[-1][0][0] > span:
            out.append([])
        out[-1].append(r)
    return out


def _asked_and_sampled(spark):
    """Asked times, one of them three times and one id with two times, and samples with nulls, ties and unknown values."""
    rng = random.Random(11)
    asked = [(run, i, rng.randint(0, 900)) for run in (1, 2) for i in range(25)] + [(1, 90, 300)] * 3 + [(2, 91, 100), (2, 91, 130), (2, 92, None), (3, 93, 100)]
    names = ["Pci", "Rsrp", "Rsrq", "Cinr", "Earfcn"]
    nan = float("nan")
    value = {"Pci": lambda: rng.choice([None, 1.0, 2.0, 2.5, 3.5]), "Rsrp": lambda: rng.choice([None, -90.0, -80.0, -80.0, nan]), "Rsrq": lambda: float(rng.randint(-19, -3)),
             "Cinr": lambda: rng.choice([None, 1.0, 2.0]), "Earfcn": lambda: rng.choice([2640.0, 6101.0])}
    samples = [(rng.choice([1, 1, 2, None]), rng.choice([rng.randint(0, 900), rng.randint(0, 90) * 10]), i, rng.choice([None, 0, 1, 2]), f"Radio.Lte.Neighbor[64].{n}", value[n]())
               for i, n in ((i, rng.choice(names)) for i in range(900))]
    times = spark.createDataFrame(asked, "run_id long, time_id long, ts_ms long")
    return asked, samples, times, spark.createDataFrame(samples, "run_id long, ts_ms long, seq long, idx long, name string, value_num double")


def _windows_of(asked, samples, reach):
    """The samples of each (run, id), one list a field, in order; a sample stands once for every asked time that holds it."""
    found = {}
    for run, i, t in asked:
        for r in samples:
            if t is not None and r[0] == run and abs(r[1] - t) <= reach:
                v = r[5]
                found.setdefault((run, i), {}).setdefault(r[4].split(".")[-1].lower(), []).append(
                    (r[1], r[3] or 0, r[2], (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v), v))
    return {k: {f: sorted(x, key=lambda y: y[:4]) for f, x in d.items()} for k, d in found.items()}


def test_buckets_around_asked_times(spark):
    asked, samples, times, rows = _asked_and_sampled(spark)
    want = set()
    for (run, i), fields in _windows_of(asked, samples, 70).items():
        for f, x in fields.items():
            want |= {(run, i, f, n, b[0][0], b[-1][0], round(sum(y[0] for y in b) / len(b)), len(b)) for n, b in enumerate(_anchored(x, 25))}
    got = neighbors.bucket_by_time(times, neighbors.tag_fields(rows, neighbors.NEIGHBOR_CANDIDATES), 70, 25).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500


def test_pairs_by_position_around_asked_times(spark):
    asked, samples, times, rows = _asked_and_sampled(spark)
    low, want = float("-inf"), {}
    for key, fields in _windows_of(asked, samples, 70).items():
        def cut(f, fields=fields):
            return [(round(sum(y[0] for y in b) / len(b)), [y[4] for y in b if y[4] is not None]) for b in _anchored(fields.get(f, []), 25)]

        of = {f: cut(f) for f in ("rsrp", "rsrq", "cinr", "earfcn")}
        for n, (center, values) in enumerate(cut("pci")):
            near = {f: min(((abs(c - center), j, v) for j, (c, v) in enumerate(b) if abs(c - center) <= 25), default=(0, 0, []))[2] for f, b in of.items()}
            for pos, pci in enumerate(values):
                at = {f: v[pos] if pos < len(v) else None for f, v in near.items()}
                level = at["rsrp"]
                score = (level is not None, (0, low) if level is None else (1, 0.0) if level != level else (0, level), low if at["cinr"] is None else at["cinr"], -center, -n, -pos)
                of_pci = want.setdefault((*key, round(pci)), (score, None))
                if of_pci[1] is None or score > of_pci[0]:
                    want[*key, round(pci)] = score, (*[str(at[f]) for f in ("rsrp", "rsrq", "cinr")], None if at["earfcn"] is None else round(at["earfcn"]), center, pos)
    got = neighbors.pair_by_position(times, rows, None, 70, 25).collect()
    assert {(r.run_id, r.time_id, r.pci): (str(r.rsrp), str(r.rsrq), str(r.cinr), r.earfcn, r.bucket_ts, r.pair_index) for r in got} == {k: v for k, (_, v) in want.items()}
    assert len(got) == len(want) > 100


def test_steps_of_pairs_give_the_same():
    rng = np.random.default_rng(2)
    n = 400
    v = rng.integers(0, 4, n).astype(float)
    rows = pa.table({"ts_ms": np.sort(rng.integers(0, 500, n)), "field": rng.choice(["pci", "rsrp", "rsrq", "cinr", "earfcn"], n), "v": v, "_pci": v.astype(int)})
    asked = pa.table({"time_id": np.arange(40), "_times": rng.integers(1, 3, 40)})
    lo = np.sort(rng.integers(0, n, 40))
    found = [neighbors._best_pairs(asked, rows, lo, np.minimum(lo + 150, n), 30, ["time_id"], at_once).to_pylist() for at_once in (1 << 20, 100, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
