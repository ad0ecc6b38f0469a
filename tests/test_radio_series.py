"""Sample lists before a call's end against brute force; timelines of sessions without rows."""

import random

from drivescope.operators import radio, sessions

WINDOW = 40


def test_series_hold_the_window_in_order(spark):
    rng = random.Random(3)
    calls = [(d, c, rng.choice([None, rng.randint(0, 300)])) for d in (1, 2) for c in range(12)] + [(9, 0, 100)]
    servers = [(rng.choice([1, 1, 2]), rng.randint(0, 300), i, rng.choice([None, 5, 6]), rng.choice([10, 11]), -80.0 - i % 7, -9.0) for i in range(150)]
    tx = [(rng.choice([1, 2]), rng.randint(0, 300), i, rng.choice([None, 1.0, 2.0])) for i in range(150)]
    bler = [(2, 100, 1, None, None), (2, 100, 0, 3.0, 1.0)]
    frame = spark.createDataFrame
    got = radio.radio_series(
        frame(calls, "device_id long, call_id long, end_ts long"),
        frame(servers, "device_id long, ts_ms long, row_seq long, psc long, uarfcn long, rscp double, ecno double"),
        frame(tx, "device_id long, ts_ms long, seq long, tx double"), frame(bler, "device_id long, ts_ms long, seq long, bler_max double, bler_mean double"),
        window_ms=WINDOW).collect()
    assert sorted((r.device_id, r.call_id) for r in got) == sorted((d, c) for d, c, end in calls if end is not None)
    ends = {(d, c): e for d, c, e in calls}
    for r in got:
        end = ends[r.device_id, r.call_id]
        inside = lambda rows: sorted((x for x in rows if x[0] == r.device_id and end - WINDOW <= x[1] <= end), key=lambda x: x[1:3])  # noqa: E731, B023
        seen = [(x[1], *x[3:]) for x in inside(servers)]
        assert [tuple(x) for x in r.server_series] == seen
        assert [tuple(x) for x in r.server_runs] == [x for i, x in enumerate(seen) if i == 0 or seen[i - 1][1:3] != x[1:3]]
        assert [tuple(x) for x in r.tx_series] == [(x[1], x[3]) for x in inside(tx) if x[3] is not None]
        assert [tuple(x) for x in r.bler_series] == [(x[1], x[3], x[4]) for x in inside(bler)]


def test_timelines_of_sessions_without_events_are_empty(spark):
    s = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 50, None)], "device_id long, call_id long, start_ts long, end_ts long")
    e = spark.createDataFrame([(1, 5, 2, None, "RRCSM", "b"), (1, 5, 1, None, "SHO", "a"), (1, 11, 3, None, "SHO", "c")],
                              "device_id long, ts_ms long, seq long, call_id long, header string, raw string")
    got = {r.call_id: [x.raw for x in r.event_timeline] for r in sessions.session_timelines(s, sessions.session_timeline(s, e, bucket_ms=7)).collect()}
    assert got == {1: ["a", "b"], 2: []}


def _calls_and_events(spark):
    rng = random.Random(8)
    hour = 3_600_000
    spans = [None, 0, 1, hour // 2, 5 * hour, 70 * hour]
    calls = [(d, c, None if c == 3 else start, rng.choice([start, start, None]) if span is None else start + span)
             for d in (1, 2, None) for c in range(20) for start, span in [(rng.randint(0, 90) * hour, rng.choice(spans))]] + [(1, None, 0, 90 * hour)]
    headers = ["SHO", "RRCSM", "CAD", "CAF", "L3SM", None]
    events = [(rng.choice([1, 2, None]), rng.choice([None, rng.randint(0, 160) * hour, rng.randint(0, 160) * hour + 1]), i, rng.choice([None, 0, 1, 2, 3]), rng.choice(headers),
               rng.choice(["REJECT", "SETUP", "x cause", None])) for i in range(700)]
    events += [(d, t, i + 10_000, c, h, r) for d, t, i, c, h, r in events[::3]]
    s = spark.createDataFrame(calls, "device_id long, call_id long, start_ts long, end_ts long").selectExpr(
        "*", "cast(null as long) as connected_ts", "'CALL_SETUP_FAILURE' as result_type")
    return calls, events, s, spark.createDataFrame(events, "device_id long, ts_ms long, seq long, call_id long, header string, raw string")


def test_timelines_from_events_equal_those_from_pairs(spark):
    calls, _, s, e = _calls_and_events(spark)
    series = s.where("call_id = 4").selectExpr("device_id", "call_id", "array(1) as server_series")
    got = sessions.session_timelines(s, series=series, events=e)
    want = sessions.session_timelines(s, sessions.session_timeline(s, e, bucket_ms=3_600_000), series)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert max(len(r.event_timeline) for r in got.collect()) > 30


def test_failure_contexts_equal_a_look_at_all_pairs(spark):
    calls, events, s, e = _calls_and_events(spark)
    snap, reach = s.selectExpr("device_id", "call_id", "1 as mimo_count"), 9_000_000
    key = lambda x: tuple((v is not None, v) for v in x)
    got = {(r.device_id, r.call_id): r for r in sessions.setup_failure_context(s, e, snap, around_ms=reach).collect()}
    few = {(r.device_id, r.call_id): r for r in sessions.setup_failure_context(s, e, snap, around_ms=reach, last_k=2, first_k=3).collect()}
    assert set(got) == {(d, c) for d, c, _, end in calls if end is not None} and len(got) > 30
    for d, c, start, end in (x for x in calls if x[3] is not None):
        mine = [] if d is None or c is None else [(x[1], x[2], x[4], x[5]) for x in events if x[0] == d and x[1] is not None]
        near = [x for x in mine if abs(x[0] - end) <= reach]
        last = sorted((x for x in near if x[0] <= end), key=key)
        first = sorted((x for x in mine if start is not None and start <= x[0] <= end + reach), key=key)
        ends = [x for x in near if (x[3] or "").lower() in ("reject", "x cause") or x[2] in ("CAD", "CAF")]
        r, k = got[d, c], few[d, c]
        assert r.events_in_window == len(near) == k.events_in_window
        assert [tuple(x) for x in r.last_events or ()] == last and [tuple(x) for x in k.last_events or ()] == last[-2:]
        assert [tuple(x) for x in r.first_events or ()] == first and [tuple(x) for x in k.first_events or ()] == first[:3]
        assert (r.last_events is None, r.first_events is None) == (not last, not first)
        best = min(ends, key=lambda x: (abs(x[0] - end), x[0], x[1]), default=None)
        assert (r.closest_release and tuple(r.closest_release)) == best
