"""What is asked of the lists of a setup failure's context, without the lists."""

import random

import pytest

from drivescope.operators import ordered, sessions, timejoin

HOUR = 3_600_000


def drawn(spark):
    rng = random.Random(17)
    calls = [(d, c, rng.choice([None, t]), t + rng.choice([-5, 0, 1, HOUR // 3, 30]) * rng.choice([1, HOUR])) for d in (1, 2, None) for c in range(12) for t in [rng.randint(0, 60) * HOUR]]
    calls += [(1, None, 0, 90 * HOUR), (1, 3, 7, None), (2, 90, 500 * HOUR, 500 * HOUR + 1)] + [calls[2]]
    raws = ["DIRECT_TRANSFER up", "admission", "RELEASE", "SETUP", None]
    events = [(rng.choice([1, 2, None]), rng.choice([None, rng.randint(-5, 100) * HOUR, rng.randint(-5, 100) * HOUR + 1]), rng.choice([i, i, i, None]), i % 4, rng.choice(["SHO", "CAD", None]),
               rng.choice([*raws, *raws[2:] * 2])) for i in range(400)]
    s = spark.createDataFrame(calls, "device_id long, call_id long, start_ts long, end_ts long").selectExpr("*", "cast(null as long) as connected_ts", "'CALL_SETUP_FAILURE' as result_type")
    e = spark.createDataFrame(events + events[::5], "device_id long, ts_ms long, seq int, call_id long, header string, raw string")
    return s, e, s.selectExpr("device_id", "call_id", "1 as mimo_count").distinct()


@pytest.mark.parametrize("limits", [{}, {"last_k": 2, "first_k": 3}, {"first_k": 1}])
def test_figures_are_those_of_the_lists(spark, limits):
    s, e, snap = drawn(spark)
    rows = sessions.setup_failure_context(s, e, snap, around_ms=3 * HOUR, **limits).collect()
    assert len(rows) == s.where("end_ts is not null").count() + 2  # a call that comes twice meets its mobility twice
    assert sum(r.last_count > 1 for r in rows) > 5 and sum(r.first_count >= 1 for r in rows) > 5
    assert {r.transfer_seen for r in rows} == {r.congestion_seen for r in rows} == {True, False}
    for r in rows:
        last, first = r.last_events or [], r.first_events or []
        assert (r.last_count, r.first_count) == (len(last), len(first))
        assert r.last_first_seq == min((x.seq for x in last if x.seq is not None), default=None) and r.first_last_seq == max((x.seq for x in first if x.seq is not None), default=None)
        told = [x.raw or "" for x in [*first, *last]]
        assert (r.transfer_seen, r.congestion_seen) == (any("DIRECT" in x for x in told), "admission" in told)


@pytest.mark.parametrize("wanted", [["direct_transfer", "congestion_near_end", "deep_score"], ["events_in_window", "last_count", "last_first_seq", "first_count", "first_last_seq"]])
def test_scores_and_counts_form_no_list(spark, wanted):
    s, e, snap = drawn(spark)
    for n, kind in {"tx_p90": "double", "rscp_median": "double", "ecno_median": "double", "bler_max": "double", "bler_evidence": "boolean"}.items():
        snap = snap.selectExpr("*", f"cast(null as {kind}) as {n}")
    d = sessions.setup_failure_context(s, e, snap, around_ms=3 * HOUR).selectExpr(
        "*", "0 as cad_cause", "'SETUP_FAIL_UNKNOWN' as category", "end_ts as end_ts_caf", "end_ts as end_ts_cad", "end_ts as end_ts_care")
    plan = sessions.setup_failure_deep_analysis(d).select(*wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_widths_fit_their_spans(spark):
    spans = lambda *x: ordered.span_widths(spark.createDataFrame([(0, n) for n in x], "a long, b long"), "a", "b")
    assert spans(64 * HOUR - 1, 0, None) == [64 * HOUR, 8 * HOUR, HOUR]
    assert spans(64 * HOUR - 1, 8 * HOUR) == [64 * HOUR] and spans(64 * HOUR - 1, 8 * HOUR - 1) == [64 * HOUR, 8 * HOUR]
    assert spans(None) == spans(-5) == [1]


def test_long_arrays_are_dealt_over_more_tasks(spark):
    rows = spark.range(400).selectExpr("id % 2 as device_id", "id * 100000 as ts_ms", "id as seq")
    anchors = spark.range(40).selectExpr("id % 2 as device_id", "id as call_id", "id * 900000 as start_ts", "id * 900000 + 3000000 as end_ts")

    def around(**how):
        d = timejoin.with_rows_around(anchors, rows, ["device_id"], "start_ts", "end_ts", ["seq"], ["device_id", "call_id"], **how)
        return d.rdd.getNumPartitions(), sorted((r.call_id, [x.r.seq for x in r.around if r.start_ts <= x.t <= r.end_ts]) for r in d.collect())

    (few, want), (many, got) = around(), around(at_once=16, size=400)
    assert (few, many) == (4, 50) and got == want and all(len(x) in (15, 16) for _, x in want[:40] if x)
