"""Ordered operations, nearest joins and ranks against brute force, with blocks far shorter than the data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from drivescope.operators import ordered, quantiles, series, timejoin

BLOCK = 50


@pytest.fixture(scope="module")
def rows():
    """A third of the rows sit in one key; times repeat, gaps are longer than several blocks."""
    rng = random.Random(7)
    out = []
    for seq in range(600):
        key = 0 if rng.random() < 0.34 else rng.randint(1, 6)
        ts = rng.randint(0, 300) if rng.random() < 0.8 else rng.randint(3000, 3200)
        out.append((key, ts, seq, rng.choice([None, round(rng.uniform(-5, 5), 2)])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k long, ts_ms long, seq long, v double").repartition(5)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_neighbors_last_known_and_totals(table, rows):
    d = ordered.with_neighbors(table, ["k"], previous={"p": "v", "ps": "seq"}, following={"ns": "seq"}, block_ms=BLOCK)
    d = ordered.with_last_known(d, ["k"], {"known": F.col("v")}, block_ms=BLOCK)
    d = ordered.with_running_sum(d, ["k"], {"total": F.when(F.col("v").isNull(), 1).otherwise(0)}, block_ms=BLOCK)
    d = ordered.with_row_number(d, ["k"], "pos", block_ms=BLOCK)
    got = {r.seq: r for r in d.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        known, total = None, 0
        for i, (_, _, seq, v) in enumerate(group):
            known, total = (v if v is not None else known), total + (v is None)
            r = got[seq]
            assert r.ps == (group[i - 1][2] if i else None) and r.p == (group[i - 1][3] if i else None)
            assert r.ns == (group[i + 1][2] if i + 1 < len(group) else None)
            assert (r.known, r.total, r.pos) == (known, total, i + 1)


@pytest.mark.parametrize("tolerance", [0, 7, 120])
def test_nearest_join(table, rows, tolerance):
    left = table.where("seq % 2 = 0").select("k", "ts_ms", "seq")
    right = table.where("seq % 2 = 1").select("k", "ts_ms", "seq")
    got = {r.seq: r.match.seq for r in timejoin.nearest_join(left, right, ["k"], tolerance, block_ms=BLOCK).collect()}
    want = {}
    for group in by_key(rows).values():
        rs = [r for r in group if r[2] % 2]
        for _, t, seq, _ in (r for r in group if r[2] % 2 == 0):
            before = [r for r in rs if r[1] <= t]
            after = [r for r in rs if r[1] > t]
            best = before[-1] if before else None
            if after and (best is None or after[0][1] - t < t - best[1]):
                best = after[0]
            if best and abs(best[1] - t) <= tolerance:
                want[seq] = best[2]
    assert got == want


def test_interval_join_has_each_pair_once(table, rows):
    a, b = table.where("seq % 3 = 0").select("k", "ts_ms", "seq"), table.where("seq % 3 = 1").select("k", "ts_ms", "seq")
    got = sorted((r.seq, r.row.seq) for r in timejoin.interval_join(a, b, ["k"], 20, 5).collect())
    want = sorted((x[2], y[2]) for x in rows for y in rows
                  if x[2] % 3 == 0 and y[2] % 3 == 1 and x[0] == y[0] and x[1] - 20 <= y[1] <= x[1] + 5)
    assert got == want


def test_ranks_match_sorted_positions(table, rows):
    ranks = {"p90": quantiles.nearest_rank(0.9), "low": quantiles.floor_index(0.5), "up": quantiles.upper_median(), "even": quantiles.half_even_index(0.9)}
    got = {r.k: r for r in quantiles.pick_ranks(table, ["k"], "v", ranks).collect()}
    med = {r.k: r.m for r in quantiles.median(table, ["k"], "v", "m").collect()}
    for k, group in by_key(rows).items():
        v = sorted(r[3] for r in group if r[3] is not None)
        n = len(v)
        assert got[k].n == n
        assert got[k].p90 == v[math.ceil(0.9 * n) - 1] and got[k].low == v[math.floor(0.5 * (n - 1))]
        assert got[k].up == v[n // 2] and got[k].even == v[round(0.9 * (n - 1))]
        assert med[k] == pytest.approx((v[(n - 1) // 2] + v[n // 2]) / 2)


def test_dips_and_downsample(spark):
    v = [9, 1, 2, 9, 3, 9, 1, 1, 1]
    d = spark.createDataFrame([(0, "m", i * 1000, i, float(x)) for i, x in enumerate(v)], "run_id long, name string, ts_ms long, seq long, value_num double")
    got = sorted((r.start_index, r.end_index, r.min_value, r.duration_sec) for r in series.detect_dips(d, threshold=5, min_duration_sec=1, block_ms=2000).collect())
    assert got == [(1, 2, 1.0, 1.0), (6, 8, 1.0, 2.0)]
    kept = sorted(r.seq for r in series.downsample(d, ["run_id", "name"], 4, block_ms=2000).collect())
    assert kept == [round(i * 8 / 3) for i in range(4)]
    assert sorted(r.seq for r in series.downsample(d, ["run_id"], 2).collect()) == [0, 8]


@pytest.mark.parametrize("before, after", [(0, 0), (7, 20), (400, 30)])
def test_window_pairs_hold_every_pair_once_and_need_no_shuffle(spark, table, rows, before, after):
    anchors = table.where("seq % 3 = 0 or ts_ms is null").select("k", "ts_ms", F.col("seq").alias("a"))
    samples = table.unionByName(spark.createDataFrame([(0, None, 9001, 1.0)], table.schema))
    pairs = timejoin.window_pairs(anchors, samples, ["k"], before, after)
    got = sorted((r.a, r.s) for r in pairs.select("a", F.col("row.seq").alias("s")).collect())
    want = sorted((a[2], b[2]) for a in rows if a[2] % 3 == 0 for b in rows if a[0] == b[0] and a[1] - before <= b[1] <= a[1] + after)
    assert got == want
    counted = pairs.groupBy("k", "_bucket", "a").count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # one for each side, none for the pairs
    assert {r.a: r["count"] for r in counted.collect()} == {a: sum(1 for x in want if x[0] == a) for a in {x[0] for x in want}}


@pytest.mark.parametrize("before, after", [(20, 5), (0, 90), (400, 400)])
def test_nearest_pairs_give_what_all_pairs_give_but_two_a_class(spark, table, before, after):
    """Windows full of rows: an anchor keeps its nearest rows only, and every nearest-row aggregate is that of all pairs."""
    anchors = table.where("seq % 3 = 0").select("k", "ts_ms", F.col("seq").alias("a"), F.when(F.col("seq") % 9 != 0, F.col("seq") % 4).alias("cell"))
    anchors = anchors.unionByName(spark.createDataFrame([(None, 50, 9002, 1), (0, None, 9003, 1)], anchors.schema))
    samples = table.select("k", "ts_ms", "seq", F.when(F.col("seq") % 5 != 0, F.col("seq") % 4).alias("cell"), (F.col("seq") % 7 == 1).alias("exact"))
    samples = samples.unionByName(spark.createDataFrame([(None, 50, 9004, 1, True), (0, None, 9005, 1, True)], samples.schema))
    near, at = F.col("exact"), F.col("ts_ms")
    aggs = {"nearest": timejoin.nearest_event(at), "first": timejoin.first_event_after(at, after), "best": timejoin.preferred_report(at, F.col("row.exact"))}
    seqs = lambda d: sorted((r.a, *(r[n] and r[n].seq for n in aggs)) for r in d.collect())
    got = timejoin.reduce_nearest(anchors, samples, ["k"], before, after, ["a"], aggs, [near, ~near])
    assert seqs(got) == seqs(timejoin.reduce_window(anchors, samples, ["k"], before, after, ["a"], aggs))
    pairs = timejoin.nearest_pairs(anchors, samples, ["k"], before, after, [near, ~near]).groupBy("a").count()
    assert pairs.agg(F.max("count")).head()[0] <= 4
    own, given = F.col("cell"), F.col("row.cell")
    for unknown in (False, True):
        ok = given.isNull() | (given == own) | (own.isNull() if unknown else F.lit(False))
        got = timejoin.reduce_nearest(anchors, samples, ["k"], before, after, ["a"], aggs, [near, ~near], match=("cell", "cell"), unknown_matches=unknown)
        assert seqs(got) == seqs(timejoin.reduce_window(anchors, samples, ["k"], before, after, ["a"], aggs, condition=ok))
