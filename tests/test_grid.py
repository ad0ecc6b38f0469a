"""Neighbour context of track points, against one look at all pairs."""

import math
import random
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from drivescope.operators import neighbors

FIELDS = ["Pci", "Rsrp", "Rsrq", "Cinr", "Earfcn", "Frequency", "Other"]
BASE, WIDE, BUCKET = 40, 90, 30


def tenth(x):
    return x if x is None or math.isnan(x) else float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP)) + 0.0


def looked_up(points, samples, scale):
    """The result by all pairs, as the rows of each point."""
    out = []
    asked = defaultdict(list)
    for run, point, t in points:
        if run is not None and t is not None:
            asked[run, point].append(t)
    for (run, point), times in asked.items():
        pairs = []
        for t in times:
            for r, ts, seq, idx, name, v in samples:
                field = {"frequency": "earfcn"}.get(name.lower(), name.lower())
                if r == run and ts is not None and v is not None and field != "other" and abs(ts - t) <= WIDE:
                    pairs.append((abs(ts - t) <= BASE, field, ts, idx, seq, v))
        enough = point is not None and len({math.floor(v + 0.5) for near, f, *_, v in pairs if near and f == "pci"}) >= 2
        lists = defaultdict(list)
        for near, f, ts, idx, seq, v in pairs:
            if near or not enough:
                lists[ts // BUCKET, f].append((ts, idx, seq, v))
        slots = []
        for b in sorted({b for b, _ in lists}):
            held = {f: [x[-1] for x in sorted(lists[b, f])] for f in ("pci", "rsrp", "rsrq", "cinr", "earfcn")}
            n = len(held["pci"]) or max(map(len, held.values()))
            slots += [(b, i, {f: x[i] if i < len(x) else None for f, x in held.items()}) for i in range(n)]
        if any(s["pci"] is not None for *_, s in slots):
            slots = [x for x in slots if x[2]["pci"] is not None]
        groups = defaultdict(list)
        for b, i, s in slots:
            groups[f"pos:{b}:{i}" if s["pci"] is None else f"pci:{math.floor(s['pci'] + 0.5)}"].append((b, i, s))
        rows = []
        halves = scale.get(run) or [None]
        for key, members in groups.items():
            mean = {}
            for f in ("rsrp", "rsrq", "cinr"):
                some = [s[f] for *_, s in members if s[f] is not None]
                mean[f] = tenth(sum(some) / len(some)) if some else None
            votes = Counter()
            for *_, s in members:
                for h in halves if s["earfcn"] is not None else []:
                    e = math.floor(s["earfcn"] + 0.5)
                    votes[e // 2 if h == 2 and e % 2 == 0 else e] += 1
            channel = min(votes, key=lambda e: (-votes[e], e)) if votes and point is not None else None
            pci = None if key.startswith("pos") else int(key[4:])
            rows.append([run, point, not enough, key, pci, mean["rsrp"], mean["rsrq"], mean["cinr"], len(members) * len(halves), channel, min((b, i) for b, i, _ in members)])
        level = lambda r: -999.0 if r[5] is None else r[5]
        rows.sort(key=lambda r: (not math.isnan(level(r)), 0 if math.isnan(level(r)) else -level(r), -r[8], r[4] or 0, r[10][1], r[10][0]))
        out += [(*r[:10], f"N{i}") for i, r in enumerate(rows, 1)]
    return sorted(map(repr, out))


def drawn(seed, n=260, codes=4):
    rng = random.Random(seed)
    samples = []
    for seq in range(n):
        field = rng.choice(FIELDS)
        v = {"Pci": rng.choice([*range(codes), 1.4]), "Rsrp": -100 + rng.randrange(40) / 4, "Rsrq": float(rng.randrange(9)), "Cinr": rng.choice([1.5, 2.25, math.nan])}.get(field, float(rng.randrange(8)))
        samples.append((rng.choice([0, 0, 1, None]), rng.choice([rng.randrange(-100, 900), None] + [rng.randrange(900)] * 9), seq, rng.randrange(3), field, rng.choice([v] * 9 + [None])))
    samples = [x for x in samples if not (x[0] == 1 and x[4] == "Pci" and (x[1] or 0) > 500)]  # a stretch without codes
    points = [(rng.choice([0, 1, None]), rng.choice([rng.randrange(60), None] + [rng.randrange(60)] * 20), rng.randrange(-50, 1000)) for _ in range(90)]
    return points + points[:12], samples


def found(spark, points, samples, scale):
    p = spark.createDataFrame(points, "run_id long, point_id long, ts_ms long")
    s = spark.createDataFrame([(r, t, q, i, f"Radio.Lte.Neighbor[64].{f}", None if v is None else float(v)) for r, t, q, i, f, v in samples], "run_id long, ts_ms long, seq long, idx long, name string, value_num double")
    k = spark.createDataFrame([(r, d) for r, ds in scale.items() for d in ds], "run_id long, scale_div long") if scale else None
    d = neighbors.grid_bucket_neighbors(p, s, k, BASE, WIDE, BUCKET)
    return [tuple(r) for r in d.select("run_id", "point_id", "expanded", "group_key", "pci", "rsrp", "rsrq", "cinr", "sample_count", "earfcn", "label").collect()]


@pytest.mark.parametrize("scale", [{}, {0: [2]}, {0: [2, None, 2], 1: [2, 1]}])
def test_grid_buckets_equal_a_look_at_all_pairs(spark, scale):
    points, samples = drawn(len(scale))
    want = looked_up(points, samples, scale)
    assert any("pos:" in x for x in want) and any("False" in x for x in want) and any("None" in x.split(",")[1] for x in want)
    assert sorted(map(repr, found(spark, points, samples, scale))) == want


def test_grid_buckets_stage_no_pairs(spark, monkeypatch):
    staged, keep = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda d, label="stage": staged.append((d := keep(d, label)).count()) or d)
    points = [(0, i, i % 90) for i in range(200)]
    _, samples = drawn(9)
    samples = [(0, *x[1:]) for x in samples]
    assert sorted(map(repr, found(spark, points, samples, {}))) == looked_up(points, samples, {})
    assert sum(staged) <= len(points)


def test_grid_slots_are_held_in_steps(monkeypatch):
    import pyarrow as pa

    points, samples = drawn(4)
    rows = sorted((t, i, q, f.lower(), float(v)) for r, t, q, i, f, v in samples if r == 0 and None not in (t, v) and f not in ("Other", "Frequency"))
    rows = pa.table({"ts_ms": [r[0] for r in rows], "field": [r[3] for r in rows], "v": pa.array([r[4] for r in rows]), "_copies": [1] * len(rows), "_halved": [0] * len(rows)})
    at = np.array(sorted(t for r, _, t in points if r == 0))
    asked = pa.table({"run_id": [0] * len(at), "time_id": list(range(len(at))), "_first": at, "_times": [1] * len(at)})
    t = rows["ts_ms"].to_numpy()
    lo, hi = np.searchsorted(t, at - WIDE), np.searchsorted(t, at + WIDE, "right")
    one = lambda n: [repr(r) for r in neighbors._grid_groups(asked, rows, lo, hi, BASE, BUCKET, ["run_id", "time_id"], n).sort_by([("time_id", "ascending"), ("rank", "ascending")]).to_pylist()]
    assert one(1) == one(7) == one(1 << 20)


def test_tenths_round_as_spark_does(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    values = [s / n for n in (1, 3, 8, 20, 40, 60) for s in range(-400, 400, 7)] + [rng.uniform(-200, 200) for _ in range(200)] + [-0.04, 0.05, math.inf, 1e18, 8.05, 2.35]
    values += [float(np.nextafter(x / 20, y)) for x in range(-99, 99, 2) for y in (-999, 999)]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(F.round("v", 1)).collect()]
    assert [repr(float(x)) for x in neighbors._tenths(np.array(values, float))] == [repr(x) for x in want]
