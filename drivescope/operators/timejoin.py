"""Joins in time: nearest, as-of, interval, nearest/first event.

Nearest and as-of joins put both sides on one timeline, windowed per (key, time block). Interval joins turn the range
predicate into an equi-join on time buckets, so no pair is formed outside the asked window and a hot device is
spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.operators.ordered import HOUR_MS, attach, block_of, span_widths, with_last_known

_SIDE = "_side"


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance_ms: int,
    *,
    left_ts: str = "ts_ms",
    left_seq: str = "seq",
    right_ts: str = "ts_ms",
    right_seq: str = "seq",
    value: str = "match",
    how: str = "inner",
    block_ms: int = HOUR_MS,
    first_of_ties: bool = False,
) -> DataFrame:
    """Closest right row within ``tolerance_ms`` (inclusive) of each left row; a tie goes to the earlier one.

    Among right rows of one timestamp at or before the left row the last wins (``first_of_ties`` takes the first).
    The right row arrives as struct ``value`` with the signed distance ``<value>_delta_ms``.
    """
    block_ms = max(block_ms, tolerance_ms + 1)
    payload = F.struct(*[F.col(c) for c in right.columns])
    lrows = left.select(
        *[F.col(k) for k in keys],
        F.col(left_ts).alias("_t"),
        F.lit(1).alias(_SIDE),
        F.col(left_seq).cast("long").alias("_s"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
        F.lit(None).cast(right.select(payload.alias("r")).schema["r"].dataType).alias("_r"),
        block_of(left_ts, block_ms).alias("_b"),
    )
    reach = F.array_distinct(F.array(*[block_of(F.col(right_ts) + d, block_ms) for d in (-tolerance_ms, 0, tolerance_ms)]))
    rrows = right.select(
        *[F.col(k) for k in keys],
        F.col(right_ts).alias("_t"),
        F.lit(0).alias(_SIDE),
        F.col(right_seq).cast("long").alias("_s"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"),
        payload.alias("_r"),
        F.explode(reach).alias("_b"),
    )
    if first_of_ties:
        dup = Window.partitionBy(*keys, "_b", "_t").orderBy("_s")
        rrows = rrows.withColumn("_n", F.row_number().over(dup)).where("_n = 1").drop("_n")
    both = lrows.unionByName(rrows)
    part = [*keys, "_b"]
    back = Window.partitionBy(*part).orderBy("_t", _SIDE, "_s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = (
        Window.partitionBy(*part)
        .orderBy(F.desc("_t"), F.desc(_SIDE), F.desc("_s"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    stamped = F.when(F.col(_SIDE) == 0, F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    d = (
        both.withColumn("_prev", F.last(stamped, ignorenulls=True).over(back))
        .withColumn("_next", F.last(stamped, ignorenulls=True).over(ahead))
        .where(F.col(_SIDE) == 1)
    )
    dp, dn = F.col("_t") - F.col("_prev.t"), F.col("_next.t") - F.col("_t")
    best = F.when(dn.isNotNull() & (dp.isNull() | (dn < dp)), F.col("_next")).otherwise(F.col("_prev"))
    d = d.withColumn("_best", best)
    near = F.abs(F.col("_best.t") - F.col("_t")) <= tolerance_ms
    out = d.select(
        "_l.*",
        F.when(near, F.col("_best.r")).alias(value),
        F.when(near, F.col("_best.t") - F.col("_t")).alias(f"{value}_delta_ms"),
    )
    return out.where(F.col(value).isNotNull()) if how == "inner" else out


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_ts: str = "ts_ms",
    left_seq: str = "seq",
    right_ts: str = "ts_ms",
    right_seq: str = "seq",
    value: str = "match",
    before_first: str = "null",
    block_ms: int = HOUR_MS,
) -> DataFrame:
    """Latest right row at or before each left row, however old.

    ``before_first="first"`` gives left rows that precede every right row the first right row of their key.
    """
    rtype = right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType
    ltype = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    both = left.select(
        *keys, F.col(left_ts).alias("_t"), F.lit(1).alias(_SIDE), F.col(left_seq).cast("long").alias("_s"),
        F.struct(*left.columns).alias("_l"), F.lit(None).cast(rtype).alias("_r"),
    ).unionByName(
        right.select(
            *keys, F.col(right_ts).alias("_t"), F.lit(0).alias(_SIDE), F.col(right_seq).cast("long").alias("_s"),
            F.lit(None).cast(ltype).alias("_l"), F.struct(*right.columns).alias("_r"),
        )
    )
    d = with_last_known(
        both, keys, {value: F.col("_r")}, ts="_t", seq="_s", order_extra=[_SIDE], block_ms=block_ms
    ).where(F.col(_SIDE) == 1)
    if before_first == "first":
        first = right.groupBy(*keys).agg(
            F.min_by(F.struct(*right.columns), F.struct(F.col(right_ts), F.col(right_seq))).alias("_first")
        )
        d = attach(d, first, keys, "left", by=("_t", "_s")).withColumn(value, F.coalesce(F.col(value), F.col("_first")))
    return d.select("_l.*", value)


def interval_join(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    before_ms: int,
    after_ms: int,
    *,
    anchor_ts: str = "ts_ms",
    row_ts: str = "ts_ms",
    how: str = "inner",
    row: str = "row",
    condition: Column | None = None,
) -> DataFrame:
    """All (anchor, row) pairs with row time in [anchor - before, anchor + after], ends included.

    Rows arrive as struct ``row``. ``condition`` may refer to anchor columns and to ``row.*``.
    """
    width = max(before_ms, after_ms, 1)
    lo = block_of(F.col(anchor_ts) - before_ms, width)
    hi = block_of(F.col(anchor_ts) + after_ms, width)
    a = anchors.withColumn("_bucket", F.explode_outer(F.sequence(lo, hi)))
    r = rows.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        block_of(row_ts, width).alias("_row_bucket"),
        F.col(row_ts).alias("_row_ts"),
        F.struct(*rows.columns).alias(row),
    )
    cond = F.col("_bucket") == F.col("_row_bucket")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & (F.col("_row_ts") >= F.col(anchor_ts) - before_ms) & (F.col("_row_ts") <= F.col(anchor_ts) + after_ms)
    if condition is not None:
        cond = cond & condition
    return a.join(r, cond, how).drop("_bucket", "_row_bucket", "_row_ts", *[f"_k_{k}" for k in keys])


def window_pairs(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    before_ms: int,
    after_ms: int,
    *,
    anchor_ts: str = "ts_ms",
    row_ts: str = "ts_ms",
    row: str = "row",
    bucket: str = "_bucket",
) -> DataFrame:
    """The pairs of ``interval_join``, all pairs of an anchor in one task, so what follows per anchor needs no further shuffle.

    An anchor lies in one bucket as long as the window; a row is copied to the buckets whose anchors can ask for it, two
    at most. Group or window the result by ``[*keys, bucket, ...]``. Both sides are dealt over the configured number of
    partitions: their bytes say little about the number of pairs, so they aren't merged into fewer tasks. Rows without
    time, and anchors without time or rows, give no pair.
    """
    width = before_ms + after_ms + 1
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = anchors.withColumn(bucket, block_of(anchor_ts, width)).repartition(parts, *keys, bucket)
    r = rows.where(F.col(row_ts).isNotNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.explode(F.sequence(block_of(F.col(row_ts) - after_ms, width), block_of(F.col(row_ts) + before_ms, width))).alias("_row_bucket"),
        F.col(row_ts).alias("_row_ts"),
        F.struct(*rows.columns).alias(row),
    ).repartition(parts, *[f"_k_{k}" for k in keys], "_row_bucket")
    cond = F.col(bucket) == F.col("_row_bucket")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & F.col("_row_ts").between(F.col(anchor_ts) - before_ms, F.col(anchor_ts) + after_ms)
    return a.join(r.hint("merge"), cond).drop("_row_bucket", "_row_ts", *[f"_k_{k}" for k in keys])


def reduce_window(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    before_ms: int,
    after_ms: int,
    anchor_id: Sequence[str],
    aggs: Mapping[str, Column],
    *,
    anchor_ts: str = "ts_ms",
    row_ts: str = "ts_ms",
    row: str = "row",
    condition: Column | None = None,
) -> DataFrame:
    """Interval join reduced straight back to one row per anchor; anchors without rows are kept.

    ``aggs`` are aggregates over anchor columns and ``row.*``; the pairs are combined map-side before the shuffle. All pairs are
    formed: where only nearest rows are asked, ``reduce_nearest`` does without them.
    """
    pairs = interval_join(
        anchors, rows, keys, before_ms, after_ms, anchor_ts=anchor_ts, row_ts=row_ts, how="left", row=row,
        condition=condition,
    )
    return _per_anchor(pairs, anchors.columns, anchor_id, aggs)


def _per_anchor(pairs: DataFrame, columns: Sequence[str], anchor_id: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """One row per anchor, its own columns kept."""
    keep = [c for c in columns if c not in anchor_id]
    return pairs.groupBy(*anchor_id).agg(
        *([F.first(F.struct(*keep)).alias("_anchor")] if keep else []), *[c.alias(n) for n, c in aggs.items()]
    ).select(*anchor_id, *[F.col(f"_anchor.{c}").alias(c) for c in keep], *aggs)


def nearest_pairs(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    before_ms: int,
    after_ms: int,
    classes: Sequence[Column | None] = (None,),
    *,
    anchor_ts: str = "ts_ms",
    row_ts: str = "ts_ms",
    row: str = "row",
    ties: Sequence[str] = ("seq",),
    match: tuple[str, str] | None = None,
    unknown_matches: bool = False,
) -> DataFrame:
    """Those pairs of ``interval_join`` that can be the nearest: of each class the last row up to the anchor and the first from it on.

    A class is a condition on the columns of ``rows`` (None: all of them); of rows of one time the first by ``ties`` is taken.
    An anchor has two pairs a class at most however many rows its window holds, and one without row if it holds none. Both
    sides share a timeline per (key, bucket); as in ``window_pairs``, rows are copied to two buckets at most.

    ``match`` names a whole number of each side: a row counts if its value is null or the anchor's. An anchor without value
    matches rows without value only, or every row with ``unknown_matches``. Anchors stand once for either kind of row then,
    so reduce the result by anchor.
    """
    width = before_ms + after_ms + 1
    part = [f"_k{i}" for i in range(len(keys))]
    rtype = rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType
    atype = anchors.select(F.struct(*anchors.columns).alias("a")).schema["a"].dataType
    none = lambda t: F.lit(None).cast(t)
    tie, is_in = [f"_tie{i}" for i in range(len(ties))], [f"_is{i}" for i in range(len(classes))]
    a = anchors.select(
        *[F.col(k).alias(n) for k, n in zip(keys, part, strict=True)], block_of(anchor_ts, width).alias("_b"), F.col(anchor_ts).alias("_t"), F.lit(1).alias(_SIDE),
        *[none(rows.schema[c].dataType).alias(n) for c, n in zip(ties, tie, strict=True)], *[F.lit(False).alias(n) for n in is_in],
        F.struct(*anchors.columns).alias("_a"), none(rtype).alias("_r"))
    reach = F.sequence(block_of(F.col(row_ts) - after_ms, width), block_of(F.col(row_ts) + before_ms, width))
    r = rows.where(F.col(row_ts).isNotNull()).dropna(subset=list(keys)).select(
        *[F.col(k).alias(n) for k, n in zip(keys, part, strict=True)], F.explode(reach).alias("_b"), F.col(row_ts).alias("_t"), F.lit(0).alias(_SIDE),
        *[F.col(c).alias(n) for c, n in zip(ties, tie, strict=True)],
        *[(F.lit(True) if c is None else F.coalesce(c, F.lit(False))).alias(n) for c, n in zip(classes, is_in, strict=True)],
        none(atype).alias("_a"), F.struct(*rows.columns).alias("_r"))
    if match is not None:
        lane = lambda kind, value=F.lit(None): F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
        own, given = F.col(f"_a.{match[0]}"), F.col(f"_r.{match[1]}")
        a = a.withColumn("_lane", F.explode(F.when(own.isNull(), F.array(lane(2 if unknown_matches else 0))).otherwise(F.array(lane(0), lane(1, own)))))
        held = F.when(given.isNull(), lane(0)).otherwise(lane(1, given))
        r = r.withColumn("_lane", F.explode(F.array(held, lane(2))) if unknown_matches else held)
    part += ["_b"] if match is None else ["_b", "_lane"]
    # rows before the anchor of their time either way, the first of a time last
    late = [F.desc(n) for n in tie]
    back = Window.partitionBy(*part).orderBy("_t", _SIDE, *late).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy(F.desc("_t"), _SIDE, *late).rowsBetween(Window.unboundedPreceding, 0)
    held = [F.when(F.col(n), F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))) for n in is_in]
    found = {f"_{side}{i}": F.last(c, ignorenulls=True).over(w) for side, w in (("back", back), ("ahead", ahead)) for i, c in enumerate(held)}
    d = a.unionByName(r).withColumns(found).where(F.col(_SIDE) == 1)
    near = lambda x: x.isNotNull() & x["t"].between(F.col("_t") - before_ms, F.col("_t") + after_ms)
    return d.select("_a", F.explode_outer(F.filter(F.array(*found), near)).alias("_x")).select("_a.*", F.col("_x.r").alias(row))


def reduce_nearest(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    before_ms: int,
    after_ms: int,
    anchor_id: Sequence[str],
    aggs: Mapping[str, Column],
    classes: Sequence[Column | None] = (None,),
    *,
    row: str = "row",
    **how,
) -> DataFrame:
    """``reduce_window`` over the pairs of ``nearest_pairs``: the same result for aggregates that take, of each class, a nearest
    row up to the anchor or from it on."""
    pairs = nearest_pairs(anchors, rows, keys, before_ms, after_ms, classes, row=row, **how)
    return _per_anchor(pairs, anchors.columns, anchor_id, aggs)


def nearest_event(anchor_ts: Column, row: str = "row", ts: str = "ts_ms", seq: str = "seq", where: Column | None = None) -> Column:
    """Aggregate: the row closest to the anchor, the earlier one on a tie."""
    t = F.col(f"{row}.{ts}")
    order = F.struct(F.abs(t - anchor_ts), t, F.col(f"{row}.{seq}"))
    valid = t.isNotNull() if where is None else t.isNotNull() & where
    return F.min_by(F.col(row), F.when(valid, order))


def first_event_after(anchor_ts: Column, max_delta: int, row: str = "row", ts: str = "ts_ms", seq: str = "seq", where: Column | None = None) -> Column:
    """Aggregate: the earliest row with 0 <= distance <= max_delta."""
    t = F.col(f"{row}.{ts}")
    valid = (t >= anchor_ts) & (t - anchor_ts <= max_delta)
    valid = valid if where is None else valid & where
    return F.min_by(F.col(row), F.when(valid, F.struct(t, F.col(f"{row}.{seq}"))))


def preferred_report(anchor_ts: Column, exact: Column, row: str = "row", ts: str = "ts_ms", seq: str = "seq", where: Column | None = None) -> Column:
    """Aggregate: the report with an exact evaluation first, then one at or before the anchor, then the nearest."""
    t = F.col(f"{row}.{ts}")
    order = F.struct(
        F.when(exact, 0).otherwise(1), F.when(t <= anchor_ts, 0).otherwise(1), F.abs(t - anchor_ts), t,
        F.col(f"{row}.{seq}"),
    )
    valid = t.isNotNull() if where is None else t.isNotNull() & where
    return F.min_by(F.col(row), F.when(valid, order))


def exact_second_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], *, ts: str = "ts_ms", seq: str = "seq", value: str = "value_num"
) -> DataFrame:
    """Each row of ``a`` with the last value ``b`` has in the same second."""
    sec = F.floor(F.col(ts) / 1000)
    last = (
        b.where(F.col(value).isNotNull())
        .groupBy(*keys, sec.alias("sec"))
        .agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(seq))).alias("b"))
    )
    return (
        a.where(F.col(value).isNotNull())
        .select(*keys, ts, seq, F.col(value).alias("a"), sec.alias("sec"))
        .join(last, [*keys, "sec"])
        .drop("sec")
    )


def span_join(
    anchors: DataFrame, rows: DataFrame, keys: Sequence[str], start: str, end: str, bucket_ms: int, *, row_ts: str = "ts_ms",
    how: str = "inner", row: str = "row", condition: Column | None = None,
) -> DataFrame:
    """All (anchor, row) pairs with row time in the anchor's own [start, end]; anchors without both ends match nothing."""
    a = anchors.withColumn(
        "_bucket", F.explode_outer(F.when(F.col(end) >= F.col(start), F.sequence(block_of(start, bucket_ms), block_of(end, bucket_ms))))
    )
    r = rows.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], block_of(row_ts, bucket_ms).alias("_row_bucket"),
        F.col(row_ts).alias("_row_ts"), F.struct(*rows.columns).alias(row),
    )
    cond = F.col("_bucket") == F.col("_row_bucket")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & (F.col("_row_ts") >= F.col(start)) & (F.col("_row_ts") <= F.col(end))
    if condition is not None:
        cond = cond & condition
    return a.join(r, cond, how).drop("_bucket", "_row_bucket", "_row_ts", *[f"_k_{k}" for k in keys])


def with_rows_around(
    anchors: DataFrame, rows: DataFrame, keys: Sequence[str], start: str, end: str, columns: Sequence[str], anchor_id: Sequence[str], *,
    name: str = "around", row_ts: str = "ts_ms", widths: Sequence[int] | None = None, size: int | None = None, at_once: int = 1 << 18,
) -> DataFrame:
    """Each anchor with the array ``name``: its rows from ``start`` to ``end`` among others around them, as structs of time ``t`` and ``r``.

    Entries are sorted by time, then by ``columns``; ``cut`` takes a span. No pair is formed or shuffled: a bucket's rows become one
    array, which every anchor of the bucket reads in place, so join and reduce anything else before. Buckets are as wide as the
    longest span, or an eighth of that for shorter ones and so on down to an hour; a row is copied to two buckets of each width.
    ``widths`` gives them (``ordered.span_widths``); without, all that ``anchors`` come from runs once more to find them. Anchors
    with an unknown key or id, or without a span, get null. Both sides are dealt over the configured number of partitions, or over
    more, so that a task forms arrays of about ``at_once`` entries; ``size`` is the number of rows, or more, and counted if not given.
    """
    widths = span_widths(anchors, start, end) if widths is None else widths
    known = " and ".join(f"`{c}` is not null" for c in dict.fromkeys([*keys, *anchor_id]))
    width = F.coalesce(*[F.when(F.col(end) - F.col(start) < w, F.lit(w)) for w in reversed(widths)])
    width = F.when(F.expr(known) & (F.col(start) <= F.col(end)), width).otherwise(F.lit(0)).cast("long")
    a = anchors.withColumn("_width", width)
    # anchors without rows are spread by their ids
    a = a.withColumn("_bucket", F.when(F.col("_width") > 0, F.floor(F.col(end) / F.col("_width"))).otherwise(F.xxhash64(*anchor_id)).cast("long"))
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-2 * len(widths) * (rows.count() if size is None else size) // at_once))
    held = [f"_k{i}" for i in range(len(keys))]
    bucket = lambda w, i: F.struct(F.lit(w).cast("long").alias("width"), (block_of(row_ts, w) + i).cast("long").alias("bucket"))
    r = rows.where(F.col(row_ts).isNotNull()).dropna(subset=list(keys)).select(
        *[F.col(k).alias(n) for k, n in zip(keys, held, strict=True)], F.struct(F.col(row_ts).alias("t"), F.struct(*columns).alias("r")).alias("_x"),
        F.explode(F.array(*[bucket(w, i) for w in widths for i in (0, 1)])).alias("_b"))
    r = r.select(*held, F.col("_b.width").alias("_rw"), F.col("_b.bucket").alias("_rb"), "_x").repartition(parts, *held, "_rw", "_rb")
    arrays = r.groupBy(*held, "_rw", "_rb").agg(F.sort_array(F.collect_list("_x")).alias(name))
    same = [F.col(k) == F.col(n) for k, n in zip(keys, held, strict=True)]
    d = a.repartition(parts, *keys, "_width", "_bucket").join(arrays.hint("merge"), [*same, F.col("_width") == F.col("_rw"), F.col("_bucket") == F.col("_rb")], "left")
    return d.drop(*held, "_width", "_bucket", "_rw", "_rb")


def place_of(array: str, ts: Column) -> Column:
    """Number of entries of a ``with_rows_around`` array before a time, by halving."""
    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        late = F.get(array, mid)["t"] >= ts
        return F.struct(F.when((acc["lo"] < acc["hi"]) & ~late, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & late, mid).otherwise(acc["hi"]).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.size(array).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), whole, halve)["lo"]


def cut(array: str, first: Column, last: Column) -> Column:
    """The ``r`` of the entries [first, last) of a ``with_rows_around`` array, given by place."""
    return F.slice(array, first + 1, F.greatest(last - first, F.lit(0)))["r"]
