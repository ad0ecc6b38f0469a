"""Ordered operations over long timelines.

A log, device or run may hold a large share of all rows, so no window here is partitioned by the key alone.
Rows are windowed per (key, time block); what one block must know of its neighbours (first row, last row, running
total) is first reduced to one row per block, windowed over those few rows, and joined back on (key, block). The
result equals the plain ``partitionBy(key).orderBy(ts, seq)`` window for any block length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
BLOCK = "_block"


def block_of(ts: Column | str, block_ms: int) -> Column:
    """Number of the time block a timestamp (epoch ms) falls into."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(block_ms)).cast("long")


def span_widths(anchors: DataFrame, start: str, end: str) -> list[int]:
    """Lengths of time buckets for the spans from ``start`` to ``end``: the longest, an eighth of it and so on down to an hour, without those too short for any span."""
    length = F.col(end) - F.col(start)
    shortest, longest = anchors.where(length >= 0).agg(F.min(length), F.max(length)).first()
    widths = [(longest or 0) + 1]
    while widths[-1] // 8 >= HOUR_MS and widths[-1] // 8 > shortest:
        widths.append(widths[-1] // 8)
    return widths


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _blocked(df: DataFrame, keys: Sequence[str], ts: str, block_ms: int) -> DataFrame:
    """Adds the key and time block as one value, never null itself, whose parts may be.

    Windows and joins use it alone: nulls match nulls in it under plain equality, and rows are dealt once for both.
    """
    return df.withColumn(BLOCK, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], block_of(ts, block_ms).alias("block")))


def _over_blocks(keys: Sequence[str]) -> WindowSpec:
    """A key's blocks in time order."""
    return Window.partitionBy(*[F.col(BLOCK)[f"k{i}"] for i in range(len(keys))]).orderBy(F.col(BLOCK)["block"])


def _join_block(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Left join per-block values back."""
    right = edges.withColumnRenamed(BLOCK, "_e_block")
    return df.join(right, F.col(BLOCK) == F.col("_e_block"), "left").drop("_e_block")


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", by: Sequence[str] = ("ts_ms", "seq"), spread: int = 32) -> DataFrame:
    """Joins one row a key to many: the rows of a key are dealt over ``spread`` tasks by a hash of ``by``, its value to each of them."""
    part = F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int")
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return df.withColumn("_part", part).join(copies, [*keys, "_part"], how).drop("_part")


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    *,
    previous: Mapping[str, Column | str] | None = None,
    following: Mapping[str, Column | str] | None = None,
    ts: str = "ts_ms",
    seq: str = "seq",
    block_ms: int = HOUR_MS,
) -> DataFrame:
    """Add values of the row before (``previous``) and after (``following``) within each key, by (ts, seq)."""
    previous, following = dict(previous or {}), dict(following or {})
    order = F.struct(F.col(ts), F.col(seq))
    d = _blocked(df, keys, ts, block_ms)
    w = Window.partitionBy(BLOCK).orderBy(ts, seq)
    wk = _over_blocks(keys)
    aggs, shifted = [], []
    if previous:
        prev_struct = F.struct(*[_as_col(c).alias(n) for n, c in previous.items()])
        aggs.append(F.max_by(prev_struct, order).alias("_last"))
        shifted.append(F.lag("_last").over(wk).alias("_prev_edge"))
    if following:
        next_struct = F.struct(*[_as_col(c).alias(n) for n, c in following.items()])
        aggs.append(F.min_by(next_struct, order).alias("_first"))
        shifted.append(F.lead("_first").over(wk).alias("_next_edge"))
    edges = d.groupBy(BLOCK).agg(*aggs).select(BLOCK, *shifted)
    out = d
    if previous:
        out = out.withColumn("_prev", F.lag(prev_struct).over(w))
    if following:
        out = out.withColumn("_next", F.lead(next_struct).over(w))
    out = _join_block(out, edges)
    picked = [F.coalesce(F.col("_prev"), F.col("_prev_edge")).getField(n).alias(n) for n in previous]
    picked += [F.coalesce(F.col("_next"), F.col("_next_edge")).getField(n).alias(n) for n in following]
    replaced = {*previous, *following}
    return out.select(*[c for c in df.columns if c not in replaced], *picked)


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column | str],
    *,
    ts: str = "ts_ms",
    seq: str = "seq",
    block_ms: int = HOUR_MS,
    order_extra: Sequence[str] = (),
    include_current: bool = True,
) -> DataFrame:
    """Carry the latest non-null value forward (the row itself included unless told otherwise)."""
    ordering = [ts, *order_extra, seq]
    order = F.struct(*[F.col(c) for c in ordering])
    d = _blocked(df, keys, ts, block_ms)
    for n, c in values.items():
        d = d.withColumn(f"_src_{n}", _as_col(c))
    w = (
        Window.partitionBy(BLOCK)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    wk = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        d.groupBy(BLOCK)
        .agg(*[
            F.max_by(F.col(f"_src_{n}"), F.when(F.col(f"_src_{n}").isNotNull(), order)).alias(f"_last_{n}")
            for n in values
        ])
        .select(BLOCK, *[F.last(f"_last_{n}", ignorenulls=True).over(wk).alias(f"_edge_{n}") for n in values])
    )
    out = d.select("*", *[F.last(f"_src_{n}", ignorenulls=True).over(w).alias(f"_cur_{n}") for n in values])
    out = _join_block(out, edges)
    return out.select(
        *[c for c in df.columns if c not in values],
        *[F.coalesce(F.col(f"_cur_{n}"), F.col(f"_edge_{n}")).alias(n) for n in values],
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column | str],
    *,
    ts: str = "ts_ms",
    seq: str = "seq",
    block_ms: int = HOUR_MS,
) -> DataFrame:
    """Running totals by (ts, seq), the row itself included; nulls count as zero."""
    d = _blocked(df, keys, ts, block_ms)
    for n, c in values.items():
        d = d.withColumn(f"_src_{n}", F.coalesce(_as_col(c), F.lit(0)).cast("long"))
    w = Window.partitionBy(BLOCK).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    wk = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        d.groupBy(BLOCK)
        .agg(*[F.sum(f"_src_{n}").alias(f"_tot_{n}") for n in values])
        .select(BLOCK, *[F.sum(f"_tot_{n}").over(wk).alias(f"_edge_{n}") for n in values])
    )
    out = d.select("*", *[F.sum(f"_src_{n}").over(w).alias(f"_cur_{n}") for n in values])
    out = _join_block(out, edges)
    return out.select(
        *[c for c in df.columns if c not in values],
        *[(F.col(f"_cur_{n}") + F.coalesce(F.col(f"_edge_{n}"), F.lit(0))).alias(n) for n in values],
    )


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    name: str = "row_no",
    *,
    ts: str = "ts_ms",
    seq: str = "seq",
    block_ms: int = HOUR_MS,
) -> DataFrame:
    """1-based position by (ts, seq) within each key."""
    return with_running_sum(df, keys, {name: F.lit(1)}, ts=ts, seq=seq, block_ms=block_ms)
