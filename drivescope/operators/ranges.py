"""Windows that overlap: each is a range of positions in samples sorted once.

Windows of neighbouring anchors share nearly all their samples, so their pairs grow with the square of the samples of a time
span. Here Spark deals anchors and samples by (key, stretch of time); a task holds the samples of one stretch and the windows
that reach out of it, and numpy answers all ranges at once, in the number of samples and anchors times its logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescope.operators.ordered import HOUR_MS, block_of

Answer = Callable[[pa.Table, pa.Table], pa.Table]


def per_stretch(
    anchors: DataFrame, rows: DataFrame, keys: Sequence[str], before_ms: int, after_ms: int, answer: Answer, schema: str, *, anchor_ts: str = "ts_ms",
    row_ts: str = "ts_ms", order: Sequence[str] = ("ts_ms", "seq"),
) -> DataFrame:
    """``answer(anchors, rows)`` of each key and stretch of time, rows sorted by ``order`` (nulls first).

    An anchor lies in one stretch, an hour or the window long, whichever is more; a row is copied to the stretches whose anchors
    can ask for it, two at most. Anchors and rows without time or key take no part. Both sides are dealt over the configured
    number of partitions: small stretches take longer than their bytes say.
    """
    width = max(before_ms + after_ms + 1, HOUR_MS)
    by = [*keys, "_stretch"]
    there = lambda d, ts: d.where(" and ".join(f"`{c}` is not null" for c in dict.fromkeys([*keys, ts])))
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = there(anchors, anchor_ts).withColumn("_stretch", block_of(anchor_ts, width)).repartition(parts, *by)
    reach = F.sequence(block_of(F.col(row_ts) - after_ms, width), block_of(F.col(row_ts) + before_ms, width))
    r = there(rows, row_ts).withColumn("_stretch", F.explode(reach)).repartition(parts, *by)
    ordering = [(c, "ascending") for c in order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return answer(left, right.take(pc.sort_indices(right, sort_keys=ordering, null_placement="at_start")))

    return a.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(run, schema)


def per_span(
    anchors: DataFrame, rows: DataFrame, keys: Sequence[str], start: str, end: str, widths: Sequence[int], answer: Answer, schema: str, *, row_ts: str = "ts_ms",
    order: Sequence[str] = ("ts_ms", "seq"),
) -> DataFrame:
    """``per_stretch`` for anchors with a span of their own: ``answer`` gets all rows from ``start`` to ``end`` of its anchors, among others.

    Stretches are as long as the ``widths`` (``ordered.span_widths``), an anchor lies in one of the shortest that its span fits in; a
    row is copied to two of each length. Anchors without key or span and rows without time or key take no part.
    """
    length = F.col(end) - F.col(start)
    width = F.coalesce(*[F.when(length < w, F.lit(w)) for w in sorted(widths)]).cast("long")
    there = lambda d, *names: d.where(" and ".join(f"`{c}` is not null" for c in dict.fromkeys([*keys, *names])))
    by = [*keys, "_width", "_stretch"]
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = there(anchors, start, end).where(length >= 0).withColumn("_width", width).withColumn("_stretch", F.floor(F.col(end) / F.col("_width")).cast("long")).repartition(parts, *by)
    copies = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), (block_of(row_ts, w) + i).cast("long").alias("s")) for w in widths for i in (0, 1)])
    r = there(rows, row_ts).withColumn("_at", F.explode(copies)).select(*rows.columns, F.col("_at.w").alias("_width"), F.col("_at.s").alias("_stretch")).repartition(parts, *by)
    ordering = [(c, "ascending") for c in order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=ordering, null_placement="at_start")) if left.num_rows else right.slice(0, 0)
        return answer(left, right)

    return a.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(run, schema)


def longs(column: pa.ChunkedArray) -> np.ndarray:
    """Values as longs, 0 for null."""
    return column.cast(pa.int64()).fill_null(0).to_numpy()


def counted(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many flags each range [lo, hi) holds."""
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[hi] - upto[lo]


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Values as doubles, NaN for null; times and ids below 2^53 stay exact."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


def whole(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Whole numbers as longs, null where unknown."""
    known = ~np.isnan(values) if known is None else known
    return pa.array(np.where(known, values, 0).astype(np.int64), mask=~known)


def real(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    known = ~np.isnan(values) if known is None else known
    return pa.array(values, mask=~known)


def at(values: np.ndarray, places: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Values at places, NaN where not known."""
    out = np.full(len(places), np.nan)
    out[known] = values[places[known]]
    return out


def first_from(condition: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The first place from ``lo`` on where the condition holds; the length where none does."""
    places = np.append(np.flatnonzero(condition), len(condition))
    return places[np.searchsorted(places[:-1], lo)]


def best_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the first maximum in [lo, hi), -1 where that is empty; NaN counts as the largest."""
    out = np.full(len(lo), -1)
    span = np.maximum(hi - lo, 0)
    level = np.frexp(span.astype(np.float64))[1] - 1
    if np.isnan(values).any():
        values = np.unique(values, return_inverse=True)[1]
    best, step = np.arange(len(values)), 1
    pick = lambda x, y: np.where(values[y] > values[x], y, x)
    for j in range(int(level.max(initial=-1)) + 1):
        if j:
            best, step = pick(best[:-step], best[step:]), 2 * step
        asked = np.flatnonzero((level == j) & (span > 0))
        out[asked] = pick(best[lo[asked]], best[hi[asked] - (1 << j)])
    return out


def kth_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest value, from 0, of each range [lo, hi), NaN last; ``k`` lies inside. Values are split by one bit of their rank a step."""
    if not len(lo):
        return np.empty(0)
    sorted_values, codes = np.unique(values, return_inverse=True)
    lo, hi, k, found = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
    for bit in reversed(range(int(len(sorted_values) - 1).bit_length())):
        low = (codes >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(low)])
        from_low, to_low = before[lo], before[hi]
        stays = k < to_low - from_low
        found |= np.where(stays, 0, 1 << bit)
        k = np.where(stays, k, k - (to_low - from_low))
        lo, hi = np.where(stays, from_low, before[-1] + lo - from_low), np.where(stays, to_low, before[-1] + hi - to_low)
        codes = np.concatenate([codes[low], codes[~low]])
    return sorted_values[found]


def sum_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of each range, in extended precision; not finite where a value of the range isn't."""
    finite = np.isfinite(values)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    total = upto(np.where(finite, values, 0).astype(np.longdouble))
    out = (total[hi] - total[lo]).astype(np.float64)
    if not finite.all():
        some = lambda x: np.diff([upto(x)[lo], upto(x)[hi]], axis=0)[0] > 0
        up, down = some(values == np.inf), some(values == -np.inf)
        out = np.where(up, np.inf, np.where(down, -np.inf, out))
        out = np.where(some(np.isnan(values)) | (up & down), np.nan, out)
    return out


def of_one_kind(*columns: np.ndarray) -> list[np.ndarray]:
    """Places with equal values in all columns (NaN equals NaN), one array for each kind."""
    if not len(columns[0]):
        return []
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = np.unique(c, return_inverse=True)[1]
        codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)


def anchored(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the ranges [lo, hi) of sorted times, the first of every range, then the second and so on: (range, start, end).

    A bucket reaches from its anchor, the first time that no bucket holds yet, to the last one ``span`` behind it at most.
    """
    asked = np.flatnonzero(lo < hi)
    start = lo[asked]
    while len(asked):
        end = np.minimum(np.searchsorted(t, t[start] + span, "right"), hi[asked])
        yield asked, start, end
        more = end < hi[asked]
        asked, start = asked[more], end[more]


def centers(t: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Means of the ranges of times, every time counted ``times`` times, halves to even. Sums of milliseconds need all bits of a long."""
    first = t[0] if len(t) else 0
    upto = np.concatenate([[0], np.cumsum(t - first)])
    n = (end - start) * times
    total = (upto[end] - upto[start]).astype(np.longdouble) * times + n.astype(np.longdouble) * first
    return np.rint(total.astype(np.float64) / n).astype(np.int64)
