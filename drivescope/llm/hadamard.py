"""Centroid clustering of integer vectors with a progressive search in Walsh-Hadamard coefficients.

A vector's 64 integer components are transformed exactly (sums and differences only), once. Squared distances of coefficients
are 64 times those of the components. The coefficients are ordered from coarse to fine, by changes of sign of their pattern,
and a search adds up squared differences in growing steps. After each step the energy that is left on both sides bounds every
distance from both sides; a centroid whose least possible distance exceeds another's greatest is strictly worse and leaves.
What remains is added up over all 64, so the nearest centroid and its distance are exact, ties included.

A round is one pass over the stored coefficients: tasks send the count and the sums of each centroid's vectors, which are
added up in Spark; only the centroids themselves, as many as were asked for, pass through the driver. A lost executor costs
the tasks it held, since a round depends on the stored table and the centroids alone.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; components
beyond 2^27 in size after scaling count as 2^27, because no long could hold their distances; the first centroids are the rows
with the smallest hashes of their ids (a null id hashes like an empty one), equal hashes in the order of the vectors; equal
rows stay apart and may all become centroids; with fewer rows than centroids there are as many centroids as rows; a sum of
distances beyond a long is null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescope.llm.text import bounds
from drivescope.operators.staging import materialize

DIMS = 64
LIMIT = 1 << 27  # 64 * (2 * LIMIT)**2 fits a long
_EXACT = 1 << 20  # components up to here keep sums of squared coefficients inside a long
_CUTS = (4, 8, 16, 32, DIMS)
_SLACK = 1e-9  # far above the rounding of the bounds, so that rounding eliminates nothing


def _patterns() -> np.ndarray:
    """Places of the butterflies' results, by the number of sign changes of their patterns."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < DIMS:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


_ORDER = _patterns()


def _butterflies(x: np.ndarray) -> np.ndarray:
    half = 1
    while half < DIMS:
        pair = x.reshape(len(x), -1, 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), DIMS)
        half *= 2
    return x


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients, coarse to fine, of rows of components."""
    return _butterflies(x)[:, _ORDER]


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Components of rows of coefficients (or of sums of them)."""
    natural = np.empty_like(coefficients)
    natural[:, _ORDER] = coefficients
    return _butterflies(natural) // DIMS


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, both sides given by coefficients; ties to the smaller number."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > _EXACT * DIMS:
        x, centroids = x.astype(object), centroids.astype(object)  # integers of any size
    n, k = len(x), len(centroids)
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, dtype=x.dtype)
    left_x, left_c = ((side * side)[:, ::-1].cumsum(axis=1)[:, ::-1] for side in (x, centroids))
    low = 0
    for high in _CUTS:
        step = x[row, low:high] - centroids[number, low:high]
        total = total + (step * step).sum(axis=1)
        if high < DIMS and k > 1:
            rest_x, rest_c, sofar = left_x[row, high].astype(float), left_c[number, high].astype(float), total.astype(float)
            slack = _SLACK * (sofar + rest_x + rest_c)
            cross = 2 * np.sqrt(rest_x * rest_c)
            least, greatest = sofar + rest_x + rest_c - cross - slack, sofar + rest_x + rest_c + cross + slack
            bound = np.full(n, np.inf)
            np.minimum.at(bound, row, greatest)
            alive = least <= bound[row]
            row, number, total = row[alive], number[alive], total[alive]
        low = high
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, dtype=np.int64)
    best = np.minimum.reduceat(total, first) if n else total
    hit = np.flatnonzero(total == best[row])
    _, leading = np.unique(row[hit], return_index=True)  # candidates of a row stand in the order of their numbers
    return number[hit[leading]], (best // DIMS).astype(np.int64)


def _packed(rows: np.ndarray) -> pa.Array:
    small = np.abs(rows).max(initial=0) < 2**31
    wide = rows.astype("<i4" if small else "<i8")
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(np.arange(0, wide.nbytes + 1, DIMS * wide.itemsize, dtype=np.int32)), pa.py_buffer(wide.tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    data, offsets = bounds(column)
    sizes = np.diff(offsets)
    out = np.empty((len(sizes), DIMS), dtype=np.int64)
    for width, kind in ((4, "<i4"), (8, "<i8")):
        here = np.flatnonzero(sizes == width * DIMS)
        if len(here):
            out[here] = np.ascontiguousarray(data[offsets[here][:, None] + np.arange(width * DIMS)]).view(kind)
    return out


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("q").flatten().to_numpy().reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(transform(x))], ["id", "coefficients"])


def _sums(centroids: np.ndarray):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, sums = np.zeros(k, dtype=np.int64), [0] * k, np.zeros((k, DIMS), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("coefficients"))
            number, distance = nearest(x, centroids)
            for c in np.unique(number):
                mine = number == c
                count[c] += mine.sum()
                sums[c] += x[mine].sum(axis=0)
                inertia[c] += int(distance[mine].astype(object).sum())
        used = np.flatnonzero(count)
        # A row for each centroid and coefficient, then one with the count (place 64) and one with the distances (place 65).
        cells = [(int(c), place, value) for c in used for place, value in enumerate([*sums[c], int(count[c]), inertia[c]])]
        columns = list(zip(*cells, strict=True)) if cells else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int32()), pa.array(columns[1], type=pa.int32()), pa.array([str(v) for v in columns[2]])], ["cluster", "place", "amount"])

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_unpacked(batch.column("coefficients")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def _round(stored: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each centroid that has vectors: the sums of their 64 coefficients, their count, the sum of their distances."""
    cells = stored.select("coefficients").mapInArrow(_sums(centroids), "cluster int, place int, amount string")
    added = cells.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    out: dict[int, list[int]] = {}
    for cell in added.collect():  # 66 numbers for each centroid
        out.setdefault(cell.cluster, [0] * (DIMS + 2))[cell.place] = int(cell.amount)
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector, and the centroids' components.

    Each round assigns all vectors and moves every centroid that has some to the floor of their mean; a last pass assigns again.
    """
    x = F.col(f"`{vector_col}`")
    fine = F.when(x.isNotNull() & (F.size(x) == DIMS), F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    bounded = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v.cast("double") * scale))).cast("long"))
    rows = vectors.where(fine).select(F.col(f"`{id_col}`").alias("id"), bounded.alias("q"))
    kind = rows.schema["id"].dataType.simpleString()
    stored = materialize(rows.mapInArrow(_transformed, f"id {kind}, coefficients binary"), "coefficients")
    hashed = stored.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    first = hashed.orderBy("hash", "coefficients").limit(k).collect()
    widths = [np.frombuffer(r.coefficients, dtype="<i4" if len(r.coefficients) == 4 * DIMS else "<i8").astype(np.int64) for r in first]
    shape = f"id {kind}, cluster int, distance long"
    if not widths:
        empty = stored.mapInArrow(_labels(np.zeros((1, DIMS), dtype=np.int64)), shape)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")), np.zeros((0, DIMS), dtype=np.int64)
    centroids = inverse(np.array(widths))
    for _ in range(rounds):
        for c, sums in _round(stored, transform(centroids)).items():
            components = inverse(np.array([sums[:DIMS]], dtype=object))[0]
            centroids[c] = [int(s) // sums[DIMS] for s in components]
    final = _round(stored, transform(centroids))
    # A row for each centroid, written into the plan.
    inertia = {c: sums[DIMS + 1] for c, sums in final.items()}
    total = sum(inertia.values())
    known = F.create_map(*[F.lit(v) for c in sorted(inertia) for v in (c, str(inertia[c]))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    labels = stored.mapInArrow(_labels(transform(centroids)), shape)
    return labels.select("id", "cluster", "distance", known[F.col("cluster")].try_cast("long").alias("cluster_inertia"),
                         F.lit(str(total)).try_cast("long").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256")), centroids
