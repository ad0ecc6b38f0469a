"""Exact top-k inner products over a bit-sliced index.

Components become integers ``floor(scale * x)``. A block of up to ``BLOCK_ROWS`` rows keeps, for each dimension and bit, a
bitmap over its rows: the index. A query adds the bitmaps of its weights' bits, level by level with carry-save adders, which
gives the scores' own slices for all rows of the block at once; negative weights take the complement bitmaps and a constant.
The top rows are then picked from the most significant slice downward with two bitmaps, the rows that are in and those still
undecided; what is undecided after the last slice has equal scores and is resolved by id. Blocks of queries meet blocks of
the index by an equi-join on the numbers of both blocks; the best of each block are merged for a query.

Defined results: vectors that are null or empty or hold a null or non-finite component take no part; vectors of different
length are not compared; rows with the query's id are its own and no candidates; a null id is a candidate, last of equals,
and no query; a query with fewer candidates than k gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.operators.staging import materialize

BLOCK_ROWS, BLOCK_QUERIES = 16384, 128
U64 = np.uint64
_NO_ID = np.iinfo(np.int64).max


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, dims)


def slices_of(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Bitmaps (2 x dimensions x bits x words) of the components less their least one, then of the complements; least, bits."""
    least = int(x.min())
    shifted = (x - least).astype(U64)
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-len(x) // 64)
    planes = (shifted.T[:, None, :] >> np.arange(bits, dtype=U64)[None, :, None]) & U64(1)
    padded = np.zeros((*planes.shape[:2], 64 * words), dtype=np.uint8)
    padded[:, :, : len(x)] = planes
    packed = np.packbits(padded, axis=2, bitorder="little").view(U64)
    return np.stack([packed, ~packed]), least, bits


def score_slices(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices, from the lowest, of the sums over dimensions of ``|weight|`` times component (complement where negative)."""
    dims, bits, words = index.shape[1:]
    flat = index.reshape(-1, words)
    size, side = np.abs(weights), (weights < 0).astype(np.int64)
    levels: list[list[np.ndarray]] = [[] for _ in range(bits + max(1, int(size.max()).bit_length()) + dims.bit_length() + 1)]
    for a in range(int(size.max()).bit_length()):
        on = np.flatnonzero((size >> a) & 1)
        base = (side[on] * dims + on) * bits
        for b in range(bits):
            levels[a + b].append(flat[base + b])
    out = np.zeros((len(levels), words), dtype=U64)
    for level, parts in enumerate(levels):
        if not parts:
            continue
        rows = np.concatenate(parts)
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                half = a ^ b
                levels[level + 1].append((a & b) | (half & c))
                half ^= c
                rows = np.concatenate([half, rows[3 * third :]])
            else:
                levels[level + 1].append((rows[:1] & rows[1:2]))
                rows = rows[:1] ^ rows[1:2]
        out[level] = rows[0] if len(rows) else 0
    return out


def _members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` highest rows of the bitmap ``rows``; of equal ones those that come first."""
    sure, open_rows, need = np.zeros_like(rows), rows.copy(), k
    for s in slices[::-1]:
        high = open_rows & s
        n = int(np.bitwise_count(high).sum())
        if n > need:
            open_rows = high
        else:
            sure |= high
            need -= n
            open_rows &= ~s
            if not need:
                break
    return np.r_[_members(sure), _members(open_rows)[:need]]


def _values(slices: np.ndarray, at: np.ndarray) -> list[int]:
    bits = (slices[:, at >> 6] >> (at & 63).astype(U64)) & U64(1)
    return [sum(int(b) << i for i, b in enumerate(column)) for column in bits.T.tolist()]


def _index_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a block, ordered by id; a partition may hold several blocks, one after the other."""
    held: list[pa.RecordBatch] = []
    key = None

    def finish() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        dims = key[0]
        x = _matrix(t["q"].combine_chunks(), dims)
        ids = t["id"].fill_null(_NO_ID).to_numpy()
        index, least, bits = slices_of(x)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], type=pa.int32()), pa.array([key[1]], type=pa.int64()), pa.array([least], type=pa.int64()), pa.array([bits], type=pa.int32()),
                                           pa.array([ids.astype("<i8").tobytes()]), pa.array([index[0].astype("<u8").tobytes()])], ["dims", "block", "least", "bits", "ids", "slices"])

    for batch in batches:
        dims, block = (batch.column(c).to_numpy() for c in ("dims", "block"))
        cuts = np.r_[0, np.flatnonzero((dims[1:] != dims[:-1]) | (block[1:] != block[:-1])) + 1, len(dims)] if len(dims) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = (int(dims[a]), int(block[a]))
            if held and now != key:
                yield finish()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield finish()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                dims, bits, least = (one[n].as_py() for n in ("dims", "bits", "least"))
                ids = np.frombuffer(one["ids"].as_py(), dtype="<i8")
                packed = np.frombuffer(one["slices"].as_py(), dtype="<u8").reshape(dims, bits, -1)
                index = np.stack([packed, ~packed])
                valid = np.packbits(np.arange(64 * packed.shape[2]) < len(ids), bitorder="little").view(U64)
                out: list[tuple[int, int | None, int]] = []
                asked = np.frombuffer(one["asked"].as_py(), dtype="<i8").reshape(-1, dims + 1)
                for query, weights in zip(asked[:, 0].tolist(), asked[:, 1:], strict=True):
                    rows = valid
                    own = np.arange(*np.searchsorted(ids, [query, query + 1]))
                    if len(own):
                        rows = valid.copy()
                        np.bitwise_and.at(rows, own >> 6, ~(U64(1) << (own & 63).astype(U64)))
                    slices = score_slices(index, weights)
                    best = top_rows(slices, rows, k)
                    base = least * int(weights.sum()) - (2**bits - 1) * int(-weights[weights < 0].sum())
                    out += [(query, None if ids[r] == _NO_ID else int(ids[r]), v + base) for r, v in zip(best.tolist(), _values(slices, best), strict=True)]
                columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["query_id", "id", "score"])

    return run


def _ask_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of a partition packed into rows of up to ``BLOCK_QUERIES``, an id and its weights each."""
    for batch in batches:
        dims, block = (batch.column(c).to_numpy() for c in ("dims", "asked_block"))
        cuts = np.r_[0, np.flatnonzero((dims[1:] != dims[:-1]) | (block[1:] != block[:-1])) + 1, len(dims)] if len(dims) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            rows = np.concatenate([part.column("id").to_numpy()[:, None], _matrix(part.column("q"), int(dims[a]))], axis=1)
            for i in range(0, len(rows), BLOCK_QUERIES):
                yield pa.RecordBatch.from_arrays([pa.array([dims[a]], type=pa.int32()), pa.array([block[a]], type=pa.int64()), pa.array([rows[i : i + BLOCK_QUERIES].astype("<i8").tobytes()])], ["dims", "asked_block", "asked"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` highest integer inner products of each query row, ties to smaller ids."""
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), q.alias("q"), F.size(x).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows, "quantised")
    # A row for each length of vectors: numbers of blocks.
    sizes = rows.groupBy("dims").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"), F.ceil(F.count_if("asks") / BLOCK_QUERIES).alias("asked_blocks"))
    sizes = F.broadcast(materialize(sizes.where("asked_blocks > 0"), "sizes"))
    spread = F.xxhash64("id", "q")
    placed = rows.join(sizes, "dims")
    index = (placed.withColumn("block", F.pmod(spread, F.col("blocks"))).repartition("dims", "block")
             .sortWithinPartitions("dims", "block", F.col("id").asc_nulls_last()).select("dims", "block", "id", "q")
             .mapInArrow(_index_block, "dims int, block long, least long, bits int, ids binary, slices binary"))
    asked = (placed.where("asks").withColumn("asked_block", F.pmod(spread, F.col("asked_blocks"))).repartition("dims", "asked_block")
             .sortWithinPartitions("dims", "asked_block").select("dims", "asked_block", "id", "q").mapInArrow(_ask_block, "dims int, asked_block long, asked binary"))
    # The index stays one row a block; packed queries go to every block of their length.
    asked = asked.join(sizes, "dims").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "asked_blocks")
    best = index.join(asked.drop("asked_block"), ["dims", "block"]).select("dims", "bits", "least", "ids", "slices", "asked").mapInArrow(_search(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
