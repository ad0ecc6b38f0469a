"""Sharding along a Hilbert curve: rows that are alike in several metadata dimensions share a shard.

Each dimension is cut into at most ``2**bits`` classes of about equal numbers of rows, the classes are the coordinates of a
cell, and rows are sorted by the cell's place on the Hilbert curve. Shards are runs of that order whose counts differ by one
at most, so every file covers a small box of the metadata space and its column statistics prune in all dimensions.

Defined results: a null dimension is class 0; a null text is empty; equal rows get different slots; ids may repeat or be
null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from drivescope.llm.frames import each_batch, in_global_order
from drivescope.operators.staging import materialize

U64 = np.uint64


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of cells (rows of ``coordinates``): axes to transposed index by Skilling's method, then interleaved."""
    x = [c.astype(U64) for c in coordinates.T]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = U64((1 << bit) - 1)
        for i in range(n):
            turned = (x[i] >> U64(bit)) & U64(1) == 1
            swap = np.where(turned, U64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> U64(bit)) & U64(1) == 1, U64((1 << bit) - 1), U64(0))
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << U64(1)) | (((x[i] ^ flip) >> U64(bit)) & U64(1))
    return index


def text_order(column: Column) -> Column:
    """A number that orders strings by their first seven bytes; ``with_value_rank`` orders by all of them."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(column, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")


def with_value_rank(df: DataFrame, column: str, by: list[str], name: str, spread: int = 32) -> DataFrame:
    """Adds ``name``: how many rows have a smaller value in ``column``, in the order of whole strings; null for nulls.

    Rows of a value are dealt over ``spread`` tasks by a hash of ``by``. ``df`` is read twice.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(spread)))
    parts = dealt.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value"), "_part").agg(F.count("*").alias("_count"))
    placed = in_global_order(parts, [F.col("_value"), F.col("_part")], "values", total="_count")
    ranks = placed.select("_value", F.col("_part").alias("_of"), F.min("before").over(Window.partitionBy("_value")).cast("long").alias(name))  # at most ``spread`` rows a value
    return dealt.join(ranks, (F.col(column) == F.col("_value")) & (F.col("_part") == F.col("_of")), "left").drop("_part", "_value", "_of")


def on_curve(df: DataFrame, dims: list[str], bits: int = 5, label: str = "curve") -> DataFrame:
    """Adds ``curve``, the place of each row's cell. ``dims`` name number columns of a narrow table.

    The class borders are quantiles over all rows: at most ``len(dims) * (2**bits - 1)`` numbers come to the driver.
    """
    levels = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(d, levels, 2000).alias(f"c{i}") for i, d in enumerate(dims)]).first()
    borders = [np.unique(np.array(c or [], dtype=np.float64)) for c in found]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [np.nan_to_num(batch.column(d).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), nan=-np.inf) for d in dims]
        cells = np.stack([np.searchsorted(b, c, side="right") for b, c in zip(borders, columns, strict=True)], axis=1)
        return batch.append_column("curve", pa.array(hilbert_index(cells, bits).astype(np.int64)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(each_batch(place), f"{kinds}, curve long")


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = 40, bits: int = 5) -> DataFrame:
    """Adds ``curve``, ``shard`` (0 to ``shards - 1``) and ``slot`` (from 0, gapless in each shard) to a narrow table.

    Counts of two shards differ by one at most. ``ties`` order the rows of a cell; end them with an id. ``dims`` are columns of
    numbers, or of strings, which are ranked as wholes.
    """
    narrow = materialize(df, "shard-keys")
    ranked = {d: f"_rank_{i}" for i, d in enumerate(dims) if isinstance(narrow.schema[d].dataType, StringType)}
    if ranked:
        for d, name in ranked.items():
            narrow = with_value_rank(narrow, d, ties, name)
        narrow = materialize(narrow, "shard-ranks")
    curve = on_curve(narrow, [ranked.get(d, d) for d in dims], bits).drop(*ranked.values())
    placed = in_global_order(curve, [F.col("curve"), *[F.col(t) for t in ties]], "curve")
    n = max(1, narrow.count())
    shard = F.expr(f"cast((rank * {shards}) div {n} as int)")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).drop("rank")
