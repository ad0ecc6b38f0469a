"""Documents in the order of their ids, dealt into blocks of ids: for operators that need each document's neighbour.

The borders are quantiles of the ids. A block's edge row is copied to the block that needs it, so texts are shuffled once and
each task walks its sorted block with one row in hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescope.llm.frames import partitions


def id_blocks(d: DataFrame, blocks: int | None = None) -> tuple[DataFrame, int]:
    """Adds ``block`` (0 to n - 1, rising with ``id``; null ids first) and gives n. One number a block comes to the driver."""
    n = blocks or partitions(d.sparkSession)
    found = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()[0] if n > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return d.withColumn("block", F.lit(0)), 1
    borders = F.array(*[F.lit(c) for c in cuts])
    return d.withColumn("block", F.coalesce(F.size(F.filter(borders, lambda c: F.col("id") > c)), F.lit(0))), len(cuts) + 1


def in_blocks(d: DataFrame, *order, blocks: int | None = None) -> DataFrame:
    """Rows of one block in one partition, sorted by ``block`` and ``order``."""
    dealt, n = id_blocks(d, blocks)
    return dealt.repartitionById(n, F.col("block")).sortWithinPartitions("block", *order)


def descending_with_guests(d: DataFrame, blocks: int | None = None) -> DataFrame:
    """``id, text, guest`` by ``block``, descending id; after a block's own rows (``guest`` false) comes the next lower block's first row.

    After the lowest block comes the highest id again. Rows of one id are ordered by the text's checksum.
    """
    dealt, n = id_blocks(d.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))), blocks)
    tops = [tuple(r) for r in dealt.groupBy("block").agg(F.max("id").alias("top")).orderBy("block").collect()]  # a row for each block
    guests = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    if not guests:
        return dealt.withColumn("guest", F.lit(False))
    to = F.broadcast(d.sparkSession.createDataFrame(guests, f"top {d.schema['id'].dataType.simpleString()}, lends int"))
    both = dealt.join(to, F.col("id").eqNullSafe(F.col("top")), "left")
    places = F.when(F.col("lends").isNull(), F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")), F.struct(F.col("lends").alias("block"), F.lit(True).alias("guest"))))
    spread = both.select("id", "text", "crc", F.inline(places))
    return spread.repartitionById(n, F.col("block")).sortWithinPartitions("block", "guest", F.col("id").desc_nulls_last(), "crc")
