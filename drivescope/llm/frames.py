"""Helpers of the operators: narrow column choice, global order, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivescope.operators.staging import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """``id``, ``text`` (null: empty) and the columns asked for; all other columns, whatever their names, stay outside."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *[(docs[f"`{c}`"] if isinstance(c, str) else c).alias(k) for k, c in more.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` on every batch that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def in_global_order(df: DataFrame, keys: list[Column], label: str, total: str | None = None) -> DataFrame:
    """Adds ``rank`` (0 to n - 1 in the order of ``keys``) and, where ``total`` names a column, ``before``: its sum over all rows ahead.

    Rows are dealt by ranges of the keys and written once, so that the ranges stand still; a range's offset is the count of
    the ranges ahead, a table with one row for each range. The rows should be narrow; keys that end in an id spread hot values.
    """
    ranged = materialize(df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_range", F.spark_partition_id()), label)
    amount = F.col(total) if total else F.lit(0)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(amount).cast("long").alias("_m"))
               .select("_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(a) for c, a in (("_n", "_rows"), ("_m", "_sum"))]))
    within = Window.partitionBy("_range").orderBy(*keys)
    out = (ranged.join(F.broadcast(offsets), "_range")  # a row for each partition of the shuffle
           .withColumn("rank", F.col("_rows") + F.row_number().over(within) - 1))
    if total:
        out = out.withColumn("before", F.col("_sum") + F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_range", "_rows", "_sum")
