"""Table-shaped sources and the result sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from drivescope.functions import scalars as S
from drivescope.operators.staging import attach_sized, materialize
from drivescope.sources.columns import PLACES, header_places, positional_points, tabular_points
from drivescope.sources.nmf import split_csv


def read_tabular(spark: SparkSession, path: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exports saved as CSV or Parquet, as points. CSV files may differ in columns and their order: see ``read_exports``."""
    if isinstance(path, str) and path.rstrip("/").endswith(".parquet"):
        return tabular_points(spark.read.parquet(path), keep)
    return read_exports(spark, path, keep)


def file_headers(lines: DataFrame) -> DataFrame:
    """``file, header``: the first line of each file that isn't blank.

    The first pass keeps one number for each split of the scan, so it combines where the text is read; the second picks the
    lines those numbers name.
    """
    first = lines.groupBy("file", "_start").agg(F.min("_id").alias("_id"))
    first = materialize(first.groupBy("file").agg(F.min(F.struct("_start", "_id")).alias("f")).select("file", "f.*"), "first_lines")
    named = lines.join(first, ["file", "_start", "_id"], "left_semi") if first.count() > 100_000 else lines.join(F.broadcast(first), ["file", "_start", "_id"], "left_semi")
    return named.select("file", F.col("value").alias("header"))


def read_exports(spark: SparkSession, path: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """CSV exports as points, each file read by its own header, so a folder may mix exports of different columns and orders.

    The columns are resolved once for each distinct header; rows then take their fields by position. A line equal to its
    file's header is no row (exports that were appended to each other repeat it). Quoted fields may hold commas, but no line
    breaks. Blank lines and files give nothing, short rows have nulls, fields beyond the header are ignored.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.trim("value") != "")
    headers = materialize(file_headers(lines), "headers")
    resolve = F.udf(lambda names: header_places(names, keep), PLACES)
    places = headers.select("header").distinct().select("header", resolve(split_csv(F.col("header"))).alias("places"))
    d = attach_sized(lines, headers.join(places, "header"), ["file"], by=["_start", "_id"], most=10_000)
    rows = d.where(F.col("value") != F.col("header")).select(split_csv(F.col("value")).alias("parts"), "places")
    return positional_points(rows, keep)


def read_track(spark: SparkSession, path: str, row_tag: str = "trkpt", one_per_line: bool = False) -> DataFrame:
    """GPX points (``trkpt``, ``wpt`` or ``point``): time, position, altitude, speed.

    ``one_per_line`` reads files that hold one element per line and can be split between tasks.
    """
    schema = "_lat double, _lon double, time string, ele double, speed double"
    d = spark.read.format("xml").option("rowTag", row_tag).option("multiLine", not one_per_line).schema(schema).load(path)
    return d.where("_lat is not null and _lon is not null").select(
        S.parse_ts("time").alias("ts_ms"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("ele").alias("alt"), "speed")


def fingerprint(*columns: str):
    """SHA-1 over the named columns of a row, for content-addressed results."""
    return F.sha1(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))


def write_analysis(df: DataFrame, path: str, partition: Sequence[str] = ("run_id",), key_columns: Sequence[str] = ()) -> None:
    """Persist a result table by run; re-writing replaces only the runs it holds."""
    out = df.withColumn("result_key", fingerprint(*key_columns)) if key_columns else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_series(samples: DataFrame, path: str, *, run: str = "run_id", order: Sequence[str] = ("name", "ts_ms", "seq"), rows_per_file: int = 5_000_000) -> None:
    """Store samples so that a series is found without reading the rest: a folder for each run, sorted by name and time.

    Rows are dealt by ranges of (run, name, time), so a large run spreads over many files and each file holds few names;
    row groups are small enough for their minima and maxima to tell names apart. Writing a run again replaces it, other runs
    stay. Rows without run, name or time are stored as well. An empty table changes nothing.
    """
    laid = samples.repartitionByRange(run, *order).sortWithinPartitions(run, *order)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).option(
        "parquet.block.size", 16 << 20).partitionBy(run).parquet(path)


def read_series(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, runs: Sequence[int] | DataFrame | None = None,
    between_ms: tuple[int, int] | None = None, *, run: str = "run_id", run_type: str = "bigint",
) -> DataFrame:
    """Samples of a store of ``write_series``: runs choose folders, names and times choose row groups.

    ``runs`` is a list or a table with the run column; folders are pruned by a table when the query runs. An empty list
    gives no rows, None all of them.
    """
    schema = spark.read.parquet(path).schema
    typed = StructType([StructField(f.name, DataType.fromDDL(run_type)) if f.name == run else f for f in schema.fields])
    d = spark.read.schema(typed).parquet(path)
    if names is not None:
        d = d.where(F.col("name").isin(*names))
    if between_ms is not None:
        d = d.where(F.col("ts_ms").between(*between_ms))
    if isinstance(runs, DataFrame):
        return d.join(runs.select(run), [run], "left_semi").select(*d.columns)
    return d if runs is None else d.where(F.col(run).isin(*runs))
