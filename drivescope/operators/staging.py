"""Cut a plan that several branches read: write it once, read it back as a columnar table.

The table goes to the shared folder of ``spark.checkpoint.dir``; where a session has no such setting, to a folder of the
warehouse, which every session has and all executors share. Losing an executor costs nothing, and every branch scans only
the columns it needs. The file system deletes the tables when the driver ends.
"""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivescope.operators.ordered import attach

_SETTING = "spark.checkpoint.dir"


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging").rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{staging_dir(spark)}/drivescope/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """The same rows, read back from a table written once."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach_sized(df: DataFrame, per_key: DataFrame, keys: Sequence[str], by: Sequence[str], most: int = 100_000) -> DataFrame:
    """Joins one small row a key to many rows, by the number of keys.

    The rows of the keys are staged and counted. Up to ``most`` of them go to every executor and ``df`` stays where it is;
    beyond that the rows of a key are dealt over tasks by a hash of ``by`` (``ordered.attach``).
    """
    staged = materialize(per_key, "per_key")
    if staged.count() <= most:
        return df.join(F.broadcast(staged), list(keys))
    return attach(df, staged, keys, by=by)
