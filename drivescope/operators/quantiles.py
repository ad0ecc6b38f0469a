"""Exact order statistics by rank, without sorting a whole group in one task.

Values are counted per (group, narrow value bin) with map-side combine; ranks are located on the bin counts, and only
the distinct values of the bins that hold a wanted rank are ordered. A bin is a pure function of the value, so the
two passes always agree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rank = Callable[[Column], Column]

_BIN = 4096.0


def nearest_rank(p: float) -> Rank:
    """1-based rank ceil(p*n)."""
    return lambda n: F.ceil(F.lit(p) * n)


def floor_index(p: float) -> Rank:
    """1-based rank floor(p*(n-1))+1; with p=0.5 the lower middle of an even count."""
    return lambda n: F.floor(F.lit(p) * (n - 1)) + 1


def upper_median() -> Rank:
    """1-based rank floor(n/2)+1."""
    return lambda n: F.floor(n / 2) + 1


def half_even_index(p: float) -> Rank:
    """1-based rank round_half_even(p*(n-1))+1."""
    return lambda n: F.bround(F.lit(p) * (n - 1), 0) + 1


def lower_middle() -> Rank:
    return lambda n: F.floor((n + 1) / 2)


def upper_middle() -> Rank:
    return lambda n: F.floor(n / 2) + 1


def value_bin(v: Column) -> Column:
    """Order-preserving bin number, about 1/4096 wide relative to the magnitude."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * F.lit(_BIN))).cast("long")


def pick_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Rank]) -> DataFrame:
    """One row per key with the count ``n`` and, per name in ``ranks``, the value at that rank."""
    keys = list(keys) or ["_all"]
    d = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    d = d.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    d = d.withColumn("_bin", value_bin(F.col("_v")))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    bins = (
        d.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_c"))
        .select(*keys, "_bin", "_c", F.sum("_c").over(upto).alias("_hi"), F.sum("_c").over(whole).alias("n"))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()
    ])
    targets = (
        bins.select(*keys, "_bin", "_lo", "_hi", "n", F.explode(wanted).alias("_t"))
        .where((F.col("_t.rank") > F.col("_lo")) & (F.col("_t.rank") <= F.col("_hi")))
        .select(*keys, "_bin", "_lo", "n", F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank"))
    )
    hit_bins = targets.select(*keys, "_bin").distinct()
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    on = [*keys, "_bin"]
    distinct_values = (
        _null_safe(d, hit_bins, on, "left_semi")
        .groupBy(*on, "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_cum", F.sum("_c").over(inside))
    )
    picked = _null_safe(targets, distinct_values, on, "inner").where(
        (F.col("_rank") - F.col("_lo") <= F.col("_cum")) & (F.col("_rank") - F.col("_lo") > F.col("_cum") - F.col("_c"))
    )
    out = picked.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks]
    )
    return out.drop("_all")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        part = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = part if cond is None else cond & part
    out = left.join(renamed, cond, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{c}" for c in on])


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """True median (mean of the two middle values)."""
    mid = pick_ranks(df, keys, value, {"_m1": lower_middle(), "_m2": upper_middle()})
    cols = [c for c in mid.columns if c not in ("_m1", "_m2")]
    return mid.select(*cols, ((F.col("_m1") + F.col("_m2")) / 2).alias(name))


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], extra: Mapping[str, Rank] | None = None) -> DataFrame:
    """True medians of several columns in one pass; nulls of each column are left out.

    ``extra`` maps ``name`` to a rank taken on the column of the same prefix ``column:name``.
    """
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("c"), F.col(v).cast("double").alias("v")) for v in values])).alias("_x"),
    ).select(*keys, F.col("_x.c").alias("_c_name"), F.col("_x.v").alias("_value"))
    ranks: dict[str, Rank] = {"_m1": lower_middle(), "_m2": upper_middle()}
    ranks.update({k.split(":", 1)[1]: r for k, r in (extra or {}).items()})
    got = pick_ranks(long, [*keys, "_c_name"], "_value", ranks)
    mid = (F.col("_m1") + F.col("_m2")) / 2
    aggs = [F.max(F.when(F.col("_c_name") == v, mid)).alias(f"{v}_median") for v in values]
    for k in extra or {}:
        column, name = k.split(":", 1)
        aggs.append(F.max(F.when(F.col("_c_name") == column, F.col(name))).alias(name))
    return got.groupBy(*keys).agg(*aggs)
