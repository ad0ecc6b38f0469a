"""Operators over metric series: changes, dips, sampling, throughput statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.operators import ordered, quantiles
from drivescope.operators.staging import materialize
from drivescope.operators.timejoin import exact_second_join, nearest_join

RUN_KEYS = ("run_id", "name")


def numeric_only(df: DataFrame, value: str = "value_num") -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v.cast("double")))


def _number(value: str) -> Column:
    """The value where it is a number."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def state_changes(
    series: DataFrame, keys: Sequence[str] = RUN_KEYS, threshold: float = 0.0, value: str = "value_num", ts: str = "ts_ms",
    block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """Rows whose value moved by more than ``threshold`` from the row before."""
    d = ordered.with_neighbors(
        numeric_only(series, value), keys, previous={"from_value": value}, ts=ts, block_ms=block_ms
    )
    return d.where(F.abs(F.col(value) - F.col("from_value")) > threshold).select(
        *keys, ts, "seq", "from_value", F.col(value).alias("to_value")
    )


def detect_dips(
    series: DataFrame, keys: Sequence[str] = RUN_KEYS, threshold: float = 5.0, min_duration_sec: float = 3.0,
    value: str = "value_num", ts: str = "ts_ms", block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """Longest runs of consecutive rows below ``threshold`` lasting at least ``min_duration_sec``."""
    low = F.col(value) < threshold
    d = numeric_only(series, value).where(F.col(ts).isNotNull())
    d = ordered.with_running_sum(
        d, keys, {"_pos": F.lit(1), "_island": F.when(~low, 1).otherwise(0)}, ts=ts, block_ms=block_ms
    )
    runs = d.where(low).groupBy(*keys, "_island").agg(
        F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.min(value).alias("min_value"),
        (F.min("_pos") - 1).alias("start_index"), (F.max("_pos") - 1).alias("end_index"),
    )
    duration = (F.col("end_ms") - F.col("start_ms")) / 1000
    return runs.withColumn("duration_sec", duration).where(F.col("duration_sec") >= min_duration_sec).drop("_island")


def first_sustained(
    series: DataFrame, keys: Sequence[str], condition: Column, sustain_ms: int, ts: str = "ts_ms",
    block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """First time ``condition`` holds on a row whose next row is at least ``sustain_ms`` later (0: the first hit)."""
    hit = condition
    d = series
    if sustain_ms > 0:
        d = ordered.with_neighbors(series, keys, following={"_next_ts": ts}, ts=ts, block_ms=block_ms)
        hit = condition & (F.col("_next_ts") - F.col(ts) >= sustain_ms)
    return d.groupBy(*keys).agg(F.min(F.when(hit, F.col(ts))).alias("first_ts"))


def downsample(
    series: DataFrame, keys: Sequence[str], max_points: int, ts: str = "ts_ms",
    same: Sequence[str] = ("ts_ms", "value_num"), block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """At most ``max_points`` evenly spaced rows per key, first and last kept; equal neighbours are merged."""
    if max_points <= 0:
        return series
    d = ordered.with_row_number(series, keys, "_pos", ts=ts, block_ms=block_ms)
    sizes = series.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = ordered.attach(d, sizes, keys, by=(ts, "seq"))
    pos, n = F.col("_pos") - 1, F.col("_n")
    if max_points < 3:
        keep = (pos == 0) | (pos == n - 1)
    else:
        step = (n - 1) / F.lit(max_points - 1)
        guess = F.floor(pos / step)
        hits = [
            ((guess + k) >= 0) & ((guess + k) <= max_points - 1) & (F.bround((guess + k) * step, 0) == pos) for k in (-1, 0, 1, 2)
        ]
        keep = hits[0] | hits[1] | hits[2] | hits[3]
    picked = d.where((n <= max_points) | keep)
    if max_points >= 3 and same:
        token = F.struct(*same)
        picked = ordered.with_neighbors(picked, keys, previous={"_before": token}, ts=ts, block_ms=block_ms)
        picked = picked.where((n <= max_points) | F.col("_before").isNull() | ~F.col("_before").eqNullSafe(token)).drop("_before")
    return picked.drop("_pos", "_n")


def interval_stats(
    series: DataFrame, keys: Sequence[str] = RUN_KEYS, ts: str = "ts_ms", block_ms: int = ordered.HOUR_MS
) -> DataFrame:
    """Positive gaps between successive rows: min, p50, p90, max and the per-TTI flag (p50 <= 2 ms)."""
    gaps = (
        ordered.with_neighbors(series.where(F.col(ts).isNotNull()), keys, previous={"_p": ts}, ts=ts, block_ms=block_ms)
        .withColumn("gap", F.col(ts) - F.col("_p"))
        .where("gap > 0")
    )
    ranks = {
        "gap_min": quantiles.nearest_rank(0.0), "gap_p50": quantiles.upper_median(),
        "gap_p90": quantiles.half_even_index(0.9), "gap_max": quantiles.nearest_rank(1.0),
    }
    ranks["gap_min"] = lambda n: F.lit(1)
    out = quantiles.pick_ranks(gaps, keys, "gap", ranks)
    return out.withColumnRenamed("n", "gap_count").withColumn("per_tti", F.col("gap_p50") <= 2)


def throughput_divisor(median: Column) -> Column:
    return F.when(median >= 1_000_000, 1_000_000.0).when(median >= 1_000, 1_000.0).otherwise(1.0)


def normalize_throughput(series: DataFrame, keys: Sequence[str] = RUN_KEYS, value: str = "value_num") -> DataFrame:
    """Divide by 1e6, 1e3 or 1 by the upper median of the positive values of the key."""
    d = numeric_only(series, value)
    med = quantiles.pick_ranks(d.where(F.col(value) > 0), keys, value, {"_median": quantiles.upper_median()}).drop("n")
    d = ordered.attach(d, med, keys, "left")
    m = F.coalesce(F.col("_median"), F.lit(0.0))
    return (
        d.withColumn("divisor", throughput_divisor(m))
        .withColumn("unit_label", F.when(F.col("divisor") == 1.0, "Mbps (raw)").otherwise("Mbps"))
        .withColumn("value_mbps", F.col(value) / F.col("divisor"))
        .drop("_median")
    )


def normalize_metric_series(
    series: DataFrame, normalization: Column, keys: Sequence[str] = RUN_KEYS, value: str = "value_num"
) -> DataFrame:
    """Unit rule per series (``Mbps``, ``percent``, ``ms``, other) decided on the lower-middle median."""
    d = numeric_only(series, value)
    med = quantiles.pick_ranks(d, keys, value, {"raw_median": quantiles.floor_index(0.5)}).drop("n")
    d = ordered.attach(d, med, keys).withColumn("_norm", normalization)
    m, y = F.col("raw_median"), F.col(value)
    mbps, pct, ms = (F.col("_norm") == x for x in ("Mbps", "percent", "ms"))
    conversion = (
        F.when(mbps & (m >= 1_000_000), "bps->Mbps").when(mbps & (m >= 1_000), "kbps->Mbps").when(mbps, "already-Mbps")
        .when(pct & (m <= 1.0), "fraction->percent").when(pct, "already-percent")
        .when(ms & (m > 10_000), "warning-possible-microseconds").otherwise("none")
    )
    scaled = (
        F.when(F.col("conversion") == "bps->Mbps", y / 1_000_000).when(F.col("conversion") == "kbps->Mbps", y / 1_000)
        .when(F.col("conversion") == "fraction->percent", y * 100).otherwise(y)
    )
    unit = F.when(mbps, "Mbps").when(pct, "%").when(ms, "ms").otherwise(F.coalesce(F.col("_norm"), F.lit("unitless")))
    return d.withColumn("conversion", conversion).withColumn("y", scaled).withColumn("unit", unit).drop("_norm")


def throughput_summary(
    series: DataFrame, keys: Sequence[str] = RUN_KEYS, value: str = "value_mbps", low_threshold: float = 5.0
) -> DataFrame:
    """avg, floor-index median/p10/p90, peak, share below the threshold, count; nulls and 0 for a series without numbers."""
    number = _number(value)
    simple = series.groupBy(*keys).agg(
        F.avg(number).alias("avg"), F.max(number).alias("peak"),
        F.avg(F.when(number.isNotNull(), F.when(number < low_threshold, 100.0).otherwise(0.0))).alias("pct_below"),
        F.count(number).alias("sample_count"),
    )
    ranks = {"median": quantiles.floor_index(0.5), "p10": quantiles.floor_index(0.1), "p90": quantiles.floor_index(0.9)}
    return simple.join(quantiles.pick_ranks(series, keys, value, ranks).drop("n"), list(keys), "left")


def pearson(pairs: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Correlation per key; null below three pairs or without variance."""
    ok = (F.count("*") >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return pairs.groupBy(*keys).agg(F.when(ok, F.corr(a, b)).alias("correlation"), F.count("*").alias("pairs"))


def mismatch_verdict(
    radio: DataFrame, app: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "value_num"
) -> DataFrame:
    """Radio against application throughput, second by second: who is the bottleneck.

    A key without usable pairs is ``mixed`` and has no figures.
    """
    pairs = exact_second_join(radio, app, keys, value=value).where("a > 0").withColumn("ratio", F.col("b") / F.col("a"))
    med = quantiles.pick_ranks(pairs, keys, "ratio", {"ratio_median": quantiles.floor_index(0.5)}).drop("n")
    ok = (F.count("*") >= 3) & (F.var_pop("a") > 0) & (F.var_pop("b") > 0)
    out = pairs.groupBy(*keys).agg(
        (F.sum(F.when(F.col("b") < F.col("a") * 0.7, 1).otherwise(0)) / F.count("*") * 100).alias("app_lt_70_pct"),
        F.when(ok, F.corr("a", "b")).alias("correlation"), F.count("*").alias("pairs"),
    ).join(med, list(keys), "left")
    known = radio.select(*keys).unionByName(app.select(*keys)).distinct()
    out = known.join(out, list(keys), "left").fillna({"pairs": 0})
    flag = F.when((F.col("ratio_median") < 0.7) & (F.col("app_lt_70_pct") > 40), "app-limited").when(
        F.col("ratio_median") >= 0.9, "radio-limited"
    )
    return out.withColumn("flag", flag.otherwise("mixed"))


# Range rules by token in the KPI key, all matching rules run.
SANITY_RULES = [
    (("cqi",), 0, 15, "CQI"), (("ri", "rank"), 0, 4, "RI/Rank"), (("mcs",), 0, 31, "MCS"), (("bler",), 0, 100, "BLER"),
    (("code_rate", "code"), 0, 120, "Code rate"), (("prb", "rb"), 0, 300, "PRB/RB"),
    (("rtt", "jitter"), 0, 2000, "RTT/Jitter"), (("loss",), 0, 100, "Packet loss"),
]


def sanity_check(series: DataFrame, keys: Sequence[str] = RUN_KEYS, key: str = "name", value: str = "value_num") -> DataFrame:
    """Min/max of each series against every range rule whose token its key holds; a series without numbers passes."""
    ranges = series.groupBy(*keys).agg(F.min(_number(value)).alias("lo"), F.max(_number(value)).alias("hi"))
    empty = F.col("lo").isNull()
    low_key = F.lower(key)
    notes, fails = [], []
    for tokens, lo, hi, label in SANITY_RULES:
        has = F.lit(False)
        for t in tokens:
            has = has | low_key.contains(t)
        bad = (F.col("lo") < lo) | (F.col("hi") > hi)
        text = F.format_string(f"{label}: out-of-range [%.2f, %.2f], expected {lo}..{hi}", F.col("lo"), F.col("hi"))
        notes.append(F.when(has, F.when(bad, text).otherwise(f"{label}: ok")))
        fails.append(F.when(has & bad, 1).otherwise(0))
    checks = F.array_compact(F.array(*notes))
    checks = F.when(F.size(checks) == 0, F.array(F.lit("No rule for this KPI key"))).otherwise(checks)
    checks = F.when(empty, F.array(F.lit("No numeric samples"))).otherwise(checks)
    return ranges.withColumn("checks", checks).withColumn("pass", empty | (sum(fails[1:], fails[0]) == 0))


def throughput_report(
    series: DataFrame, track: DataFrame, run_keys: Sequence[str] = ("run_id",), *, name: str = "name",
    radio_name: str, app_name: str, low_threshold: float = 5.0, min_dip_sec: float = 3.0, tolerance_ms: int = 500,
    value: str = "value_num",
) -> DataFrame:
    """One row per (run, series): unit, summary, dips, map coverage and the radio/application verdict."""
    keys = [*run_keys, name]
    norm = materialize(normalize_throughput(series, keys, value), "throughput")
    summary = throughput_summary(norm, keys, "value_mbps", low_threshold)
    unit = norm.groupBy(*keys).agg(F.max("divisor").alias("divisor"), F.max("unit_label").alias("unit_label"))
    dips = detect_dips(norm, keys, low_threshold, min_dip_sec, "value_mbps").groupBy(*keys).agg(
        F.count("*").alias("dip_count"), F.max("duration_sec").alias("longest_dip_sec"), F.min("min_value").alias("deepest_dip")
    )
    located = nearest_join(
        track, norm.select(*keys, "ts_ms", "seq", "value_mbps"), keys, tolerance_ms
    ).groupBy(*keys).agg(F.count("*").alias("located_points"), F.avg("match.value_mbps").alias("located_avg"))
    verdict = mismatch_verdict(
        norm.where(F.col(name) == radio_name), norm.where(F.col(name) == app_name), run_keys, "value_mbps"
    ).select(*run_keys, "flag", "ratio_median")
    out = summary.join(unit, keys).join(dips, keys, "left").join(located, keys, "left").join(verdict, list(run_keys), "left")
    return out.fillna({"dip_count": 0, "located_points": 0, "flag": "mixed"})
