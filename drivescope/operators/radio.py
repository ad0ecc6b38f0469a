"""UMTS radio evidence: best server, pilot dominance, the snapshot before a call's end, pollution scoring.

Sample rows: ``device_id, ts_ms, row_seq, seq, psc, rscp, ecno, rssi, cell_id, uarfcn``; transmit power rows:
``device_id, ts_ms, seq, tx``; error-rate rows: ``device_id, ts_ms, seq, bler_max, bler_mean``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.operators import ordered, ranges, timejoin

KEYS = ("device_id",)


def best_server(mimo: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per measurement row: the PSC with the highest mean RSCP (first seen on a tie), the gap to the second, the PSC count."""
    row = [*keys, "ts_ms", "row_seq"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    blocks = mimo.where("psc is not null and rscp is not null and ecno is not null").groupBy(*row, "psc").agg(
        F.avg("rscp").alias("rscp"), F.avg("ecno").alias("ecno"), F.avg("rssi").alias("rssi"), first("cell_id").alias("cell_id"),
        first("uarfcn").alias("uarfcn"), F.min("seq").alias("_first"),
    )
    # one entry per scrambling code (at most 512), so the list is bounded
    levels = F.sort_array(F.collect_list("rscp"), asc=False)
    best = F.max_by(F.struct("psc", "rscp", "ecno", "rssi", "cell_id", "uarfcn"), F.struct("rscp", -F.col("_first")))
    return blocks.groupBy(*row).agg(best.alias("b"), F.count("*").alias("pilots"), levels.alias("_l")).select(
        *row, "b.*", "pilots", F.when(F.col("pilots") >= 2, F.col("_l")[0] - F.try_element_at("_l", F.lit(2))).alias("gap"))


def pilot_dominance(servers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gap statistics over the rows with two pilots or more, and pilot counts.

    The gaps are averages of few samples, so exact medians go through the binned ranks.
    """
    from drivescope.operators import quantiles

    g = servers.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count("gap").alias("two_pilot_rows"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_std"),
        F.count_if(F.col("gap") < 3).alias("gap_low_count"), F.avg("pilots").alias("pilots_mean"), F.max("pilots").alias("pilots_max"),
    )
    med = quantiles.median(servers.where("gap is not null"), keys, "gap", "gap_median").drop("n")
    return g.join(med, list(keys), "left").withColumn(
        "gap_low_ratio", F.when(F.col("two_pilot_rows") > 0, F.col("gap_low_count") / F.col("two_pilot_rows")))


def psc_switches(servers: DataFrame, keys: Sequence[str] = KEYS, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Number of best-server changes per key."""
    d = ordered.with_neighbors(servers, keys, previous={"_p": "psc"}, seq="row_seq", block_ms=block_ms)
    return d.groupBy(*keys).agg(F.count_if(F.col("_p") != F.col("psc")).alias("psc_switches"))


def active_set_changes(rows: DataFrame, keys: Sequence[str], size: str = "as_size", block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Rows where the active-set size moved, as Add or Remove events."""
    d = ordered.with_neighbors(rows.where(F.col(size).isNotNull()), keys, previous={"previous_size": size}, block_ms=block_ms)
    kind = F.when(F.col(size) > F.col("previous_size"), "AS Add").when(F.col(size) < F.col("previous_size"), "AS Remove")
    return d.withColumn("event", kind).where("event is not null")


def device_series_counts(mimo_rows: DataFrame, tx: DataFrame, bler: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per device in each radio table."""
    c = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    out = c(mimo_rows, "mimo_count").join(c(tx, "txpc_count"), list(keys), "full").join(c(bler, "rlc_count"), list(keys), "full")
    return out.fillna(0)


def radio_series(
    anchors: DataFrame, servers: DataFrame, tx: DataFrame, bler: DataFrame, *, anchor_id: Sequence[str] = ("device_id", "call_id"),
    end: str = "end_ts", window_ms: int = 20_000, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The samples of the window before each anchor's end as ordered lists, one row per anchor.

    ``server_series`` (best servers), ``server_runs`` (the first sample of each run of one code and channel), ``tx_series``
    and ``bler_series``. A list holds what one window holds, an empty one where there is nothing; rows of one time stay in
    their order. The three tables share one timeline: a bucket as long as the window has its samples, and those of the one
    before, as sorted arrays, and an anchor cuts its lists out of these in the row, so no pairs are formed, sorted or shuffled.
    Anchors without end have no window and are left out; anchor ids are unique.
    """
    aid = list(anchor_id)
    none = lambda t: F.lit(None).cast(t)
    server = F.struct("ts_ms", "psc", "uarfcn", "rscp", "ecno")
    power = F.struct("ts_ms", "tx")
    errors = F.struct("ts_ms", "bler_max", "bler_mean")
    kind = {n: d.select(x.alias("x")).schema["x"].dataType for n, d, x in (("server", servers, server), ("power", tx, power), ("errors", bler, errors))}

    def line(rows: DataFrame, seq: str, **own: Column) -> DataFrame:
        return rows.select(*keys, "ts_ms", F.col(seq).cast("long").alias("seq"), *[own.get(n, none(t)).alias(n) for n, t in kind.items()])

    rows = line(servers, "row_seq", server=server).unionByName(line(tx.where("tx is not null"), "seq", power=power)).unionByName(line(bler, "seq", errors=errors))
    a = anchors.where(F.col(end).isNotNull()).select(*dict.fromkeys([*aid, *keys]), F.col(end).alias("_end"))
    width = window_ms + 1
    bucket = [f"_k{i}" for i in range(len(keys))] + ["_bucket"]
    held = [F.col(k).alias(n) for k, n in zip(keys, bucket, strict=False)]
    known = " and ".join(f"`{c}` is not null" for c in [*keys, "ts_ms"])

    def sorted_(kind: str) -> Column:
        item = F.struct(F.col("ts_ms").alias("t"), "seq", F.col(kind).alias("v"))
        return F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), item))).alias(kind)

    reach = F.sequence(ordered.block_of("ts_ms", width), ordered.block_of(F.col("ts_ms") + window_ms, width))
    # both sides by the configured number of partitions: their bytes say little about the length of the lists
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = rows.where(known).select("ts_ms", "seq", *kind, *held, F.explode(reach).alias("_bucket")).repartition(parts, *bucket).groupBy(*bucket).agg(*[sorted_(n) for n in kind])
    cell = lambda x: F.struct(x["v"]["psc"], x["v"]["uarfcn"])
    begins = lambda x, i: F.struct(x["t"].alias("t"), x["v"].alias("v"), (~cell(x).eqNullSafe(cell(F.get("server", i - 1)))).alias("begins"))
    arrays = arrays.withColumn("server", F.transform("server", begins))
    same = [F.col(k) == F.col(n) for k, n in zip(keys, bucket, strict=False)]
    asked = a.withColumn("_asked", ordered.block_of("_end", width)).repartition(parts, *keys, "_asked")
    d = asked.join(arrays.hint("merge"), [*same, F.col("_asked") == F.col("_bucket")], "left")
    inside = {n: F.filter(n, lambda x: x["t"].between(F.col("_end") - window_ms, F.col("_end"))) for n in kind}
    d = d.select(*aid, *[c.alias(n) for n, c in inside.items()])
    cut = lambda x: F.coalesce(F.transform(x, lambda y: y["v"]), F.array())
    return d.select(*aid, cut(F.col("server")).alias("server_series"), cut(F.filter("server", lambda x, i: (i == 0) | x["begins"])).alias("server_runs"),
                    cut(F.col("power")).alias("tx_series"), cut(F.col("errors")).alias("bler_series"))


def _window_figures(
    anchors: DataFrame, rows: DataFrame, values: Sequence[str], aid: Sequence[str], keys: Sequence[str], window_ms: int, figures: Callable, schema: str,
    order: Sequence[str] = ("ts_ms", "seq"),
) -> DataFrame:
    """``figures(columns, valid, times, lo, hi)`` over the rows [lo, hi) of each anchor's window; anchors without rows are left out."""

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        t, end = ranges.numbers(found["ts_ms"]), ranges.numbers(asked["_end"])
        lo, hi = np.searchsorted(t, end - window_ms), np.searchsorted(t, end, "right")
        asked, lo, hi = asked.filter(pa.array(hi > lo)), lo[hi > lo], hi[hi > lo]
        columns, valid = {c: ranges.numbers(found[c]) for c in values}, {c: found[c].is_valid().to_numpy() for c in values}
        named = figures(columns, valid, t, lo, hi)
        return pa.table([*[asked[c] for c in aid], *named.values()], names=[*aid, *named])

    ids = ", ".join(f"`{n}` {anchors.schema[n].dataType.simpleString()}" for n in aid)
    return ranges.per_stretch(anchors, rows.select(*dict.fromkeys([*keys, *order, *values])), keys, window_ms, 0, answer, f"{ids}, {schema}", anchor_ts="_end", order=order)


_counted = ranges.counted


def _power(columns: dict, valid: dict, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, pa.Array]:
    tx, n = columns["tx"], hi - lo
    all_ = np.full(len(n), True)
    p90 = ranges.kth_in(tx, lo, hi, np.ceil(n * 0.9).astype(np.int64) - 1)
    return {"tx_p90": ranges.real(p90, all_), "tx_max": ranges.real(tx[ranges.best_in(tx, lo, hi)], all_), "tx_last": ranges.real(tx[hi - 1], all_),
            "tx_count": pa.array(n), "last_tx_ts": ranges.whole(t[hi - 1])}


def _errors(columns: dict, valid: dict, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, pa.Array]:
    worst, mean, there, known = columns["bler_max"], columns["bler_mean"], valid["bler_max"], valid["bler_mean"]
    n = _counted(known, lo, hi)
    worst = np.where(there, worst, -np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        average = ranges.sum_in(np.where(known, mean, 0.0), lo, hi) / n
        trend = mean[hi - 1] - mean[lo]
    return {"bler_max": ranges.real(worst[ranges.best_in(worst, lo, hi)], _counted(there, lo, hi) > 0), "bler_mean": ranges.real(average, n > 0),
            "bler_rows": pa.array(hi - lo), "bler_trend": ranges.real(trend, known[hi - 1] & known[lo])}


def _gaps(columns: dict, valid: dict, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, pa.Array]:
    known = valid["gap"]
    upto = np.concatenate([[0], np.cumsum(known)])
    gap, first, last = columns["gap"][known], upto[lo], upto[hi]
    n = last - first
    some, median = n > 0, np.full(len(n), np.nan)
    middle = lambda k: ranges.kth_in(gap, first[some], last[some], k[some])
    lower, upper = middle((n - 1) // 2), middle(n // 2)
    median[some] = np.where(lower == upper, lower, 0.5 * lower + 0.5 * upper)
    return {"cell_rows": pa.array(hi - lo), "cell_level_rows": pa.array(_counted(columns["levels"] > 0, lo, hi)), "cell_other_rows": pa.array(_counted(columns["others"] > 0, lo, hi)),
            "cell_gaps": pa.array(n), "cell_gap_median": ranges.real(median, some), "_low": pa.array(_counted(columns["gap"] < 3, lo, hi))}


def radio_snapshot(
    anchors: DataFrame, servers: DataFrame, tx: DataFrame, bler: DataFrame, *, anchor_id: Sequence[str] = ("device_id", "call_id"),
    end: str = "end_ts", window_ms: int = 10_000, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Radio evidence in the window before each anchor's end, one row per anchor (also for anchors without samples).

    Powers and block errors come many a second: their windows are ranges of sorted samples (``ranges``), without pairs. Best
    servers come once a scan, their pairs are formed. Anchor ids are unique.
    """
    aid = list(anchor_id)
    a = anchors.where(F.col(end).isNotNull()).select(*dict.fromkeys([*aid, *keys]), F.col(end).alias("_end"))
    p = timejoin.interval_join(a, servers, keys, window_ms, 0, anchor_ts="_end").select(
        *aid, *[F.col(f"row.{c}").alias(c) for c in servers.columns if c not in aid])
    p = p.repartition(*aid)
    w = Window.partitionBy(*aid).orderBy("ts_ms", "row_seq")
    p = p.withColumn("_p", F.lag("psc").over(w))
    order = F.struct("ts_ms", "row_seq")
    last = F.max_by(F.struct("psc", "cell_id", "uarfcn", "rscp", "ecno", "rssi", "ts_ms"), order)
    first = F.min_by(F.struct("rscp", "ecno", "ts_ms"), order)
    strong = F.col("rscp") > -85
    s = p.groupBy(*aid).agg(
        F.count("*").alias("mimo_count"), F.median("rscp").alias("rscp_median"), F.min("rscp").alias("rscp_min"), F.max("rscp").alias("rscp_max"),
        F.median("ecno").alias("ecno_median"), F.min("ecno").alias("ecno_min"), F.max("ecno").alias("ecno_max"),
        last.alias("_last"), first.alias("_first"), F.count_distinct("psc").alias("unique_psc"), F.count_if(F.col("_p") != F.col("psc")).alias("psc_switches"),
        F.count_if(strong).alias("strong_count"), F.count_if(strong & (F.col("ecno") < -14)).alias("strong_bad_count"),
        F.count("gap").alias("two_pilot_rows"), F.median("gap").alias("gap_median"), F.stddev_pop("gap").alias("gap_std"),
        F.count_if(F.col("gap") < 3).alias("gap_low_count"), F.avg("pilots").alias("pilots_mean"), F.max("pilots").alias("pilots_max"),
    )
    mode = p.groupBy(*aid, "psc").agg(F.count("*").alias("_c"), F.max(order).alias("_l")).groupBy(*aid).agg(
        F.min_by("psc", F.struct(-F.col("_c"), F.col("_l"))).alias("best_psc"))
    t = _window_figures(a, tx.where("tx is not null"), ["tx"], aid, keys, window_ms, _power, "tx_p90 double, tx_max double, tx_last double, tx_count long, last_tx_ts long")
    b = _window_figures(a, bler, ["bler_max", "bler_mean"], aid, keys, window_ms, _errors, "bler_max double, bler_mean double, bler_rows long, bler_trend double")
    d = a.select(*aid).join(s, aid, "left").join(mode, aid, "left").join(t, aid, "left").join(b, aid, "left")
    counts = ["mimo_count", "unique_psc", "psc_switches", "strong_count", "strong_bad_count", "two_pilot_rows", "gap_low_count", "tx_count", "bler_rows"]
    d = d.fillna(0, counts)
    ratio = lambda n, m: F.when(F.col(m) > 0, F.col(n) / F.col(m))
    trend = F.col("mimo_count") >= 2
    return (
        d.withColumn("rscp_last", F.col("_last.rscp")).withColumn("ecno_last", F.col("_last.ecno")).withColumn("last_psc", F.col("_last.psc"))
        .withColumn("last_cell_id", F.col("_last.cell_id")).withColumn("last_uarfcn", F.col("_last.uarfcn")).withColumn("last_mimo_ts", F.col("_last.ts_ms"))
        .withColumn("rscp_trend", F.when(trend, F.col("_last.rscp") - F.col("_first.rscp")))
        .withColumn("ecno_trend", F.when(trend, F.col("_last.ecno") - F.col("_first.ecno")))
        .withColumn("trend_sec", F.when(trend, F.greatest(F.lit(0.001), (F.col("_last.ts_ms") - F.col("_first.ts_ms")) / 1000)))
        .withColumn("strong_share", ratio("strong_count", "mimo_count")).withColumn("strong_bad_ratio", ratio("strong_bad_count", "strong_count"))
        .withColumn("gap_low_ratio", ratio("gap_low_count", "two_pilot_rows")).withColumn("gap_coverage", ratio("two_pilot_rows", "mimo_count"))
        .withColumn("gap_std", F.when(F.col("two_pilot_rows") > 0, F.col("gap_std")))
        .withColumn("bler_evidence", F.col("bler_rows") >= 3).drop("_last", "_first")
    )


def _level(score: Column) -> Column:
    return F.when(score >= 60, "High").when(score >= 35, "Moderate").otherwise("Low")


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for cond, n in rules:
        total = total + F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return total


def cell_corroboration(
    anchors: DataFrame, cells: DataFrame, *, anchor_id: Sequence[str] = ("device_id", "call_id"), end: str = "end_ts", window_ms: int = 10_000,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Dominance as a second source sees it: cell measurements ``ts_ms, pilots_a, pilots_b, gap`` in the window before each anchor's end.

    Gaps exist where levels of two pilots of the first kind are known. Anchors without end or rows have counts of 0; the reason
    says why no gap is there.
    """
    aid = list(anchor_id)
    a = anchors.where(F.col(end).isNotNull()).select(*dict.fromkeys([*aid, *keys]), F.col(end).alias("_end"))
    levels = F.coalesce(F.col("pilots_a"), F.lit(0)) > 0
    rows = cells.select(*keys, "ts_ms", levels.cast("int").alias("levels"), F.coalesce(~levels & (F.col("pilots_b") > 0), F.lit(False)).cast("int").alias("others"), F.when(levels, F.col("gap")).alias("gap"))
    g = _window_figures(a, rows, ["levels", "others", "gap"], aid, keys, window_ms, _gaps,
                        "cell_rows long, cell_level_rows long, cell_other_rows long, cell_gaps long, cell_gap_median double, _low long", ["ts_ms"])
    counts = ["cell_rows", "cell_level_rows", "cell_other_rows", "cell_gaps"]
    d = anchors.select(*aid).join(g, aid, "left").fillna(0, counts)
    c = F.col
    share = lambda n, m: F.when(c(m) > 0, c(n) / c(m))
    reason = F.when(c("cell_gaps") > 0, None).when(c("cell_rows") == 0, CELL_REASONS["no rows"]).when(
        (c("cell_level_rows") == 0) & (c("cell_other_rows") > 0), CELL_REASONS["no levels"]).otherwise(CELL_REASONS["one pilot"])
    return d.withColumn("cell_gap_low_ratio", share("_low", "cell_gaps")).withColumn("cell_coverage", share("cell_gaps", "cell_rows")).withColumn(
        "cell_reason", reason).drop("_low")


# Why a second source tells nothing.
CELL_REASONS = {
    "no rows": "no UMTS CELLMEAS rows in window",
    "no levels": "neighbor RSCP unavailable (unsupported CELLMEAS subtype)",
    "one pilot": "no >=2 subtype-A pilots per timestamp",
}


# By profile, the points for three pilots, for the mean of pilots and for switches, and the last two's limits.
DOMINANCE_POINTS = {"default": (20, 10, 20), "extended": (10, 5, 15)}
PILOTS_MEAN = {"default": 2.0, "extended": 2.5}
SWITCHES = {"default": 2, "extended": 3}


def pilot_pollution_score(snapshot: DataFrame, profile: str = "default") -> DataFrame:
    """Dominance and interference scores, their levels, and the final label of each snapshot.

    The ``extended`` profile asks for more pilots and switches, needs a weak-dominance signature (median gap below 3 dB, more
    than 30 % of gaps below 3 dB) before it speaks of overlap, and has a guard: under strong dominance (median gap 6 dB or
    more, at most 20 % of gaps below 3 dB) the dominance score ends at 20 and overlap is ruled out. With the columns of
    :func:`cell_corroboration` it also says whether the second source agrees.
    """
    c = F.col
    extended = profile == "extended"
    known = lambda x: F.coalesce(x, F.lit(False))
    available = known(c("two_pilot_rows") > 0)
    evidence = known(available & (c("gap_coverage") >= 0.30))
    many, mean, switching = DOMINANCE_POINTS[profile]
    dominance = F.when(available, F.least(F.lit(100), _points(
        (evidence & (c("gap_median") < 2), 30), (evidence & (c("gap_low_ratio") > 0.70), 30), (evidence & (c("gap_std") > 2), 10),
        (c("pilots_max") >= 3, many), (c("pilots_mean") >= PILOTS_MEAN[profile], mean), (c("psc_switches") > SWITCHES[profile], switching))))
    guard = known(evidence & (c("gap_median") >= 6) & (c("gap_low_ratio") <= 0.20)) if extended else F.lit(False)
    signature = known(evidence & (c("gap_median") < 3) & (c("gap_low_ratio") > 0.30)) if extended else evidence
    interference = _points((c("bler_max") >= 80, 40), (c("ecno_median") <= -12, 30), (c("rscp_median") >= -90, 20), (c("tx_p90") <= 18, 10))
    d = (
        snapshot.withColumn("dominance_available", available).withColumn("dominance_evidence", evidence).withColumn("strong_dominance", guard)
        .withColumn("overlap_signature", signature)
        .withColumn("dominance_score", F.when(c("strong_dominance"), F.least(F.lit(20), dominance)).otherwise(dominance).cast("long"))
        .withColumn("interference_score", interference.cast("long"))
    )
    dom, itf, strong = c("dominance_score"), c("interference_score"), c("strong_dominance")
    collapse = known((c("bler_max") >= 80) & (c("rscp_median") >= -90) & (c("tx_p90") <= 18))
    share = c("strong_share")
    guarded = strong & (itf >= 60)
    hot = (itf >= 60) & (known(share >= 0.30) | collapse)
    weak = c("overlap_signature") & (dom >= 60) & known(share < 0.30)
    overlap = c("overlap_signature") & (dom >= 35)
    quiet = ~c("dominance_evidence") & (itf < 60)
    coverage = F.when(c("rscp_median") > -85, "strong").when(c("rscp_median") > -95, "fair").otherwise("weak") if extended else F.lit("weak")
    label = (
        F.when(guarded, "DL Interference (strong dominance, overlap unlikely)")
        .when(hot & c("dominance_evidence"), "Pilot Pollution / DL Interference").when(hot, "DL Interference (dominance evidence unavailable)")
        .when(weak, F.concat(F.lit("High overlap / poor dominance under "), coverage, F.lit(" coverage"))).when(overlap, "Overlap risk")
        .when(strong, "Low overlap risk (strong dominance)")
        .when(quiet, "Dominance unavailable / low interference risk").otherwise("Low overlap risk")
    )
    score = F.when(guarded, dom).when(hot, itf).when(weak | overlap | strong, dom).when(quiet, itf).otherwise(F.when(c("dominance_available"), dom).otherwise(itf))
    d = d.withColumn("pollution_label", label).withColumn("pollution_score", score)
    d = (
        d.withColumn("dominance_level", F.when(c("dominance_available"), _level(dom)).otherwise("N/A")).withColumn("interference_level", _level(itf))
        .withColumn("pollution_level", F.when(c("dominance_available"), _level(c("pollution_score"))).otherwise("N/A"))
        .withColumn("pollution_detected", c("pollution_score") >= 35)
    )
    if not extended:
        return d.drop("strong_dominance", "overlap_signature")
    if "cell_gaps" not in snapshot.columns:
        return d
    both = available & (c("cell_gaps") > 0) & c("gap_median").isNotNull()
    near = known((F.abs(c("cell_gap_median") - c("gap_median")) <= 1.5) & (F.abs(c("cell_gap_low_ratio") - c("gap_low_ratio")) <= 0.20))
    return d.withColumn("cell_agreement", F.when(~both, "n/a").when(near, "agree").otherwise("disagree"))
