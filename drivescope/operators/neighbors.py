"""Serving cell and neighbours: measurement configuration over time, report matching, merging, A3 evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators import ordered, ranges, timejoin
from drivescope.operators.staging import materialize

RUN = ("run_id",)

# Candidate metrics per serving field, best first.
_C8, _CT = "Radio.Lte.ServingCell[8]", "Radio.Lte.ServingCellTotal"
SERVING_CANDIDATES = {
    "pci": [f"{_C8}.Pci", f"{_CT}.Pci"], "rsrp": [f"{_C8}.Rsrp", f"{_CT}.Rsrp"], "rsrq": [f"{_C8}.Rsrq", f"{_CT}.Rsrq"],
    "sinr": [f"{_C8}.RsSinr", f"{_C8}.Sinr", f"{_C8}.Cinr", f"{_CT}.RsSinr", f"{_CT}.Sinr", f"{_CT}.Cinr"],
    "earfcn": [f"{_C8}.Downlink.Earfcn", f"{_CT}.Downlink.Earfcn", f"{_C8}.Earfcn"],
    "eci": [f"{_C8}.CellIdentity.Complete", f"{_CT}.CellIdentity.Complete", f"{_C8}.CellIdentity"],
}
# Neighbour metrics per field, best first.
_N = "Radio.Lte.Neighbor[64]"
NEIGHBOR_CANDIDATES = {
    "pci": [f"{_N}.Pci"], "rsrp": [f"{_N}.Rsrp"], "rsrq": [f"{_N}.Rsrq"], "cinr": [f"{_N}.Cinr", f"{_N}.Sinr"],
    "earfcn": [f"{_N}.Earfcn", f"{_N}.Frequency"],
}


def tag_fields(samples: DataFrame, candidates: Mapping[str, Sequence[str]], keys: Sequence[str] = RUN) -> DataFrame:
    """Samples of the first candidate metric each run has, per field (column ``field``)."""
    rules = [
        F.struct(F.lit(field).alias("field"), F.lit(name).alias("cand"), F.lit(i).alias("rank"))
        for field, names in candidates.items() for i, name in enumerate(names)
    ]
    wanted = sorted({n for names in candidates.values() for n in names})
    s = samples.where(F.col("name").isin(*wanted))
    names = s.select(*keys, "name").distinct().withColumn("_r", F.explode(F.array(*rules))).where(F.col("name") == F.col("_r.cand"))
    chosen = names.groupBy(*keys, F.col("_r.field").alias("field")).agg(F.min_by("name", "_r.rank").alias("name"))
    return ordered.attach(s, chosen, [*keys, "name"])


def nearest_in_window(
    times: DataFrame, samples: DataFrame, candidates: Mapping[str, Sequence[str]], tolerance_ms: int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Per asked time and field: the chosen metric and its value closest in time (null when the window holds none)."""
    tol = max(1, tolerance_ms)
    tagged = tag_fields(samples, candidates, keys)
    chosen = tagged.select(*keys, "field", "name").distinct()
    # one anchor a time and field, so only the nearest samples of the field meet it
    asked = ordered.attach(times.select(*keys, "time_id", "ts_ms"), chosen.groupBy(*keys).agg(F.collect_set("field").alias("field")), keys, by=("ts_ms", "time_id"))
    row = tagged.where("value_num is not null").select(
        *keys, "field", "ts_ms", F.coalesce("idx", F.lit(0)).alias("idx"), "seq", "value_num")
    t = F.col("row.ts_ms")
    order = F.struct(F.abs(t - F.col("ts_ms")), t, F.col("row.idx"), F.col("row.seq"))
    pairs = timejoin.nearest_pairs(asked.withColumn("field", F.explode("field")), row, [*keys, "field"], tol, tol, ties=("idx", "seq"))
    best = pairs.groupBy(*keys, "time_id", "field").agg(
        F.min_by(F.struct(F.col("row.value_num").alias("value"), F.abs(t - F.col("ts_ms")).alias("delta_ms"), t.alias("sample_ts")), F.when(t.isNotNull(), order)).alias("b"))
    return times.select(*keys, "time_id").join(chosen, list(keys)).join(best, [*keys, "time_id", "field"], "left").select(
        *keys, "time_id", "field", F.col("name").alias("metric"), "b.value", "b.delta_ms", "b.sample_ts")


def serving_at_time(
    times: DataFrame, samples: DataFrame, tolerance_ms: int = 200, decoded: DataFrame | None = None, keys: Sequence[str] = RUN
) -> DataFrame:
    """Serving cell at each asked time from KPI samples; decoded values (keys, time_id, pci, earfcn, rsrp, rsrq) fill gaps."""
    long = nearest_in_window(times, samples, SERVING_CANDIDATES, tolerance_ms, keys)
    fields = list(SERVING_CANDIDATES)
    wide = long.groupBy(*keys, "time_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    d = times.select(*keys, "time_id").join(wide, [*keys, "time_id"], "left")
    for f in ("pci", "earfcn", "eci"):
        d = d.withColumn(f, F.col(f).cast("long"))
    if decoded is not None:
        extra = decoded.select(*keys, "time_id", *[F.col(f).alias(f"_d_{f}") for f in ("pci", "earfcn", "rsrp", "rsrq")])
        d = d.join(extra, [*keys, "time_id"], "left")
        for f in ("pci", "earfcn", "rsrp", "rsrq"):
            d = d.withColumn(f, F.coalesce(f, f"_d_{f}")).drop(f"_d_{f}")
    return d.withColumn("enb_id", S.enb_id("eci")).withColumn("cell_id", S.enb_cell("eci"))


# ---- measurement configuration --------------------------------------------------------------------------------------------


def config_validity(ops: DataFrame, key: str, payload: Sequence[str], keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of each configuration entry from its add/remove operations.

    Within a message removal comes before addition; of equal operations the later one counts.
    """
    keys = list(keys)
    rank = F.when(F.col("op") == "remove", 0).otherwise(1)
    last = ops.groupBy(*keys, key, "ts_ms").agg(
        F.max_by(F.struct("op", "seq", *payload), F.struct(F.col("seq"), rank)).alias("o")).select(*keys, key, "ts_ms", "o.*")
    d = ordered.with_neighbors(last, [*keys, key], following={"valid_to": "ts_ms"}, block_ms=block_ms)
    return d.where("op <> 'remove'").select(*keys, key, F.col("ts_ms").alias("valid_from"), "valid_to", *payload)


def meas_config_state(
    times: DataFrame, ops: DataFrame, key: str, payload: Sequence[str], keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS
) -> DataFrame:
    """The entry of one known key (column ``key`` on ``times``) in force at each asked time.

    An as-of join per key; times before the first configuration of a run see the state after that first one.
    """
    keys = list(keys)
    rank = F.when(F.col("op") == "remove", 0).otherwise(1)
    last = ops.groupBy(*keys, key, "ts_ms").agg(F.max_by(F.struct("op", "seq", *payload), F.struct(F.col("seq"), rank)).alias("o")).select(
        *keys, key, "ts_ms", "o.*")
    first = ops.groupBy(*keys).agg(F.min("ts_ms").alias("_first"))
    t = ordered.attach(times, first, keys, "left", by=("ts_ms", "time_id")).withColumn("_at", F.greatest("ts_ms", F.coalesce("_first", F.col("ts_ms")))).drop("_first")
    d = timejoin.asof_backward(t, last, [*keys, key], left_ts="_at", left_seq="time_id", value="_cfg", block_ms=block_ms)
    live = F.col("_cfg.op") == "add"
    return d.select(*times.columns, *[F.when(live, F.col(f"_cfg.{p}")).alias(p) for p in payload])


def meas_id_resolve(links: DataFrame, objects: DataFrame, reports: DataFrame, message: Sequence[str] = ("run_id", "msg_id")) -> DataFrame:
    """measId links of one message joined to its measurement objects and report configurations; the last of duplicates wins."""
    m = list(message)
    uniq = lambda d, k: d.groupBy(*m, k).agg(
        F.max_by(F.struct(*[c for c in d.columns if c not in (*m, k)]), "pos").alias("r")).select(*m, k, "r.*").drop("pos")
    j = links.where("meas_id is not null").join(uniq(objects, "object_id"), [*m, "object_id"]).join(uniq(reports, "report_id"), [*m, "report_id"])
    return j.where(F.upper("event_type").isin("EVENTA3", "EVENTA5")).withColumn("resolver", F.when(F.upper("event_type") == "EVENTA3", "a3").otherwise("a5"))


def a3_config_match(reports: DataFrame, resolvers: DataFrame, keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """For each report the reconfiguration that holds its measId: the latest at or before it, else the first after it."""
    by = [*keys, "meas_id"]
    rest = [c for c in resolvers.columns if c not in (*by, "ts_ms")]
    first = resolvers.groupBy(*by, "ts_ms").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*by, "ts_ms", "r.*")
    return timejoin.asof_backward(reports, first, by, value="config", before_first="first", block_ms=block_ms).where("config is not null")


# ---- decoded messages -----------------------------------------------------------------------------------------------------

_MEAS = "struct<rsrpResult:bigint,rsrqResult:bigint,rscp:bigint,ecNo:bigint,rxLev:bigint,rxQual:bigint>"
_RESULTS = (
    "struct<measId:bigint,measResultPCell:struct<rsrpResult:bigint,rsrqResult:bigint>,"
    f"measResultNeighCells:struct<measResultListEUTRA:array<struct<physCellId:bigint,measResult:{_MEAS}>>,"
    f"measResultListUTRA:array<struct<physCellId:string,carrierFreq:bigint,measResult:{_MEAS}>>,"
    f"measResultListGERAN:array<struct<carrierFreq:bigint,physCellId:string,bsic:string,measResult:{_MEAS}>>>,"
    f"measResultListEUTRA:array<struct<physCellId:bigint,measResult:{_MEAS}>>,"
    f"measResultListUTRA:array<struct<physCellId:string,carrierFreq:bigint,measResult:{_MEAS}>>,"
    f"measResultListGERAN:array<struct<carrierFreq:bigint,physCellId:string,bsic:string,measResult:{_MEAS}>>,"
    "`measResultServFreqList-r10`:array<struct<`measResultBestNeighCell-r10`:struct<`physCellId-r10`:bigint,"
    "`rsrpResultNCell-r10`:bigint,`rsrqResultNCell-r10`:bigint>>>>"
)
NEIGHBOR_FIELDS = ("rat", "pci", "psc", "bsic", "earfcn", "uarfcn", "arfcn", "rsrp", "rsrq", "rscp", "ecno", "rxlev", "rxqual", "source_block")


def _neighbor(**given) -> Column:
    kinds = {"rat": "string", "bsic": "string", "source_block": "string", "pci": "long", "psc": "long", "earfcn": "long", "uarfcn": "long",
             "arfcn": "long", "rxqual": "long"}
    return F.struct(*[
        (given[f] if f in given else F.lit(None)).cast(kinds.get(f, "double")).alias(f) for f in NEIGHBOR_FIELDS])


def decode_reports(messages: DataFrame, json: str = "decoded") -> DataFrame:
    """Measurement reports from decoded JSON: measId, serving indices and the neighbour list of all RATs."""
    nested = "$.message.c1.measurementReport.criticalExtensions.c1.measurementReport-r8.measResults"
    text = F.coalesce(F.get_json_object(json, nested), F.get_json_object(json, "$.measResults"))
    d = messages.withColumn("_r", F.explode(F.array_compact(F.array(F.from_json(text, _RESULTS)))))
    empty = F.array().cast(d.select(F.array(_neighbor(rat=F.lit("LTE"))).alias("x")).schema["x"].dataType)
    either = lambda name: F.coalesce(F.col(f"_r.measResultNeighCells.{name}"), F.col(f"_r.{name}"))
    block = F.lit("measResultNeighCells")
    lte = F.transform(F.filter(either("measResultListEUTRA"), lambda x: x["physCellId"].isNotNull()), lambda x: _neighbor(
        rat=F.lit("LTE"), pci=x["physCellId"], rsrp=S.rsrp_idx_to_dbm(x["measResult"]["rsrpResult"]),
        rsrq=S.rsrq_idx_to_db(x["measResult"]["rsrqResult"]), source_block=block))
    best = F.transform(F.col("_r.`measResultServFreqList-r10`"), lambda x: x["measResultBestNeighCell-r10"])
    r10 = F.transform(F.filter(best, lambda x: x["physCellId-r10"].isNotNull()), lambda x: _neighbor(
        rat=F.lit("LTE"), pci=x["physCellId-r10"], rsrp=S.rsrp_idx_to_dbm(x["rsrpResultNCell-r10"]), rsrq=S.rsrq_idx_to_db(x["rsrqResultNCell-r10"]),
        source_block=F.lit("measResultServFreqList-r10")))
    utra = F.transform(
        F.filter(either("measResultListUTRA"), lambda x: S.utra_psc(x["physCellId"]).isNotNull() | x["carrierFreq"].isNotNull()),
        lambda x: _neighbor(rat=F.lit("UTRA"), psc=S.utra_psc(x["physCellId"]), uarfcn=x["carrierFreq"],
                            rscp=S.utra_rscp_idx_to_dbm(x["measResult"]["rscp"]), ecno=S.utra_ecno_idx_to_db(x["measResult"]["ecNo"]), source_block=block))
    bsic = lambda x: F.coalesce(S.normalize_bsic(x["physCellId"]), S.normalize_bsic(x["bsic"]))
    geran = F.transform(
        F.filter(either("measResultListGERAN"), lambda x: bsic(x).isNotNull() | x["carrierFreq"].isNotNull()),
        lambda x: _neighbor(rat=F.lit("GERAN"), arfcn=x["carrierFreq"], bsic=bsic(x), rxlev=S.geran_rxlev_to_dbm(x["measResult"]["rxLev"]),
                            rxqual=x["measResult"]["rxQual"], source_block=block))
    lists = F.concat(*[F.coalesce(x, empty) for x in (lte, r10, utra, geran)])
    return d.withColumn("meas_id", F.col("_r.measId")).withColumn("serving_rsrp", S.rsrp_idx_to_dbm("_r.measResultPCell.rsrpResult")).withColumn(
        "serving_rsrq", S.rsrq_idx_to_db("_r.measResultPCell.rsrqResult")).withColumn("neighbors", lists).drop("_r")


def _type_of(rat: Column, obj_rat: Column, obj_earfcn: Column, serving: Column) -> Column:
    return (
        F.when(rat != "LTE", "inter-RAT").when(obj_rat.isNull(), "unknown").when(obj_rat != "LTE", "inter-RAT")
        .when(obj_earfcn.isNull() | serving.isNull(), "unknown").when(obj_earfcn == serving, "intra-frequency").otherwise("inter-frequency")
    )


def neighbor_key(rat: Column) -> Column:
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.when(rat == "UTRA", F.concat(F.lit("UTRA:"), t("uarfcn"), F.lit(":"), t("psc"))).when(
        rat == "GERAN", F.concat(F.lit("GERAN:"), t("arfcn"), F.lit(":"), t("bsic"))).otherwise(F.concat(rat, F.lit(":"), t("earfcn"), F.lit(":"), t("pci")))


def neighbors_at_time(
    times: DataFrame, reports: DataFrame, id_ops: DataFrame, object_ops: DataFrame, hints: DataFrame, window_ms: int = 2000,
    keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS,
) -> tuple[DataFrame, DataFrame]:
    """(serving, neighbours) at each asked time: configured cells, overwritten by the nearest, then by the exact report.

    ``reports`` as from :func:`decode_reports`; ``id_ops`` (meas_id -> object_id), ``object_ops`` (object_id -> rat,
    earfcn, uarfcn, arfcn, cells array of string); ``hints`` (ts_ms, seq, pci, earfcn). All carry ``op``, ``ts_ms``, ``seq``.
    """
    keys = list(keys)
    r = reports.withColumn("time_id", F.col("seq")).select(*keys, "time_id", "ts_ms", "seq", "meas_id", "serving_rsrp", "serving_rsrq", "neighbors")
    r = meas_config_state(r, id_ops, "meas_id", ["object_id"], keys, block_ms)
    obj = ["rat", "earfcn", "uarfcn", "arfcn"]
    renamed = object_ops.select(*keys, "object_id", "ts_ms", "seq", "op", *[F.col(c).alias(f"obj_{c}") for c in obj])
    r = materialize(meas_config_state(r, renamed, "object_id", [f"obj_{c}" for c in obj], keys, block_ms).drop("time_id"), "reports")
    has = F.size("row.neighbors") > 0
    dt = F.abs(F.col("row.ts_ms") - F.col("ts_ms"))
    d = timejoin.reduce_nearest(times, r, keys, window_ms, window_ms, [*keys, "time_id"], {
        "exact_first": F.min_by("row", F.when(dt == 0, F.col("row.seq"))), "exact_with": F.min_by("row", F.when((dt == 0) & has, F.col("row.seq"))),
        "nearest": F.min_by("row", F.when(has, F.struct(dt, F.col("row.ts_ms"), F.col("row.seq")))),
    }, [None, F.size("neighbors") > 0])
    d = timejoin.asof_backward(d, hints, keys, left_seq="time_id", value="hint", block_ms=block_ms)
    source = F.coalesce("exact_first", "nearest")
    d = d.withColumn("_src", source).withColumn("_exact", F.coalesce("exact_with", "exact_first"))
    earfcn = F.coalesce(F.col("hint.earfcn"), F.when(F.col("_src.obj_rat") == "LTE", F.col("_src.obj_earfcn")))
    d = d.withColumn("serving_earfcn", earfcn)
    d = d.withColumn("_near", F.when(~F.coalesce((F.size("_exact.neighbors") > 0) & (F.col("nearest.ts_ms") == F.col("ts_ms")), F.lit(False)), F.col("nearest")))
    d = materialize(d.select(*keys, "time_id", "ts_ms", "hint", "_src", "_exact", "_near", "serving_earfcn"), "asked")
    serving = d.select(
        *keys, "time_id", F.col("hint.pci").alias("pci"), F.col("serving_earfcn").alias("earfcn"), F.col("_src.serving_rsrp").alias("rsrp"),
        F.col("_src.serving_rsrq").alias("rsrq"),
        F.when(F.col("hint").isNotNull(), "SERVING_HINT").when(F.col("_src").isNotNull(), "MR_PCell").alias("source"))

    def measured(which: str, label: str, layer: int) -> DataFrame:
        x = d.where(F.col(which).isNotNull()).select(
            *keys, "time_id", "ts_ms", "serving_earfcn", F.col(f"{which}.ts_ms").alias("_mt"), *[F.col(f"{which}.obj_{c}").alias(f"obj_{c}") for c in obj],
            F.posexplode(f"{which}.neighbors").alias("pos", "n"))
        x = x.select("*", "n.*").drop("n")
        x = x.withColumn("earfcn", F.coalesce("earfcn", F.when(F.col("rat") == "LTE", F.col("obj_earfcn"))))
        x = x.withColumn("uarfcn", F.coalesce("uarfcn", F.when((F.col("rat") == "UTRA") & (F.col("obj_rat") == "UTRA"), F.col("obj_uarfcn"))))
        x = x.withColumn("arfcn", F.coalesce("arfcn", F.when((F.col("rat") == "GERAN") & (F.col("obj_rat") == "GERAN"), F.col("obj_arfcn"))))
        return x.select(
            *keys, "time_id", *[f for f in NEIGHBOR_FIELDS if f != "source_block"],
            _type_of(F.col("rat"), F.col("obj_rat"), F.col("obj_earfcn"), F.col("serving_earfcn")).alias("type"), F.lit(label).alias("source"),
            F.abs(F.col("_mt") - F.col("ts_ms")).alias("delta_ms"), F.lit(layer).alias("layer"), "pos")

    # the state of each object a run ever has, at each asked time: a run has a few dozen objects, however often they change
    first = object_ops.groupBy(*keys).agg(F.min("ts_ms").alias("_first"), F.collect_set(F.struct("object_id")).alias("_o"))
    rank = F.when(F.col("op") == "remove", 0).otherwise(1)
    state = object_ops.where("ts_ms is not null").groupBy(*keys, "object_id", "ts_ms").agg(
        F.max_by(F.struct("op", "seq", *obj, "cells"), F.struct(F.col("seq"), rank)).alias("o")).select(*keys, "object_id", "ts_ms", "o.*")
    asked = ordered.attach(d.select(*keys, "time_id", "ts_ms", "serving_earfcn"), first, keys, by=("ts_ms", "time_id")).withColumn("_at", F.greatest("ts_ms", "_first"))
    asked = asked.select(*keys, "time_id", "serving_earfcn", "_at", F.explode("_o").alias("_o")).select("*", "_o.object_id").drop("_o")
    conf = timejoin.asof_backward(asked, state, [*keys, "object_id"], left_ts="_at", left_seq="time_id", value="_state", block_ms=block_ms).where("_state.op <> 'remove'")
    conf = conf.select(*keys, "time_id", "serving_earfcn", *[F.col(f"_state.{c}").alias(c) for c in obj], F.posexplode("_state.cells").alias("pos", "cell"))
    num = F.col("cell").try_cast("long")
    conf = conf.select(
        *keys, "time_id", "rat", F.when(F.col("rat") == "LTE", num).alias("pci"), F.when(F.col("rat") == "UTRA", num).alias("psc"),
        F.when(F.col("rat") == "GERAN", F.col("cell")).alias("bsic"), "earfcn", "uarfcn", "arfcn",
        *[F.lit(None).cast("double").alias(f) for f in ("rsrp", "rsrq", "rscp", "ecno", "rxlev")], F.lit(None).cast("long").alias("rxqual"),
        _type_of(F.col("rat"), F.col("rat"), F.col("earfcn"), F.col("serving_earfcn")).alias("type"), F.lit("CONFIG").alias("source"),
        F.lit(None).cast("long").alias("delta_ms"), F.lit(0).alias("layer"), "pos")
    rows = conf.unionByName(measured("_near", "MR_NEAREST", 1)).unionByName(measured("_exact", "MR", 2))
    rows = rows.withColumn("key", neighbor_key(F.col("rat")))
    rest = [c for c in rows.columns if c not in (*keys, "time_id", "key", "layer", "pos")]
    merged = rows.groupBy(*keys, "time_id", "key").agg(F.max_by(F.struct(*rest), F.struct("layer", "pos")).alias("r")).select(*keys, "time_id", "key", "r.*")
    return serving, merged


# ---- neighbours from KPI samples ------------------------------------------------------------------------------------------


def _per_asked_time(times: DataFrame, samples: DataFrame, tolerance_ms: int, keys: Sequence[str], order: Sequence[str], figures: Callable, schema: str, near_ms: int | None = None) -> DataFrame:
    """``figures(asked, rows, lo, hi)`` over the rows [lo, hi) of each asked time's window, the rows sorted by ``order``.

    One asked row a (keys, time_id), its rows counted in ``_times``: its samples stand as often. Where a ``time_id`` has several
    times, its windows are put together first; only these form pairs, and with ``near_ms`` their rows tell in ``_near`` whether
    they lie that near to their time.
    """
    tid = [*keys, "time_id"]
    known = " and ".join(f"`{c}` is not null" for c in [*keys, "ts_ms"])
    asked = times.where(known).groupBy(*tid).agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"), F.count("*").alias("_times"), F.collect_list("ts_ms").alias("_all"))
    asked = materialize(asked.withColumn("_all", F.when(F.col("_first") != F.col("_last"), F.col("_all"))), "asked")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        t, at = _longs(right["ts_ms"]), _longs(left["_first"])
        return figures(left, right, np.searchsorted(t, at - tolerance_ms), np.searchsorted(t, at + tolerance_ms, "right"))

    names = ", ".join(f"`{n}` {times.schema[n].dataType.simpleString()}" for n in tid)
    schema = f"{names}, {schema}"
    found = ranges.per_stretch(asked.where("_all is null").drop("_all", "_last"), samples, keys, tolerance_ms, tolerance_ms, answer, schema, anchor_ts="_first", order=order)
    apart = asked.where("_all is not null").select(*tid, F.explode("_all").alias("ts_ms"))
    if apart.isEmpty():
        return found
    near = [] if near_ms is None else [(F.abs(F.col("row.ts_ms") - F.col("ts_ms")) <= near_ms).alias("_near")]
    pairs = timejoin.interval_join(apart, samples, keys, tolerance_ms, tolerance_ms).select(*tid, *[F.col(f"row.{c}").alias(c) for c in samples.columns if c not in keys], *near)

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        left = rows.slice(0, 1).select(tid).append_column("_times", pa.array([1], pa.int64()))
        return figures(left, rows, np.array([0]), np.array([len(rows)]))

    return found.unionByName(pairs.groupBy(*tid).applyInArrow(whole, schema))


_longs = ranges.longs


def _by_field(rows: pa.Table) -> dict[str | None, np.ndarray]:
    """Places of the rows of each field."""
    coded = rows["field"].combine_chunks().dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return {f: np.flatnonzero(codes == i) for i, f in enumerate(coded.dictionary.to_pylist())}


def bucket_by_time(times: DataFrame, samples: DataFrame, tolerance_ms: int = 200, span_ms: int = 80, keys: Sequence[str] = RUN) -> DataFrame:
    """Anchored buckets of the samples around each asked time, per ``field``: a new one starts when a sample lies more than ``span_ms``
    after the current anchor.

    Windows are ranges of samples sorted once (``ranges``), so no pair of time and sample is formed. Returns (keys, time_id, field,
    bucket, anchor, last_t, center, items).
    """
    keys, span = list(keys), max(1, span_ms)
    names = [*keys, "time_id", "field", "bucket", "anchor", "last_t", "center", "items"]

    def figures(asked: pa.Table, rows: pa.Table, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        at, n, out = _longs(rows["ts_ms"]), _longs(asked["_times"]), []
        for field, places in _by_field(rows).items():
            t, first, last = at[places], np.searchsorted(places, lo), np.searchsorted(places, hi)
            for i, (of, start, end) in enumerate(ranges.anchored(t, first, last, span)):
                ids = asked.select([*keys, "time_id"]).take(pa.array(of))
                out.append(pa.table([
                    *ids.columns, pa.array([field], pa.string()).take(pa.array(np.zeros(len(of), np.int64))), pa.array(np.full(len(of), i, np.int32)), ranges.whole(t[start]),
                    ranges.whole(t[end - 1]), ranges.whole(ranges.centers(t, start, end, n[of])), ranges.whole((end - start) * n[of])], names=names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, [
            *[asked.schema.field(c).type for c in [*keys, "time_id"]], pa.string(), pa.int32(), *[pa.int64()] * 4], strict=True)})

    s = samples.select(*keys, "ts_ms", "field")
    return _per_asked_time(times.select(*keys, "time_id", "ts_ms"), s, tolerance_ms, keys, ["ts_ms"], figures, "field string, bucket int, anchor long, last_t long, center long, items long")


_PAIR_FIELDS = ("rsrp", "rsrq", "cinr", "earfcn")


def _best_pairs(asked: pa.Table, rows: pa.Table, lo: np.ndarray, hi: np.ndarray, span: int, ids: Sequence[str], at_once: int = 1 << 20) -> pa.Table:
    """The best pair of positions of each asked time and PCI (``pair_by_position``); ``at_once`` pairs are held at a time."""
    at, n, codes = (_longs(c) for c in (rows["ts_ms"], asked["_times"], rows["_pci"]))
    valid, value = rows["v"].is_valid().to_numpy(), rows["v"].to_numpy()
    wide = int(at.max() - at.min()) + 1 if len(at) else 1
    held, buckets = {}, {}
    none = np.empty(0, np.int64)
    fields = _by_field(rows)
    for field in ("pci", *_PAIR_FIELDS):
        places = fields.get(field, none)
        t = at[places]
        # values of a bucket: those known, from the first known one at its start on
        upto = np.concatenate([[0], np.cumsum(valid[places])])
        found = [*ranges.anchored(t, np.searchsorted(places, lo), np.searchsorted(places, hi), span)]
        of, start, end, i = (np.concatenate(x) for x in zip(*[(of, s, e, np.full(len(of), k)) for k, (of, s, e) in enumerate(found)], strict=True)) if found else (none,) * 4
        order = np.lexsort((i, of))
        of, start, end = of[order], start[order], end[order]
        buckets[field] = of, ranges.centers(t, start, end, n[of]), upto[start], upto[end] - upto[start]
        held[field] = (codes if field == "pci" else value)[places[valid[places]]]
    of, center, start, length = buckets["pci"]
    near = {}
    for field in _PAIR_FIELDS:
        o_of, o_center, o_start, o_length = buckets[field]
        if not len(o_of):
            near[field] = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
            continue
        zero = at.min()
        place = np.searchsorted(o_of * wide + o_center - zero, of * wide + center - zero)
        best, least = np.full(len(of), -1), np.full(len(of), span + 1)
        for x in (place - 1, place):  # the earlier one of two as near
            there = np.clip(x, 0, len(o_of) - 1)
            apart = np.where((x == there) & (o_of[there] == of), np.abs(o_center[there] - center), span + 1)
            best, least = np.where(apart < least, there, best), np.minimum(apart, least)
        near[field] = np.where(best < 0, 0, o_start[best]), np.where(best < 0, 0, o_length[best])
    names, code = np.unique(held["pci"], return_inverse=True)
    level, quality = held["rsrp"], held["cinr"]
    rank = np.unique(level, return_inverse=True)[1] + 1
    grades, grade = np.unique(np.append(quality, -np.inf), return_inverse=True)
    out = []
    # steps of whole asked times, a bounded number of pairs (or one time) each
    upto = np.concatenate([[0], np.cumsum(length)])
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    most, first = max(1, 4 * at_once // max(1, len(names))), 0
    while first < len(edges) - 1:
        last = min(max(int(np.searchsorted(upto[edges], upto[edges[first]] + at_once, "right")) - 1, first + 1), first + most, len(edges) - 1)
        b = np.arange(edges[first], edges[last])
        b, first = b[length[b] > 0], last
        if not len(b):
            continue
        bucket = np.repeat(b, length[b])
        begin = np.cumsum(length[b]) - length[b]
        pos = np.arange(len(bucket)) - np.repeat(begin, length[b])
        here, local = of[b], np.cumsum(np.diff(of[b], prepend=of[b[0]]) != 0)

        def taken(field: str, values: np.ndarray, missing: float, bucket=bucket, pos=pos, b=b) -> np.ndarray:
            if not len(values):
                return np.full(len(bucket), missing)
            s, size = (np.repeat(x[b], length[b]) for x in near[field])
            return np.where(pos < size, values[np.minimum(s + pos, len(values) - 1)], missing)

        score = taken("rsrp", rank, 0) * len(grades) + taken("cinr", grade[:-1], grade[-1])
        slot = np.repeat(local, length[b]) * len(names) + code[start[bucket] + pos]
        best = np.full((int(local[-1]) + 1) * len(names), -1)
        np.maximum.at(best, slot, score)
        hit = np.flatnonzero(score == best[slot])[::-1]
        best[:] = -1
        best[slot[hit]] = hit  # the first of equal ones is written last
        x = best[best >= 0]
        bucket, pos = bucket[x], pos[x]
        values = []
        for field in _PAIR_FIELDS:
            s, size = near[field][0][bucket], near[field][1][bucket]
            known = pos < size
            found = np.zeros(len(x))
            found[known] = held[field][(s + pos)[known]]
            values.append(ranges.real(found, known))
        out.append(pa.table([*asked.select(ids).take(pa.array(of[bucket])).columns, ranges.whole(names[code[start[bucket] + pos]]), *values,
                             ranges.whole(center[bucket]), pa.array((pos * n[of[bucket]]).astype(np.int32))], names=[*ids, "pci", *_PAIR_FIELDS, "bucket_ts", "pair_index"]))
    if out:
        return pa.concat_tables(out)
    empty = {**{c: asked.schema.field(c).type for c in ids}, "pci": pa.int64(), **dict.fromkeys(_PAIR_FIELDS, pa.float64()), "bucket_ts": pa.int64(), "pair_index": pa.int32()}
    return pa.table({c: pa.array([], t) for c, t in empty.items()})


def pair_by_position(
    times: DataFrame, samples: DataFrame, scale: DataFrame | None = None, tolerance_ms: int = 200, bucket_ms: int = 80, keys: Sequence[str] = RUN
) -> DataFrame:
    """Neighbours estimated from the flat sample streams: PCIs paired by position with the nearest bucket of each other field.

    Best row per PCI, ranked N1, N2, .. by level. ``scale`` (keys, scale_div) halves doubled EARFCNs. Windows are ranges of samples
    sorted once; a task pairs the positions of a bounded number of asked times at once and only the best of each PCI leave it.
    """
    keys = list(keys)
    tol, span = max(20, tolerance_ms), max(20, bucket_ms)
    tid = [*keys, "time_id"]
    v = F.col("value_num").cast("double")
    s = tag_fields(samples, NEIGHBOR_CANDIDATES, keys).select(
        *keys, "ts_ms", F.coalesce("idx", F.lit(0)).alias("idx"), "seq", F.coalesce(F.isnan(v), F.lit(False)).alias("_nan"), v.alias("v"), "field",
        F.when(F.col("field") == "pci", F.bround(v, 0).cast("long")).alias("_pci"))

    def figures(asked: pa.Table, rows: pa.Table, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        return _best_pairs(asked, rows, lo, hi, span, tid)

    best = _per_asked_time(times.select(*tid, "ts_ms"), s, tol, keys, ["ts_ms", "idx", "seq", "_nan", "v"], figures,
                           "pci long, rsrp double, rsrq double, cinr double, earfcn double, bucket_ts long, pair_index int")
    best = best.withColumn("earfcn", F.bround("earfcn", 0).cast("long"))
    if scale is not None:
        best = ordered.attach(best, scale.select(*keys, "scale_div"), keys, "left", by=("time_id", "pci"))
        best = best.withColumn("earfcn", F.when((F.col("scale_div") == 2) & (F.col("earfcn") % 2 == 0), F.floor(F.col("earfcn") / 2)).otherwise(F.col("earfcn"))).drop("scale_div")
    return rank_neighbors(best, tid, [F.coalesce("rsrp", F.lit(-9999.0)), F.coalesce("cinr", F.lit(-9999.0))])


def rank_neighbors(rows: DataFrame, group: Sequence[str], signals: Sequence[Column], tie: Sequence[Column | str] = ("pci",)) -> DataFrame:
    """Label N1..Nk by signal, strongest first, then by the tie columns (nulls last)."""
    order = [s.desc() for s in signals] + [F.col(t).asc_nulls_last() if isinstance(t, str) else t for t in tie]
    w = Window.partitionBy(*group).orderBy(*order)
    d = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return d.withColumn("label", F.concat(F.lit("N"), F.col("rank").cast("string")))


_FILL = ("earfcn", "uarfcn", "arfcn", "psc", "bsic", "rsrp", "rsrq", "rscp", "ecno", "rxlev", "rxqual", "cinr")


def merge_neighbor_sources(rows: DataFrame, serving: DataFrame, group: Sequence[str] = ("run_id", "time_id")) -> DataFrame:
    """Estimated and decoded neighbour rows of one asked time merged per cell, the serving cell dropped, ranked.

    ``rows`` carry ``source_kind`` (estimated, inferred, configured, decoded), ``pos`` (input order) and the value columns.
    The row of highest priority leads, its gaps are filled from the others in order of priority.
    """
    group = list(group)
    weight = F.when(F.col("source_kind") == "decoded", 4).when(F.col("source_kind") == "configured", 3).when(F.col("source_kind") == "inferred", 2).otherwise(1)
    q = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(0)
    quality = q("rsrp", 3) + q("rsrq", 2) + q("rscp", 2) + q("ecno", 1) + q("rxlev", 2) + q("rxqual", 1) + q("cinr", 1)
    for c in _FILL:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string" if c == "bsic" else "double" if c in ("rsrp", "rsrq", "rscp", "ecno", "rxlev", "cinr") else "long"))
    d = rows.withColumn("rat", F.upper(F.coalesce("rat", F.lit("LTE")))).withColumn("_w", weight).withColumn("_q", quality)
    d = d.withColumn("key", F.when(F.col("rat") == "LTE", F.concat_ws(":", F.lit("LTE"), F.coalesce(F.col("earfcn").cast("string"), F.lit("-")),
                                                                    F.coalesce(F.col("pci").cast("string"), F.lit("-")))).otherwise(neighbor_key(F.col("rat"))))
    rank = F.struct(F.col("_w"), F.col("_q"), -F.col("pos"))
    m = d.groupBy(*group, "key").agg(
        F.max_by(F.struct("rat", "pci", "source_kind", "_w"), rank).alias("lead"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in _FILL],
    ).select(*group, "key", "lead.*", *_FILL)
    m = m.join(serving.select(*group, F.col("pci").alias("serving_pci"), F.col("earfcn").alias("serving_earfcn")), group, "left")
    lte = F.col("rat") == "LTE"
    same = F.coalesce(lte & (F.col("pci") == F.col("serving_pci")) & (
        F.col("serving_earfcn").isNull() | F.col("earfcn").isNull() | (F.col("earfcn") == F.col("serving_earfcn"))), F.lit(False))
    m = m.where(~same & ~(lte & F.col("pci").isNull()))
    signal = F.coalesce("rsrp", "rscp", "rxlev", "cinr", "rsrq", "ecno", F.col("rxqual").cast("double"), F.lit(-9999.0))
    return rank_neighbors(m, group, [signal, F.col("_w")], ["pci", "key"]).drop("_w", "serving_pci", "serving_earfcn")


def _rounded(values: np.ndarray) -> np.ndarray:
    """``floor(value + 0.5)`` as Spark has it in a long: NaN is 0, what a long can't hold its largest or smallest."""
    x = np.floor(values + 0.5)
    inside = (x >= -(2.0**63)) & (x < 2.0**63)
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x > 0, most, np.where(x < 0, least, 0)))


def _tenths(values: np.ndarray) -> np.ndarray:
    """Rounded to one decimal as Spark does, halves of the written number away from zero."""
    size = np.abs(values)
    plain = np.isfinite(values) & (size < 2.0**49)
    k = np.floor(np.where(plain, size, 0) * 10)
    out = (k + (size >= (2 * k + 1) / 20)) / 10
    return np.where(plain, np.where(values < 0, -out, out) + 0.0, values)


def _grid_groups(asked: pa.Table, rows: pa.Table, lo: np.ndarray, hi: np.ndarray, near_ms: int, bucket_ms: int, ids: Sequence[str], at_once: int = 1 << 20) -> pa.Table:
    """The ranked groups of each asked point (``grid_bucket_neighbors``); ``at_once`` slots are held at a time."""
    known = asked["time_id"].is_valid().to_numpy()  # a point without id never has enough
    if "_near" in rows.column_names:  # the pairs of one point
        close = rows["_near"].to_numpy()
        pcis = _rounded(rows["v"].to_numpy()[close & pc.equal(rows["field"], "pci").to_numpy()])
        enough = known & (len(np.unique(pcis)) >= 2)
        if enough[0]:
            rows = rows.filter(rows["_near"])
            hi = np.array([len(rows)])
        at, v, fields = _longs(rows["ts_ms"]), rows["v"].to_numpy(), _by_field(rows)
    else:
        at, v, fields = _longs(rows["ts_ms"]), rows["v"].to_numpy(), _by_field(rows)
        places = fields.get("pci", np.empty(0, np.int64))
        pcis = _rounded(v[places])
        ends = np.append(np.flatnonzero(np.diff(pcis)) + 1, len(pcis))
        middle = _longs(asked["_first"])
        first_near, last_near = np.searchsorted(at, middle - near_ms), np.searchsorted(at, middle + near_ms, "right")
        first, last = np.searchsorted(places, first_near), np.searchsorted(places, last_near)
        enough = known & (first < last)
        enough[enough] = ends[np.searchsorted(ends, first[enough], "right")] < last[enough]
        lo, hi = np.where(enough, first_near, lo), np.where(enough, last_near, hi)
    none = np.empty(0, np.int64)
    places = {f: fields.get(f, none) for f in ("pci", *_PAIR_FIELDS)}
    value = {f: v[x] for f, x in places.items()}
    n = _longs(asked["_times"])
    copies, halved = (int(rows[c][0].as_py()) if len(rows) else 0 for c in ("_copies", "_halved"))
    # a piece is what a window holds of one bucket: a range of places of each field, paired from their starts on
    bucket = at // bucket_ms
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if len(at) else 0)), len(at))
    w = np.flatnonzero(lo < hi)
    first, last = np.searchsorted(edges, lo[w], "right") - 1, np.searchsorted(edges, hi[w] - 1, "right") - 1
    of = np.repeat(w, last - first + 1)
    u = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + np.repeat(first, last - first + 1)
    begin, end = np.maximum(lo[of], edges[u]), np.minimum(hi[of], edges[u + 1])
    start = {f: np.searchsorted(x, begin) for f, x in places.items()}
    size = {f: np.searchsorted(x, end) - start[f] for f, x in places.items()}
    backed = np.zeros(len(lo), bool)
    backed[of[size["pci"] > 0]] = True
    backed = backed[of]
    names, code = np.unique(_rounded(value["pci"]), return_inverse=True)
    whole = _rounded(value["earfcn"])
    half = np.where(whole % 2 == 0, whole // 2, whole)
    channels = np.unique(np.concatenate([whole, half]))
    votes = [(c, k) for c, k in ((np.searchsorted(channels, whole), copies - halved), (np.searchsorted(channels, half), halved)) if k]
    out = []

    def steps(length: np.ndarray, most: int):
        """Slots of whole windows, a bounded number of slots and windows (or one window) each: (piece, position)."""
        kept = np.flatnonzero(length)
        cuts = np.append(np.flatnonzero(np.diff(of[kept], prepend=-1)), len(kept))
        upto, first = np.concatenate([[0], np.cumsum(length[kept])])[cuts], 0
        while first < len(cuts) - 1:
            last = min(max(int(np.searchsorted(upto, upto[first] + at_once, "right")) - 1, first + 1), first + most, len(cuts) - 1)
            b, first = kept[cuts[first]:cuts[last]], last
            piece = np.repeat(b, length[b])
            yield piece, np.arange(len(piece)) - np.repeat(np.cumsum(length[b]) - length[b], length[b])

    def held(field: str, piece: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which slots have the field, and their places in it."""
        there = pos < size[field][piece]
        return there, (start[field][piece] + pos)[there]

    def ranked(window: np.ndarray, pci: pa.Array, means: Sequence[pa.Array], count: np.ndarray, pos: np.ndarray, bucket_no: np.ndarray, channel: pa.Array) -> None:
        means = [pa.array(_tenths(m.fill_null(0).to_numpy(zero_copy_only=False)), mask=m.is_null().to_numpy(zero_copy_only=False)) for m in means]
        level = means[0].fill_null(-999.0).to_numpy(zero_copy_only=False)
        nan = np.isnan(level)
        order = np.lexsort((bucket_no, pos, pci.fill_null(0).to_numpy(zero_copy_only=False), -count, -np.where(nan, 0, level), ~nan, window))
        window = window[order]
        rank = np.arange(len(window)) - np.maximum.accumulate(np.where(np.diff(window, prepend=-1) != 0, np.arange(len(window)), 0)) + 1
        columns = [pci, *means, pa.array(count), pa.array(pos.astype(np.int32)), pa.array(bucket_no), channel]
        out.append(pa.table([*asked.select(ids).take(pa.array(window)).columns, pa.array(~enough[window]), *[c.take(pa.array(order)) for c in columns], pa.array(rank)],
                            names=[*ids, "expanded", "pci", "rsrp", "rsrq", "cinr", "sample_count", "source_pos", "first_bucket", "earfcn", "rank"]))

    for piece, pos in steps(np.where(backed, size["pci"], 0), max(1, 4 * at_once // max(1, len(names) * max(1, len(channels))))):
        turn = np.cumsum(np.diff(of[piece], prepend=of[piece[0]]) != 0)
        cells = (int(turn[-1]) + 1) * len(names)
        slot = turn * len(names) + code[start["pci"][piece] + pos]
        count = np.bincount(slot, minlength=cells)
        x = np.flatnonzero(count)
        lead = np.zeros(cells, np.int64)
        lead[slot[::-1]] = np.arange(len(slot))[::-1]  # the first slot is written last
        lead = lead[x]
        means = []
        for field in _PAIR_FIELDS[:3]:
            there, where = held(field, piece, pos)
            some = np.bincount(slot[there], minlength=cells)[x]
            total = np.bincount(slot[there], value[field][where], cells)[x]
            means.append(pa.array(total / np.maximum(some, 1), mask=some == 0))
        window = of[piece[lead]]
        channel = pa.nulls(len(x), pa.int64())
        if len(channels):
            there, where = held("earfcn", piece, pos)
            found = sum(k * np.bincount(slot[there] * len(channels) + c[where], minlength=cells * len(channels)) for c, k in votes).reshape(cells, -1)[x]
            channel = pa.array(channels[found.argmax(1)], mask=(found.max(1) == 0) | ~known[window])
        ranked(window, pa.array(names[x % len(names)]), means, count[x] * n[window] * copies, pos[lead] * n[window], bucket[edges[u[piece[lead]]]], channel)
    # points whose window holds no PCI: each position of a bucket is a group
    for piece, pos in steps(np.where(backed, 0, np.max(list(size.values()), axis=0)), len(of)):
        times = n[of[piece]]
        piece, pos, turn = np.repeat(piece, times), np.repeat(pos, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        found = {}
        for field in _PAIR_FIELDS:
            there, where = held(field, piece, pos)
            kept = np.zeros(len(pos), np.float64 if field != "earfcn" else np.int64)
            if field == "earfcn":
                kept[there] = half[where] if 2 * halved > copies else whole[where] if 2 * halved < copies else np.minimum(whole, half)[where]
                there = there & known[of[piece]]
            else:
                kept[there] = value[field][where]
            found[field] = pa.array(kept, mask=~there)
        window = of[piece]
        ranked(window, pa.nulls(len(pos), pa.int64()), [found[f] for f in _PAIR_FIELDS[:3]], np.full(len(pos), copies), pos * n[window] + turn, bucket[edges[u[piece]]], found["earfcn"])
    if out:
        return pa.concat_tables(out)
    empty = {**{c: asked.schema.field(c).type for c in ids}, "expanded": pa.bool_(), "pci": pa.int64(), "rsrp": pa.float64(), "rsrq": pa.float64(), "cinr": pa.float64(),
             "sample_count": pa.int64(), "source_pos": pa.int32(), "first_bucket": pa.int64(), "earfcn": pa.int64(), "rank": pa.int64()}
    return pa.table({c: pa.array([], t) for c, t in empty.items()})


def grid_bucket_neighbors(
    points: DataFrame, samples: DataFrame, scale: DataFrame | None = None, base_tol_ms: int = 200, expanded_tol_ms: int = 500, bucket_ms: int = 80,
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """Neighbour context of each track point: samples in floor-aligned buckets, paired by position, voted and averaged per PCI.

    The window widens from ``base_tol_ms`` to ``expanded_tol_ms`` for points that see fewer than two PCIs. Windows are ranges of
    samples sorted once; a task pairs the positions of a bounded number of points at once and only the ranked groups leave it.
    """
    keys = list(keys)
    tid = [*keys, "time_id"]
    wide = max(base_tol_ms, expanded_tol_ms)
    idx = F.coalesce(F.col("idx").cast("long") if "idx" in samples.columns else F.lit(None).cast("long"), S.neighbor_metric_index(F.col("name")))
    s = samples.withColumn("field", S.neighbor_metric_field("name")).where("field is not null and value_num is not null").select(
        *keys, "ts_ms", idx.alias("idx"), "seq", "field", F.col("value_num").cast("double").alias("v"))
    copies, halved = F.lit(1), F.lit(0)
    if scale is not None:
        per_key = scale.groupBy(*keys).agg(F.count("*").alias("_c"), F.count(F.when(F.col("scale_div") == 2, 1)).alias("_h"))
        s = ordered.attach(s, per_key, keys, "left")
        copies, halved = F.coalesce("_c", copies), F.coalesce("_h", halved)
    s = s.select(*keys, "ts_ms", "idx", "seq", "field", "v", copies.cast("long").alias("_copies"), halved.cast("long").alias("_halved"))

    def figures(asked: pa.Table, rows: pa.Table, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        return _grid_groups(asked, rows, lo, hi, base_tol_ms, bucket_ms, tid)

    rows = _per_asked_time(points.select(*keys, F.col("point_id").alias("time_id"), "ts_ms"), s, wide, keys, ["ts_ms", "idx", "seq", "v"], figures,
                           "expanded boolean, pci long, rsrp double, rsrq double, cinr double, sample_count long, source_pos int, first_bucket long, earfcn long, rank long", base_tol_ms)
    group = F.when(F.col("pci").isNotNull(), F.concat(F.lit("pci:"), F.col("pci").cast("string"))).otherwise(
        F.concat(F.lit("pos:"), F.col("first_bucket").cast("string"), F.lit(":"), F.col("source_pos").cast("string")))
    return rows.select(
        *keys, F.col("time_id").alias("point_id"), group.alias("group_key"), "expanded", "pci", "rsrp", "rsrq", "cinr", "sample_count", "source_pos", "first_bucket", "earfcn",
        "rank", F.concat(F.lit("N"), F.col("rank").cast("string")).alias("label"))


# ---- A3 evaluation --------------------------------------------------------------------------------------------------------


def evaluate_a3(reports: DataFrame, resolvers: DataFrame, keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Entering and leaving condition of event A3 per reported neighbour, and the best neighbour by margin.

    Reports: ``ts_ms, seq, meas_id, serving_pci, serving_earfcn, serving_rsrp, serving_rsrq, neighbors(pci, rsrp, rsrq)``.
    Resolvers: ``ts_ms, seq, meas_id, object_id, report_id, carrier_freq, offset_freq_db, trigger_quantity, a3_offset_db,
    hysteresis_db, ttt_ms, cells array<struct<pci, cio_db>>``.
    """
    d = a3_config_match(reports, resolvers, keys, block_ms)
    c = lambda f: F.col(f"config.{f}")
    rsrq = F.upper(F.coalesce(c("trigger_quantity"), F.lit("RSRP"))) == "RSRQ"
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    cio = lambda pci: F.try_element_at(F.filter(c("cells"), lambda x: x["pci"] == pci), F.lit(1))["cio_db"]
    known = F.col("serving_earfcn").isNotNull() & c("carrier_freq").isNotNull()
    same = ~known | (F.col("serving_earfcn") == c("carrier_freq"))
    ms = F.when(rsrq, F.col("serving_rsrq")).otherwise(F.col("serving_rsrp"))
    ofn, ofs, ocs = c("offset_freq_db"), F.when(same, c("offset_freq_db")).otherwise(F.lit(0.0)), cio(F.col("serving_pci"))
    d = d.withColumn("ms", ms).withColumn("ofs", ofs).withColumn("ocs", ocs).withColumn("rhs", ms + zero(ofs) + zero(ocs) + zero(c("a3_offset_db")))

    def one(n, i):
        mn = F.when(rsrq, n["rsrq"]).otherwise(n["rsrp"])
        ocn = zero(cio(n["pci"]))
        enter = mn + zero(ofn) + ocn - zero(c("hysteresis_db"))
        leave = mn + zero(ofn) + ocn + zero(c("hysteresis_db"))
        return F.struct(
            (enter - F.col("rhs")).alias("margin"), (-i).alias("order"), n["pci"].alias("pci"), mn.alias("mn"), ocn.alias("ocn"), enter.alias("lhs_enter"),
            leave.alias("lhs_leave"), (enter > F.col("rhs")).alias("enter_satisfied"), (leave < F.col("rhs")).alias("leave_satisfied"))

    d = d.withColumn("evaluated", F.transform("neighbors", one)).withColumn("best", F.array_max("evaluated"))
    q = F.when(rsrq, "RSRQ").otherwise("RSRP")
    assumptions = F.array_compact(F.array(
        F.when(ofn.isNull(), "Neighbor offsetFreq not configured; assumed 0 dB."), F.when(F.col("ofs").isNull(), "Serving offsetFreq unavailable; assumed 0 dB."),
        F.when(F.col("ofs").isNotNull() & known & same, "Serving offsetFreq assumed same as target measObject (same-frequency)."),
        F.when(F.col("ocs").isNull(), "Serving CIO not configured in measObject; assumed 0 dB."), F.when(c("a3_offset_db").isNull(), "A3 offset unavailable in reportConfig."),
        F.when(c("hysteresis_db").isNull(), "A3 hysteresis unavailable in reportConfig."),
        F.when(F.col("ms").isNull(), F.concat(F.lit("Serving "), q, F.lit(" unavailable in MeasurementReport.")))))
    one_dec = lambda x: F.format_string("%.1f", x)
    piece = lambda label, x, unit="": F.concat(F.lit(label), x, F.lit(unit))
    mapping = F.concat_ws(
        " | ", piece("measId ", F.col("meas_id").cast("string")), piece("reportConfig ", c("report_id").cast("string")), piece("measObject ", c("object_id").cast("string")),
        piece("EARFCN ", c("carrier_freq").cast("string")), piece("Off ", one_dec(c("a3_offset_db")), " dB"), piece("Hys ", one_dec(c("hysteresis_db")), " dB"),
        piece("TTT ", c("ttt_ms").cast("string"), " ms"))
    unit = F.when(rsrq, " dB").otherwise(" dBm")
    b = F.col("best")
    told = F.concat(
        F.lit("PCI "), F.coalesce(b["pci"].cast("string"), F.lit("?")), F.lit(": LHSenter "), one_dec(b["lhs_enter"]), unit, F.lit(" vs RHS "), one_dec(F.col("rhs")), unit,
        F.lit(" => enter "), F.when(b["enter_satisfied"], "true").otherwise("false"))
    summary = F.when(b["lhs_enter"].isNotNull() & F.col("rhs").isNotNull(), told).otherwise("No LTE neighbors available for A3 evaluation.")
    return d.withColumn("trigger_quantity", q).withColumn("assumptions", assumptions).withColumn("mapping_summary", mapping).withColumn("evaluation_summary", summary)


def a3_eval_json(evaluated: DataFrame) -> DataFrame:
    """The evaluation as the JSON text later rules read from the report's properties."""
    b = F.col("best")
    body = F.to_json(F.struct(
        F.col("meas_id").alias("measId"), F.col("trigger_quantity").alias("triggerQuantity"), F.col("config.ts_ms").alias("sourceTimeMs"),
        S.format_ms_of_day("config.ts_ms").alias("sourceTimeLabel"), F.col("config.a3_offset_db").alias("a3OffsetDb"), F.col("config.hysteresis_db").alias("hysteresisDb"),
        F.col("config.ttt_ms").alias("timeToTriggerMs"), F.col("mapping_summary").alias("mappingSummary"), F.col("evaluation_summary").alias("evaluationSummary"),
        F.col("assumptions"), F.struct(
            b["pci"].alias("pci"), b["lhs_enter"].alias("lhsEnter"), F.col("rhs"), b["enter_satisfied"].alias("enterSatisfied"), b["leave_satisfied"].alias("leaveSatisfied"),
            b["margin"].alias("deltaVsThreshold")).alias("bestNeighbor")))
    return evaluated.withColumn("a3_json", body)


def resolver_summary(resolvers: DataFrame, message: Sequence[str] = ("run_id", "ts_ms", "seq")) -> DataFrame:
    """One text per reconfiguration listing its A3 resolvers in order (a message holds at most 32 of them)."""
    p = lambda label, c, unit="": F.concat(F.lit(label), F.col(c).cast("string"), F.lit(unit))
    cell = F.try_element_at("cells", F.lit(1))
    text = F.concat_ws(
        " | ", p("measId ", "meas_id"), p("reportConfig ", "report_id"), p("measObject ", "object_id"), p("EARFCN ", "carrier_freq"), p("A3 offset ", "a3_offset_db", " dB"),
        p("Hys ", "hysteresis_db", " dB"), p("TTT ", "ttt_ms", " ms"), p("offsetFreq ", "offset_freq_db", " dB"),
        F.when(cell["pci"].isNotNull(), F.concat(F.lit("PCI "), cell["pci"].cast("string"), F.lit(" CIO "), F.coalesce(cell["cio_db"], F.lit(0.0)).cast("string"), F.lit(" dB"))))
    g = resolvers.withColumn("_t", text).groupBy(*message).agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_l"))
    return g.select(*message, F.array_join(F.transform("_l", lambda x: x["_t"]), " || ").alias("a3_resolver_summary"))


def precompute_reports(reports: DataFrame, resolvers: DataFrame, keys: Sequence[str] = RUN, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Flat properties of every decoded report, with the A3 evaluation attached where a configuration holds its measId."""
    keys = list(keys)
    e = a3_eval_json(evaluate_a3(reports, resolvers, keys, block_ms)).select(
        *keys, "seq", F.col("mapping_summary"), S.format_ms_of_day("config.ts_ms").alias("a3_source_time"), "evaluation_summary", "a3_json")
    d = reports.join(e, [*keys, "seq"], "left")
    t = lambda c: F.col(c).cast("string")
    bits = F.concat_ws(" | ", F.concat(F.lit("measId "), t("meas_id")), F.concat(F.lit("serving RSRP "), t("serving_rsrp"), F.lit(" dBm")),
                       F.concat(F.lit("neighbors "), F.size("neighbors").cast("string")))
    props = {
        "measurement_report_full_decoded": F.lit("Yes"), "measurement_report_measid": t("meas_id"), "measurement_report_neighbors_json": F.to_json("neighbors"),
        "rrc_message_summary": bits, "measurement_report_a3_mapping_summary": F.col("mapping_summary"), "measurement_report_a3_source_time": F.col("a3_source_time"),
        "measurement_report_a3_eval_summary": F.col("evaluation_summary"), "measurement_report_a3_eval_json": F.col("a3_json"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in props.items()]), lambda x: x["value"].isNotNull())
    return d.select(*keys, "seq", "ts_ms", F.map_from_entries(entries).alias("properties"))


def decode_diagnostics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counters over message rows: seen, decoded and failed per type, with A3 configuration, with exact evaluation.

    Rows carry ``message_type`` (measurement_report, rrc_reconfiguration, other), ``decoded``, ``has_a3``, ``has_eval``.
    """
    mr, rc = F.col("message_type") == "measurement_report", F.col("message_type") == "rrc_reconfiguration"
    ok = F.col("decoded")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("candidates"), n(mr, "reports_seen"), n(mr & ok, "reports_decoded"), n(mr & ~ok, "reports_failed"), n(rc, "reconfig_seen"), n(rc & ok, "reconfig_decoded"),
        n(rc & ~ok, "reconfig_failed"), n(~mr & ~rc, "extra_seen"), n(~mr & ~rc & ok, "extra_decoded"), n(rc & ok & F.col("has_a3"), "reconfig_with_a3"),
        n(mr & ok & F.col("has_eval"), "exact_a3_reports"))


def join_decoded(events: DataFrame, patches: DataFrame, on: Sequence[str] = ("run_id", "ts_ms", "event_name")) -> DataFrame:
    """Patch parameter maps of events by exact time and name; patched values win."""
    merged = F.when(F.col("patch").isNull(), F.col("params_map")).otherwise(
        F.map_concat(F.map_filter("params_map", lambda k, _: ~F.array_contains(F.map_keys("patch"), k)), F.col("patch")))
    return events.join(patches, list(on), "left").withColumn("params_map", merged).drop("patch")


_CONFIG = (
    "struct<measIdToRemoveList:array<bigint>,measIdToAddModList:array<struct<measId:bigint,measObjectId:bigint,reportConfigId:bigint>>,"
    "measObjectToRemoveList:array<bigint>,measObjectToAddModList:array<struct<measObjectId:bigint,measObject:struct<"
    "measObjectEUTRA:struct<carrierFreq:bigint,cellsToAddModList:array<struct<physCellId:string>>>,"
    "measObjectUTRA:struct<carrierFreq:bigint,cellsToAddModList:array<struct<physCellId:string>>>,"
    "measObjectGERAN:struct<carrierFreq:bigint,cellsToAddModList:array<struct<physCellId:string,bsic:string>>>>>>,"
    "reportConfigToRemoveList:array<bigint>,reportConfigToAddModList:array<struct<reportConfigId:bigint,reportConfig:string>>>"
)


def config_operations(messages: DataFrame, keys: Sequence[str] = RUN, json: str = "decoded") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measId, object, report) add/remove operations of decoded reconfigurations, as :func:`config_validity` reads them."""
    path = "$.message.c1.rrcConnectionReconfiguration.criticalExtensions.c1.rrcConnectionReconfiguration-r8.measConfig"
    text = F.coalesce(F.get_json_object(json, path), F.get_json_object(json, "$.measConfig"))
    d = messages.withColumn("_c", F.explode(F.array_compact(F.array(F.from_json(text, _CONFIG)))))
    base = [*keys, "ts_ms", "seq"]

    def ops(removed: str, added: str, key: str, id_field: str, payload: dict[str, Column]) -> DataFrame:
        out = d.select(*base, F.explode(F.col(f"_c.{added}")).alias("x")).select(
            *base, F.lit("add").alias("op"), F.col(f"x.{id_field}").alias(key), *[c.alias(n) for n, c in payload.items()])
        gone = d.select(*base, F.explode(F.col(f"_c.{removed}")).alias(key)).withColumn("op", F.lit("remove"))
        return out.unionByName(gone, allowMissingColumns=True).where(F.col(key).isNotNull())

    x = lambda rat, f: F.col(f"x.measObject.measObject{rat}.{f}")
    names = lambda rat, f: F.transform(x(rat, "cellsToAddModList"), f)
    lte = F.filter(names("EUTRA", lambda c: c["physCellId"]), lambda p: p.try_cast("long").between(0, 503))
    utra = F.filter(names("UTRA", lambda c: S.utra_psc(c["physCellId"]).cast("string")), lambda p: p.try_cast("long").between(0, 511))
    geran = F.filter(names("GERAN", lambda c: F.coalesce(S.normalize_bsic(c["bsic"]), S.normalize_bsic(c["physCellId"]))), lambda p: p.isNotNull())
    cells = F.array_sort(F.array_distinct(F.coalesce(lte, utra, geran, F.array().cast("array<string>"))))
    has = lambda rat: F.col(f"x.measObject.measObject{rat}").isNotNull()
    event = F.regexp_extract("x.reportConfig", "(eventA[1-5])", 1)
    return (
        ops("measIdToRemoveList", "measIdToAddModList", "meas_id", "measId", {"object_id": F.col("x.measObjectId"), "report_id": F.col("x.reportConfigId")}),
        ops("measObjectToRemoveList", "measObjectToAddModList", "object_id", "measObjectId", {
            "rat": F.when(has("EUTRA"), "LTE").when(has("UTRA"), "UTRA").when(has("GERAN"), "GERAN").otherwise("UNKNOWN"), "earfcn": x("EUTRA", "carrierFreq"),
            "uarfcn": x("UTRA", "carrierFreq"), "arfcn": x("GERAN", "carrierFreq"), "cells": cells}),
        ops("reportConfigToRemoveList", "reportConfigToAddModList", "report_id", "reportConfigId", {"event_type": F.when(event != "", event)}),
    )
