"""Reconfiguration messages decoded to JSON: parsed once as VARIANT, read by paths, resolved in the message, flattened to properties.

A message lists at most 32 links, objects and report configurations each, so they are resolved inside the row: no shuffle.
Defined results: text that isn't JSON gives no row; fields of another type than expected are null; of entries with one id the
last counts; a message without measConfig has empty lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators import neighbors, ordered

# Places of the message's body, from the whole channel message to the body alone.
BODIES = (
    "$.message.c1.rrcConnectionReconfiguration.criticalExtensions.c1['rrcConnectionReconfiguration-r8']",
    "$.criticalExtensions.c1['rrcConnectionReconfiguration-r8']",
    "$['rrcConnectionReconfiguration-r8']",
    "$",
)
# Events of report configurations, in the order in which they are looked for.
EVENTS = {"eventA3": "EVENTA3", "eventA5": "EVENTA5", "eventA2": "EVENTA2", "eventA1": "EVENTA1", "eventA4": "EVENTA4", "eventA6": "EVENTA6"}


# The lists of a measurement configuration.
_LISTS = (
    "struct<measIdToAddModList:array<struct<measId:bigint,measObjectId:bigint,reportConfigId:bigint>>,"
    "measObjectToAddModList:array<struct<measObjectId:bigint,measObject:struct<measObjectEUTRA:struct<carrierFreq:bigint,offsetFreq:string,"
    "cellsToAddModList:array<struct<physCellId:bigint,cellIndividualOffset:string>>>,measObjectUTRA:struct<carrierFreq:bigint>,measObjectGERAN:variant>>>,"
    "reportConfigToAddModList:array<struct<reportConfigId:bigint,reportConfig:struct<reportConfigEUTRA:struct<triggerQuantity:string,triggerType:struct<event:struct<"
    "eventId:struct<eventA1:variant,eventA2:variant,eventA3:struct<`a3-Offset`:double>,eventA4:variant,eventA5:variant,eventA6:variant>,"
    "hysteresis:double,timeToTrigger:string>>>>>>>"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _object(x: Column) -> Column:
    eutra, utra, geran = (x["measObject"][f"measObject{rat}"] for rat in ("EUTRA", "UTRA", "GERAN"))
    cells = F.transform(F.filter(eutra["cellsToAddModList"], lambda c: c.isNotNull()), lambda c: F.struct(
        c["physCellId"].alias("pci"), S.enum_db(c["cellIndividualOffset"]).alias("cio_db")))
    return F.struct(
        x["measObjectId"].alias("object_id"), F.when(eutra.isNotNull(), "LTE").when(utra.isNotNull(), "UTRA").when(geran.isNotNull(), "GERAN").otherwise("UNKNOWN").alias("rat"),
        F.coalesce(eutra["carrierFreq"], utra["carrierFreq"]).alias("carrier_freq"), S.enum_db(eutra["offsetFreq"]).alias("offset_freq_db"),
        F.coalesce(cells, F.array().cast("array<struct<pci:bigint,cio_db:double>>")).alias("cells"))


def _report(x: Column) -> Column:
    body = x["reportConfig"]["reportConfigEUTRA"]
    event = body["triggerType"]["event"]
    kind = F.coalesce(*[F.when(event["eventId"][name].isNotNull(), label) for name, label in EVENTS.items()])
    return F.struct(
        x["reportConfigId"].alias("report_id"), kind.alias("event_type"), F.upper(body["triggerQuantity"]).alias("trigger_quantity"),
        event["eventId"]["eventA3"]["a3-Offset"].alias("a3_offset_db"), event["hysteresis"].alias("hysteresis_db"), S.enum_ms(event["timeToTrigger"]).alias("ttt_ms"))


def _resolved(x: Column) -> Column:
    def last(items: Column, key: str, value: Column) -> Column:
        return F.try_element_at(F.filter(items, lambda y: y[key] == value), F.lit(-1))

    joined = F.transform(x["links"], lambda y: F.struct(
        y["meas_id"].alias("meas_id"), y["object_id"].alias("object_id"), y["report_id"].alias("report_id"),
        last(x["objects"], "object_id", y["object_id"]).alias("object"), last(x["reports"], "report_id", y["report_id"]).alias("report")))
    return F.filter(joined, lambda y: y["object"].isNotNull() & y["report"].isNotNull())


def read_reconfigurations(messages: DataFrame, json: str = "decoded") -> DataFrame:
    """Adds ``parsed, body, config`` (VARIANT) and ``read``: ``links``, ``objects``, ``reports`` and ``resolved``, the links whose object and report the message holds.

    The text is parsed once, and all lists leave the configuration in one cast.
    """
    once = lambda value: F.explode_outer(F.array(value))  # noqa: E731  (a value behind a generator isn't computed again where it is named)
    d = messages.withColumn("parsed", once(F.try_parse_json(F.col(json)))).where("parsed is not null")
    d = d.withColumn("body", F.coalesce(*[F.try_variant_get(F.col("parsed"), path, "variant") for path in BODIES]))
    d = d.withColumn("config", F.try_variant_get(F.col("body"), "$.measConfig", "variant"))
    some = lambda items, empty: F.coalesce(items, F.expr(f"from_json('[]', '{empty}')"))
    links = lambda c: F.filter(F.transform(c["measIdToAddModList"], lambda x: F.struct(
        x["measId"].alias("meas_id"), x["measObjectId"].alias("object_id"), x["reportConfigId"].alias("report_id"))),
        lambda x: x["meas_id"].isNotNull() & x["object_id"].isNotNull() & x["report_id"].isNotNull())
    objects = lambda c: F.transform(F.filter(c["measObjectToAddModList"], lambda x: x["measObjectId"].isNotNull()), _object)
    reports = lambda c: F.transform(F.filter(
        c["reportConfigToAddModList"], lambda x: x["reportConfigId"].isNotNull() & x["reportConfig"]["reportConfigEUTRA"].isNotNull()), _report)
    lists = F.try_variant_get(F.col("config"), "$", _LISTS)
    read = _let(lists, lambda c: F.struct(
        some(links(c), "array<struct<meas_id:bigint,object_id:bigint,report_id:bigint>>").alias("links"),
        some(objects(c), "array<struct<object_id:bigint,rat:string,carrier_freq:bigint,offset_freq_db:double,cells:array<struct<pci:bigint,cio_db:double>>>>").alias("objects"),
        some(reports(c), "array<struct<report_id:bigint,event_type:string,trigger_quantity:string,a3_offset_db:double,hysteresis_db:double,ttt_ms:bigint>>").alias("reports")))
    read = _let(read, lambda r: F.struct(r["links"].alias("links"), r["objects"].alias("objects"), r["reports"].alias("reports"), _resolved(r).alias("resolved")))
    return d.withColumn("read", once(read))


def _a3() -> Column:
    return F.filter("read.resolved", lambda x: x["report"]["event_type"] == "EVENTA3")


def resolver_rows(read: DataFrame, keys: Sequence[str] = neighbors.RUN) -> DataFrame:
    """One row for each A3 link of a message, as :func:`neighbors.evaluate_a3` takes them; of links with one measId the first."""
    d = read.select(*keys, "ts_ms", "seq", F.posexplode(_a3()).alias("pos", "x"))
    of = lambda part, name: F.col(f"x.{part}.{name}").alias(name)
    d = d.select(*keys, "ts_ms", "seq", "pos", "x.meas_id", "x.object_id", "x.report_id", of("object", "carrier_freq"), of("object", "offset_freq_db"), of("object", "cells"),
                 F.coalesce("x.report.trigger_quantity", F.lit("RSRP")).alias("trigger_quantity"), of("report", "a3_offset_db"), of("report", "hysteresis_db"), of("report", "ttt_ms"))
    one = [*keys, "ts_ms", "seq", "meas_id"]
    rest = [c for c in d.columns if c not in one and c != "pos"]
    return d.groupBy(*one).agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(*one, "r.*")


def _told(x: Column) -> Column:
    """One resolver as text."""
    def bit(label: str, value: Column, unit: str = "") -> Column:
        return F.concat(F.lit(label), value.cast("string"), F.lit(unit))

    cell = F.try_element_at(x["object"]["cells"], F.lit(1))
    return F.concat_ws(
        " | ", bit("measId ", x["meas_id"]), bit("reportConfig ", x["report_id"]), bit("measObject ", x["object_id"]), bit("EARFCN ", x["object"]["carrier_freq"]),
        bit("A3 offset ", x["report"]["a3_offset_db"], " dB"), bit("Hys ", x["report"]["hysteresis_db"], " dB"), bit("TTT ", x["report"]["ttt_ms"], " ms"),
        bit("offsetFreq ", x["object"]["offset_freq_db"], " dB"),
        F.concat(bit("PCI ", cell["pci"]), bit(" CIO ", F.coalesce(cell["cio_db"], F.lit(0.0)), " dB")))


def reconfiguration_properties(read: DataFrame, keys: Sequence[str] = neighbors.RUN) -> DataFrame:
    """Flat properties of every reconfiguration: its parts as JSON, the first A3 link's values, all A3 links as text, a summary."""
    d = read.withColumn("_a3", _a3()).withColumn("_f", F.try_element_at("_a3", F.lit(1)))
    has = lambda name: F.try_variant_get(F.col("body"), f"$.{name}", "variant").isNotNull()
    some = F.size("_a3") > 0
    configured = F.col("config").isNotNull()
    bits = F.concat_ws(" | ", F.when(configured, "measConfig"), F.when(has("mobilityControlInfo"), "mobilityControlInfo"),
                       F.when(some, F.concat(F.lit("A3 resolvers "), F.size("_a3").cast("string"))))
    text = lambda name: F.col(f"_f.{name}").cast("string")
    props = {
        "rrc_message_id": F.lit("rrc_reconfiguration"), "rrc_recfg_full_decoded": F.lit("Yes"), "rrc_recfg_full_json": F.to_json("parsed"),
        "rrc_recfg_meas_config_present": F.when(configured, "Yes").otherwise("No"), "rrc_recfg_meas_config_json": F.coalesce(F.to_json("config"), F.lit("{}")),
        "rrc_recfg_meas_resolver_json": F.to_json(F.struct("read.links", "read.objects", "read.reports", F.col("_a3").alias("a3"))),
        "rrc_recfg_a3_offset_db": text("report.a3_offset_db"), "rrc_recfg_hysteresis_db": text("report.hysteresis_db"), "rrc_recfg_ttt_ms": text("report.ttt_ms"),
        "rrc_recfg_meas_id": text("meas_id"), "rrc_recfg_meas_object_id": text("object_id"), "rrc_recfg_report_config_id": text("report_id"),
        "rrc_recfg_event_type": text("report.event_type"), "rrc_recfg_offset_freq_db": text("object.offset_freq_db"),
        "rrc_recfg_a3_resolver_summary": F.when(some, F.array_join(F.transform("_a3", _told), " || ")), "rrc_message_summary": F.when(bits != "", bits),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in props.items()]), lambda x: x["value"].isNotNull())
    return d.select(*keys, "seq", "ts_ms", F.map_from_entries(entries).alias("properties"))


def precompute_messages(
    reconfigurations: DataFrame, reports: DataFrame, keys: Sequence[str] = neighbors.RUN, json: str = "decoded", block_ms: int = ordered.HOUR_MS,
) -> DataFrame:
    """Properties of reconfigurations and reports, both given as JSON; reports carry ``serving_pci, serving_earfcn`` too.

    Each report is evaluated by the reconfiguration that holds its measId as an A3 link; reports without one keep the rest.
    """
    read = read_reconfigurations(reconfigurations, json)
    lte = F.transform(F.filter("neighbors", lambda n: n["rat"] == "LTE"), lambda n: F.struct(n["pci"].alias("pci"), n["rsrp"].alias("rsrp"), n["rsrq"].alias("rsrq")))
    decoded = neighbors.decode_reports(reports).withColumn("neighbors", lte)
    told = neighbors.precompute_reports(decoded, resolver_rows(read, keys), keys, block_ms)
    columns = [*keys, "seq", "ts_ms", "properties"]
    return reconfiguration_properties(read, keys).select(*columns).unionByName(told.select(*columns))
