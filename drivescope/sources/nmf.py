"""Text measurement logs: records, absolute time, radio rows, cell measurements, events, signalling, identities.

Line records: ``log_id, line_no, header, parts array<string>, raw``. Everything after the read is column expressions over
``parts``; order within a log is ``line_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivescope.functions import scalars as S
from drivescope.operators import ordered, timejoin
from drivescope.operators.staging import attach_sized, materialize

LINE_BLOCK = 1_000_000
KEYS = ("log_id",)


# ---- lines --------------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """Lines of text files with their file and number: ``log_id, line_no, raw``. Lines end at CR, LF or both, or at ``line_sep``.

    A file may be split over many tasks; a line's number is the lines of the splits before it plus its place in its own. Only
    a row for each split is gathered and sent back, the text stays where it is read.
    """
    d = (spark.read.option("lineSep", line_sep) if line_sep else spark.read).text(paths).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("raw"))
    before = Window.partitionBy("log_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = d.groupBy("log_id", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    splits = splits.select("log_id", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    d = attach_sized(d, splits, ["log_id", "_start"], by=["_id"])  # a row for each split of the scan
    return d.select("log_id", (F.col("_id") + F.col("_shift")).alias("line_no"), "raw")


def read_containers(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Lines of binary containers, ``log_id, line_no, raw``: bytes as Latin-1, lines end at LF or CR LF, a lone CR or NUL is payload.

    Files up to ``most_bytes`` are read whole, a task holds one of them. Larger ones are read as splits of text, so none has
    to fit into memory; there bytes beyond ASCII, which no mark holds, become replacement characters. Empty lines are left
    out but for the first; an empty file gives one empty line.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("*", F.col("_metadata.file_path").alias("log_id"))
    pieces = F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")).alias("_at", "raw")
    d = files.where(F.col("length") <= most_bytes).select("log_id", pieces).select("log_id", (F.col("_at") + 1).cast("long").alias("line_no"), "raw")
    large = [r.log_id for r in files.where(F.col("length") > most_bytes).select("log_id").collect()]  # names of files, not what they hold
    if large:
        d = d.unionByName(read_lines(spark, large, "\n").withColumn("raw", F.regexp_replace("raw", r"\r$", "")))
    return d.where("raw <> '' or line_no = 1")


# A comma and the field behind it: plain characters and quoted stretches; a quote that isn't closed runs to the end.
_FIELD = r',((?:[^,"]++|"(?:[^"]++|"")*+"?)*+)'


# A quoted stretch, its closing quote missing at the end of a line at most; two quotes in it stand for one.
_QUOTED = r'"((?:[^"]|"")*+)"?'


def split_csv(line: Column) -> Column:
    """Comma split that respects quotes; quotes are removed, a doubled quote inside quotes becomes one, ``""`` is empty."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    unquoted = F.transform(fields, lambda x: F.replace(F.regexp_replace(x, _QUOTED, "$1"), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, ","))


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of all non-blank lines. The fields stand behind a generator, so a filter on them doesn't split the line again."""
    raw = F.trim("raw")
    d = lines.withColumn("raw", raw).where("raw <> ''").withColumn("parts", F.explode(F.array(split_csv(F.col("raw")))))
    return d.withColumn("header", F.upper(F.trim(F.col("parts")[0])))


def read_nmf(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_records(read_lines(spark, paths))


def part(i: int) -> Column:
    """Field ``i`` (from 0), null beyond the end of the line."""
    return F.try_element_at("parts", F.lit(i + 1))


def _leading(c: Column, pattern: str) -> Column:
    """What the pattern finds, or null: a cast of an empty text would cost an exception."""
    return F.try_element_at(F.regexp_extract_all(F.trim(c), F.lit(pattern), F.lit(1)), F.lit(1))


def num(c: Column) -> Column:
    """Leading number of a field, as a lenient reader takes it."""
    return _leading(c, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)").try_cast("double")


def integer(c: Column) -> Column:
    return _leading(c, r"^([+-]?\d+)").try_cast("long")


_TOD2 = r"^(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$"


def absolute_time(records: DataFrame, keys: Sequence[str] = KEYS, rollover_ms: int = 6 * 3_600_000) -> DataFrame:
    """Epoch time of every timed record after a dated ``#START``; a day is added when the clock falls by over six hours.

    A ``#START`` without a date changes nothing; each dated one starts a new count of days.
    """
    keys = list(keys)
    dates = F.filter("parts", lambda x: F.trim(x).rlike(r"^\d{2}\.\d{2}\.\d{4}$"))
    base = F.unix_millis(F.try_to_timestamp(F.trim(F.try_element_at(dates, F.lit(1))), F.lit("dd.MM.yyyy")))
    is_start = F.col("header") == "#START"
    tod = F.when(~is_start & F.trim(part(1)).rlike(_TOD2), S.time_of_day_ms(part(1)))
    start = F.when(is_start & base.isNotNull(), F.struct(F.col("line_no").alias("no"), base.alias("base")))
    block = ordered.block_of("line_no", LINE_BLOCK)
    # Narrow rows, once: what a block of lines does to the state (segment, base, day, time of day), as a summary that composes.
    # A filter on what is read off the fields would be pushed down with a split of the text for each field; it stops at a row id.
    once = F.monotonically_increasing_id().alias("_once")
    n = records.select(*keys, block.alias("_block"), "line_no", start.alias("_start"), tod.alias("tod_ms"), once).where("_once >= 0 and (_start is not null or tod_ms is not null)").drop("_once")
    inside = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_seg", F.last("_start", ignorenulls=True).over(inside)).withColumn(
        "_prev", F.last(F.when(F.col("tod_ms").isNotNull(), F.struct("line_no", "tod_ms")), ignorenulls=True).over(ahead))
    same = F.coalesce(F.col("_prev.line_no") > F.col("_seg.no"), F.col("_seg").isNull() & F.col("_prev").isNotNull())
    n = n.withColumn("_fell", F.coalesce((same & (F.col("tod_ms") < F.col("_prev.tod_ms") - rollover_ms)).cast("long"), F.lit(0)))
    n = n.withColumn("_falls", F.sum("_fell").over(inside)).withColumn("_at_start", F.last(F.when(F.col("_start").isNotNull(), F.col("_falls")), ignorenulls=True).over(inside))
    n = n.withColumn("day", F.col("_falls") - F.coalesce("_at_start", F.lit(0)))
    # The part of a block ahead of its first start belongs to the segment that is open when the block begins.
    head, timed = F.col("_seg").isNull(), F.col("tod_ms").isNotNull()
    after = F.coalesce(F.col("line_no") > F.col("_seg.no"), F.lit(True))
    blocks = n.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.when((F.col("_fell") > 0) | F.col("_start").isNotNull(), F.struct("line_no", "_seg", "day")))).alias("_changes"),  # changes are few
        F.min_by("tod_ms", F.when(head & timed, F.col("line_no"))).alias("_first"), F.sum(F.when(head, F.col("_fell")).otherwise(0)).alias("_head_falls"),
        F.max_by(F.struct("_seg", "day", F.when(timed & after, F.col("tod_ms")).alias("tod_ms")), "line_no").alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_end.tod_ms", ignorenulls=False).over(over))
    crossed = F.coalesce((F.col("_first") < F.col("_before") - rollover_ms).cast("long"), F.lit(0))
    blocks = blocks.withColumn("_crossed", crossed).withColumn("_sum", F.coalesce(F.sum(F.col("_crossed") + F.col("_head_falls")).over(over), F.lit(0)))
    mark = F.when(F.col("_end._seg").isNotNull(), F.struct(F.col("_end._seg").alias("seg"), (F.col("_end.day") - F.col("_sum") - F.col("_crossed") - F.col("_head_falls")).alias("shift")))
    blocks = blocks.withColumn("_open", F.last(mark, ignorenulls=True).over(over))
    carried = F.col("_sum") + F.col("_open.shift") + F.col("_crossed")
    step = lambda no, seg, day: F.struct(no.alias("line_no"), seg["no"].alias("segment"), seg["base"].alias("base"), day.alias("day"))
    first = F.when(F.col("_open").isNotNull(), step(F.lit(0).cast("long"), F.col("_open.seg"), carried))
    own = F.transform("_changes", lambda x: F.when(x["_seg"].isNotNull(), step(x["line_no"], x["_seg"], x["day"])).when(
        F.col("_open").isNotNull(), step(x["line_no"], F.col("_open.seg"), carried + x["day"])))
    blocks = blocks.select(*keys, "_block", F.array_compact(F.concat(F.array(first), own)).alias("_steps"))
    d = records.select("*", tod.alias("tod_ms"), once).where("_once >= 0 and tod_ms is not null").drop("_once").withColumn("_block", block)
    d = d.join(blocks, [*keys, "_block"]).withColumn("_at", F.try_element_at(F.filter("_steps", lambda x: x["line_no"] <= F.col("line_no")), F.lit(-1)))
    d = d.where("_at is not null").withColumn("segment", F.col("_at.segment")).withColumn("ts_ms", F.col("_at.base") + F.col("_at.day") * 86_400_000 + F.col("tod_ms"))
    return d.select(*records.columns, "tod_ms", "segment", "ts_ms")


def container_metadata(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per container: signature, tags, counts of metadata and recovered record lines, decode mode."""
    keys = list(keys)
    clean = F.trim(F.regexp_replace("raw", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    d = lines.select(*keys, "line_no", F.col("raw"), clean.alias("_c")).where("_c <> '' or line_no = 1")
    mark = F.regexp_extract("_c", r"(#.*)$", 1)
    tag = F.regexp_extract(mark, r"^#\s*([A-Z][A-Z0-9_]{1,24})\s*(?:,|$)", 1)
    d = d.withColumn("_tag", F.when(tag != "", tag)).withColumn("_mark", F.upper(mark))
    d = d.withColumn("_switch", F.when(F.col("_mark").startswith("#START"), True).when(F.col("_mark").startswith("#STOP"), False))
    d = ordered.with_last_known(d, keys, {"_in": "_switch"}, ts="line_no", seq="line_no", block_ms=LINE_BLOCK)
    likely = ~F.col("_c").startswith("#") & F.trim(F.split("_c", ",")[0]).rlike(r"^[A-Z][A-Z0-9@]{1,15}$") & (F.size(F.split("_c", ",")) >= 3)
    g = d.groupBy(*keys).agg(
        F.max(F.when(F.col("line_no") == 1, F.substring("raw", 1, 4))).alias("signature"), F.count("_tag").alias("metadata_count"),
        F.count_if(likely & F.coalesce("_in", F.lit(False))).alias("record_count"), F.coalesce(F.max(F.col("_mark").startswith("#START")), F.lit(False)).alias("has_start"),
        F.coalesce(F.max(F.col("_mark").startswith("#STOP")), F.lit(False)).alias("has_stop"),
        F.array_sort(F.collect_set("_tag")).alias("tags"))
    secure = F.col("signature") == "NMFS"
    mode = F.when(~secure, "text_fallback").when(F.col("record_count") > 0, "metadata_plus_plaintext").otherwise("metadata_only_secure_payload")
    zero = lambda c: F.when(secure, F.col(c)).otherwise(0).cast("long").alias(c)
    flag = lambda c: (secure & F.col(c)).alias(c)
    return g.select(*keys, "signature", mode.alias("decode_mode"), zero("metadata_count"), zero("record_count"), flag("has_start"), flag("has_stop"), "tags")


# ---- radio rows -----------------------------------------------------------------------------------------------------------


def mimo_samples(records: DataFrame) -> DataFrame:
    """One row per MIMOMEAS sample; UMTS blocks of 8 (or 9) fields, LTE blocks of 9, from field 7 on."""
    d = records.where("header = 'MIMOMEAS'").withColumn("tech", integer(part(3))).withColumn("device_id", F.trim(part(3)))
    n = F.size("parts") - 7
    width = F.when(F.col("tech") == 7, F.when(n % 9 == 0, 9)).when(n % 8 == 0, 8).when(n % 9 == 0, 9)
    d = d.withColumn("_w", width).withColumn("_n", n).where("_w is not null and _n > 0")
    d = d.withColumn("branch_no", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / F.col("_w")).cast("int") - 1)))
    at = lambda j: num(F.try_element_at("parts", (F.lit(8 + j) + F.col("branch_no") * F.col("_w")).cast("int")))
    lte = F.col("tech") == 7
    pick = lambda u, l: F.when(lte, at(l)).otherwise(at(u))
    out = d.select(
        *[c for c in records.columns if c not in ("parts", "raw", "header")], "device_id", "tech", "branch_no", pick(2, 2).alias("psc"), at(3).alias("branch"),
        pick(5, 7).alias("rscp"), at(6).alias("ecno"), F.when(~lte, at(7)).alias("rssi"), pick(0, 8).alias("cell_id"), at(1).alias("uarfcn"), F.when(lte, at(0)).alias("band_code"))
    return out.where("psc is not null and rscp is not null and ecno is not null")


def tx_power(records: DataFrame) -> DataFrame:
    d = records.where("header = 'TXPC'").withColumn("device_id", F.trim(part(3))).withColumn("tx", num(part(4))).withColumn("tpc", integer(part(5)))
    return d.where("tx is not null").drop("parts", "raw", "header")


def rlc_bler(records: DataFrame) -> DataFrame:
    """Per RLCBLER row the maximum and mean of the values written with a decimal point, 0 to 100, from field 4 on."""
    values = F.filter(
        F.transform(F.filter(F.slice("parts", 5, F.greatest(F.size("parts") - 4, F.lit(0))), lambda x: F.contains(x, F.lit("."))), num), lambda v: v.between(0, 100))
    d = records.where("header = 'RLCBLER'").withColumn("device_id", F.trim(part(3))).withColumn("_v", values).where(F.size("_v") > 0)
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("bler_max", F.array_max("_v")).withColumn("bler_mean", total / F.size("_v")).drop("_v", "parts", "raw", "header")


CALL_HEADERS = ["CAA", "CAC", "CAD", "CAF", "CARE"]
TIMELINE_HEADERS = ["RRCSM", "L3SM", "L3MM", "RRC", "RRA", "RRD", "RRF", "RABA", "RABD", "RBI", "SHO", "CELLMEAS"]


def call_rows(records: DataFrame) -> DataFrame:
    """Call markers with their fields; rows without call or device number are dropped."""
    h = F.col("header")
    d = records.where(h.isin(*CALL_HEADERS)).withColumn("call_id", F.trim(part(3))).withColumn("device_id", F.trim(part(4))).where("call_id <> '' and device_id <> ''")
    whole = lambda cond, i: F.when(cond, num(part(i)).cast("long"))
    return d.select(
        *[c for c in records.columns if c not in ("parts", "raw")], "device_id", "call_id", F.when(h == "CAA", F.trim(part(7))).alias("dialed"), whole(h == "CAC", 6).alias("state"),
        whole(h == "CAD", 6).alias("status"), whole(h == "CAD", 7).alias("cause"), whole(h == "CAF", 6).alias("reason"), F.array_join("parts", ",").alias("raw"))


def device_events(records: DataFrame) -> DataFrame:
    """Rows that make up a device's timeline: calls, signalling and radio records."""
    h = F.col("header")
    call = h.isin(*CALL_HEADERS)
    d = records.where(call | h.isin("MIMOMEAS", "TXPC", "RLCBLER", *TIMELINE_HEADERS))
    d = d.withColumn("device_id", F.trim(F.when(call, part(4)).otherwise(part(3)))).withColumn("call_id", F.when(call, F.trim(part(3)))).where("device_id <> ''")
    return d.withColumn("raw", F.array_join("parts", ",")).drop("parts")


# ---- cell measurements ----------------------------------------------------------------------------------------------------


def _near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < 1, F.lit(False))


def _networks() -> Column:
    """Positions (from 0) of the fields that look like a network, five digits."""
    return F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.trim(F.try_element_at("parts", i + 1)).rlike("^[0-9]{5}$"))


def _tuple_at(k: Column, top_sc: int) -> Column:
    """Neighbour tuple at position ``k`` (from 0) or null: set type, network, frequency, code and three levels."""
    at = lambda j: F.try_element_at("parts", (k + j + 1).cast("int"))
    level = lambda v: v.between(-120, -50)
    quality = lambda v: v.between(-30, 0)

    def found(x):
        set_type, freq, sc, x1, x2, x3 = (x[n] for n in ("set_type", "freq", "sc", "x1", "x2", "x3"))
        first, second = level(x1) & quality(x3), quality(x1) & level(x3)
        ok = set_type.between(0, 3) & (freq > 2000) & sc.between(0, top_sc)
        block = lambda sub, rscp, ecno: F.struct(
            F.when(set_type <= 1, 0).otherwise(set_type).cast("long").alias("prio"), k.cast("long").alias("k"), set_type.alias("set_type"), freq.alias("freq"), sc.alias("sc"),
            rscp.alias("rscp"), ecno.alias("ecno"), F.when(x2.between(-130, -50), x2).alias("rssi"), F.lit(sub).alias("subtype"))
        return F.when(ok & first, block("A", x1, x3)).when(ok & second, block("B", x3, x1))

    return S.once(F.struct(
        integer(at(0)).alias("set_type"), num(at(2)).alias("freq"), integer(at(3)).alias("sc"), num(at(4)).alias("x1"), num(at(5)).alias("x2"), num(at(6)).alias("x3")), found)


def _tuples(places: Column, top_sc: int) -> Column:
    return F.filter(F.transform(places, lambda k: _tuple_at(k, top_sc)), lambda b: b.isNotNull())


def _network_tuples(networks: Column, top_sc: int) -> Column:
    """The tuples whose network is among these fields."""
    return _tuples(F.transform(F.filter(networks, lambda i: (i >= 1) & (i <= F.size("parts") - 6)), lambda i: i - 1), top_sc)


def _dedupe(blocks: Column) -> Column:
    """One block per rounded frequency and code: the better set type, then the earlier position."""
    same = lambda a, b: (F.round(a["freq"]) == F.round(b["freq"])) & (a["sc"] == b["sc"])
    ahead = lambda a, b: (a["prio"] < b["prio"]) | ((a["prio"] == b["prio"]) & (a["k"] < b["k"]))
    return F.filter(blocks, lambda b: ~F.exists(blocks, lambda c: same(c, b) & ahead(c, b)))


def umts_cellmeas(records: DataFrame) -> DataFrame:
    """Serving cell and neighbours of UMTS cell-measurement rows; neighbours as an array, serving cell marked."""
    d = records.where((F.col("header") == "CELLMEAS") & (integer(part(3)) == 5))
    n = F.size("parts")
    steps = F.when(n >= 22, F.sequence(F.lit(15), n - 7, F.lit(8))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_net", F.explode(F.array(_networks()))).withColumn("_b", F.explode(F.array(_network_tuples(F.col("_net"), 512))))
    d = d.withColumn("_b", F.when(F.size("_b") > 0, F.col("_b")).otherwise(_tuples(steps, 512)))
    d = d.withColumn("_b", _dedupe(F.col("_b")))
    freq = num(part(7))
    d = d.withColumn("serving_freq", F.when(freq > 0, freq)).withColumn("_field", num(part(8)))
    d = d.withColumn("as_size", F.coalesce(F.when(integer(part(5)) != 0, integer(part(5))), F.lit(1))).withColumn("ms_size", F.coalesce(integer(part(6)), F.lit(0)))
    sf = F.col("serving_freq")

    def serving_at(k):
        at = lambda j: F.try_element_at("parts", (k + j + 1).cast("int"))
        hit = lambda x: _near(x["freq"], sf) & x["sc"].between(0, 512) & (x["ecno"] >= -35)
        read = F.struct(num(at(1)).alias("freq"), integer(at(2)).alias("sc"), num(at(3)).alias("ecno"))
        return S.once(read, lambda x: F.when(hit(x), F.struct(x["sc"].alias("sc"), x["ecno"].alias("ecno"))))

    places = F.filter("_net", lambda i: i <= n - 4)
    d = d.withColumn("_m", F.explode_outer(F.array(F.try_element_at(F.filter(F.transform(places, serving_at), lambda x: x.isNotNull()), F.lit(1)))))
    pick = lambda cond: F.try_element_at(F.filter("_b", cond), F.lit(1))
    known = F.coalesce(pick(lambda b: _near(b["freq"], sf) & (b["sc"] == F.col("_m.sc"))), pick(lambda b: b["sc"] == F.col("_m.sc")))
    on = F.filter("_b", lambda b: _near(b["freq"], sf))
    pool = F.when(F.size(on) > 0, on).otherwise(F.col("_b"))
    top = F.array_max(F.transform(pool, lambda b: F.struct(b["rscp"].alias("rscp"), (-b["k"]).alias("o"), b.alias("b"))))["b"]
    d = d.withColumn("_s", F.coalesce(known, top))
    d = d.withColumn("serving_sc", F.coalesce("_m.sc", "_s.sc")).withColumn("serving_ecno", F.coalesce("_m.ecno", "_s.ecno")).withColumn(
        "serving_rscp", F.coalesce("_s.rscp", "_field"))
    wide = F.col("serving_rscp") - F.col("serving_ecno")
    d = d.withColumn("rssi", F.when(F.abs(F.col("_field") - wide) <= 4, F.col("_field")).otherwise(wide))
    nb = F.transform("_b", lambda b: b.withField("is_serving", _near(b["freq"], sf) & F.coalesce(b["sc"] == F.col("serving_sc"), F.lit(False))))
    d = d.withColumn("neighbors", nb).withColumn("band", S.band_from_uarfcn("serving_freq")).drop("_b", "_net", "_m", "_s", "_field", "parts", "raw", "header")
    # a filter on the parsed arrays would be pushed into the scan of the fields and evaluate it again and again
    return materialize(d, "cells")


def label_neighbors(cells: DataFrame, slots_from_set_types: bool = False, per_set: int | None = None) -> DataFrame:
    """Active (A2..), monitored (M1..) and detected (D1..) labels for the neighbours of each row.

    ``per_set`` keeps that many of each (16 is customary).

    The reported active-set size says how many active neighbours there are; where it names only the serving cell, or with
    ``slots_from_set_types``, every candidate by set type counts.
    """
    nb = F.filter("neighbors", lambda x: ~x["is_serving"])
    single, context = F.col("as_size") <= 1, F.col("ms_size") > 0
    candidate = lambda x: (x["set_type"] == 0) | (~single & (x["set_type"] == 1))
    by_level = lambda a, b: F.when(a["rscp"] > b["rscp"], -1).when(a["rscp"] < b["rscp"], 1).when(a["k"] < b["k"], -1).otherwise(1)
    by_place = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    d = cells.withColumn("_n", nb).withColumn("_a", F.array_sort(F.filter("_n", candidate), by_level))
    inferred = F.size("_a")
    told = F.greatest(F.col("as_size") - 1, inferred) if slots_from_set_types else F.when(~single, F.col("as_size") - 1).otherwise(inferred)
    slots = F.greatest(F.lit(0), told).cast("int")
    d = d.withColumn("_slots", slots)
    over = F.slice("_a", F.col("_slots") + 1, F.greatest(F.size("_a") - F.col("_slots"), F.lit(0)))
    inter = lambda x: F.abs(x["freq"] - F.col("serving_freq")) >= 1
    to_m = lambda x: F.coalesce(inter(x), F.lit(False)) | context
    monitored = F.concat(F.filter("_n", lambda x: single & (x["set_type"] == 1)), F.filter(over, to_m))
    detected = F.concat(F.filter("_n", lambda x: x["set_type"] >= 2), F.filter(over, lambda x: ~to_m(x)))
    name = lambda arr, letter, first: F.transform(
        arr if per_set is None else F.slice(arr, 1, per_set), lambda x, i: x.withField("label", F.concat(F.lit(letter), (i + first).cast("string"))))
    labelled = F.concat(
        name(F.slice("_a", F.lit(1), F.col("_slots")), "A", 2), name(F.array_sort(monitored, by_place), "M", 1), name(F.array_sort(detected, by_place), "D", 1))
    return d.withColumn("neighbors", labelled).drop("_n", "_a", "_slots")


def lte_cellmeas(records: DataFrame) -> DataFrame:
    """Serving cell and best neighbour per frequency and PCI of LTE cell-measurement rows (blocks of 11 fields)."""
    d = records.where((F.col("header") == "CELLMEAS") & (integer(part(3)) == 7))
    n = F.size("parts")
    starts = F.when(n >= 18, F.sequence(F.lit(7), n - 11, F.lit(11))).otherwise(F.array().cast("array<int>"))

    def block(k):
        at = lambda j: F.try_element_at("parts", (k + j + 1).cast("int"))

        def found(x):
            freq, pci, rsrp, rsrq = (x[n] for n in ("freq", "pci", "rsrp", "rsrq"))
            ok = x["code"].between(0, 20) & (freq > 0) & (freq < 100000) & (F.abs(freq - F.round(freq)) < 0.01) & pci.between(0, 503)
            ok = ok & (rsrp < -20) & (rsrp > -140) & (rsrq <= 5) & (rsrq > -40)
            return F.when(ok, F.struct(
                k.cast("long").alias("k"), F.round(freq).cast("long").alias("freq"), pci.alias("pci"), rsrp.alias("rsrp"), rsrq.alias("rsrq"), num(at(4)).alias("raw_power"),
                F.coalesce(num(at(10)), num(at(8))).alias("sinr"), integer(at(7)).alias("cell_id"), integer(at(1)).alias("band_code")))

        return S.once(F.struct(integer(at(0)).alias("code"), num(at(2)).alias("freq"), integer(at(3)).alias("pci"), num(at(5)).alias("rsrp"), num(at(6)).alias("rsrq")), found)

    d = d.withColumn("_b", F.filter(F.transform(starts, block), lambda b: b.isNotNull()))
    first = F.try_element_at("_b", F.lit(1))
    d = d.withColumn("serving_freq", F.coalesce(first["freq"], F.round(num(part(9))).cast("long"))).withColumn("serving_pci", F.coalesce(first["pci"], integer(part(10))))
    d = d.withColumn("serving_rsrp", F.coalesce(first["rsrp"], num(part(12)))).withColumn("serving_rsrq", F.coalesce(first["rsrq"], num(part(13))))
    d = d.withColumn("serving_sinr", F.when(first["sinr"].between(-30, 60), first["sinr"]))
    same = lambda a, b: (a["freq"] == b["freq"]) & (a["pci"] == b["pci"])
    better = lambda a, b: (a["rsrp"] > b["rsrp"]) | ((a["rsrp"] == b["rsrp"]) & (a["k"] < b["k"]))
    best = F.filter("_b", lambda b: ~F.exists("_b", lambda c: same(c, b) & better(c, b)))
    marked = F.transform(best, lambda b: b.withField("is_serving", (b["freq"] == F.col("serving_freq")) & (b["pci"] == F.col("serving_pci"))))
    d = d.withColumn("neighbors", marked).withColumn("band", S.band_from_earfcn("serving_freq")).drop("_b", "parts", "raw", "header")
    return materialize(d, "cells")


def cellmeas_dominance(records: DataFrame) -> DataFrame:
    """Dominance evidence of UMTS cell measurements: gap between the two strongest subtype-A cells, counts per subtype."""
    d = records.where((F.col("header") == "CELLMEAS") & (integer(part(3)) == 5))
    d = d.withColumn("_all", F.explode(F.array(_network_tuples(_networks(), 511))))
    d = d.withColumn("_b", _dedupe(F.col("_all")))
    levels = F.sort_array(F.transform(F.filter("_b", lambda b: b["subtype"] == "A"), lambda b: b["rscp"]), asc=False)
    count = lambda s: F.size(F.filter("_b", lambda b: b["subtype"] == s)).cast("long")
    d = d.withColumn("subtype_a", count("A")).withColumn("subtype_b", count("B")).withColumn("neighbor_count", F.size("_b").cast("long"))
    return d.withColumn("gap", F.try_element_at(levels, F.lit(1)) - F.try_element_at(levels, F.lit(2))).drop("_all", "_b", "parts", "raw", "header")


def flatten_neighbors(cells: DataFrame, slots: int, value: Sequence[str] = ("sc", "rscp", "ecno", "freq")) -> DataFrame:
    """Labelled neighbours as columns a2_rscp, m1_sc, .. of the first ``slots`` labels of each set (16 is customary); no shuffle."""
    labels = [f"A{i}" for i in range(2, slots + 2)] + [f"{x}{i}" for x in "MD" for i in range(1, slots + 1)]
    hit = lambda label: F.try_element_at(F.filter("neighbors", lambda n: n["label"] == label), F.lit(1))
    return cells.select("*", *[hit(label)[v].alias(f"{label.lower()}_{v}") for label in labels for v in value])


# ---- events and signalling --------------------------------------------------------------------------------------------------

DL_LOSS = "DL sync loss (Interference / coverage)"
UL_LOSS = "UL sync loss (UE can’t reach NodeB)"


def extract_events(records: DataFrame, keep: Sequence[str] | None = None, l3_failures: bool = False) -> DataFrame:
    """Event rows named by header and message rules; one record may give several.

    ``l3_failures`` also reads sync loss and link failure from layer-3 records.
    """
    up = F.upper("raw")
    loose = F.replace(up, F.lit("_"), F.lit(" "))
    h, msg = F.col("header"), part(5)
    has = lambda c, *xs: _any([F.contains(c, F.lit(x)) for x in xs])
    rrc, l3 = h == "RRCSM", h == "L3SM"
    ev = lambda cond, name, text: F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(name).alias("event"), (text if isinstance(text, Column) else F.lit(text)).cast("string").alias("message")))
    command = has(up, "RADIO_BEARER_SETUP", "RADIO_BEARER_RECONFIGURATION", "PHYSICAL_CHANNEL_RECONFIGURATION", "ACTIVE_SET_UPDATE", "MEASUREMENT_CONTROL")
    other = has(up, "CELL_UPDATE", "PAGING_TYPE")
    sync_src = rrc | l3 if l3_failures else rrc
    src = [num(part(i)) for i in (8, 9, 13, 14)]  # source EARFCN, PCI, target EARFCN, PCI
    inter = F.coalesce(src[0] != src[2], F.lit(False))
    cell = lambda p, e: F.concat(
        F.coalesce(p.cast("long").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit("/"), e.cast("long").cast("string")), F.lit("")))
    hoa_text = F.concat(F.when(inter, "A5 InterFreq").otherwise("A3 IntraFreq"), F.lit(" HOA "), cell(src[1], src[0]), F.lit(" -> "), cell(src[3], src[2]))
    alarm = lambda *codes: (h == "RRA") & part(5).isin(*codes)
    rules = [
        ev(rrc & command & (part(4) == "2") & ~has(up, "COMPLETE"), "HO Command", msg),
        ev(rrc & ~command & ~other & has(up, "RRC_CONNECTION_RELEASE"), "RRC Release", "RRC Connection Released"),
        ev(rrc & (part(4) == "1") & has(up, "COMPLETE"), "HO Completion", msg),
        ev(sync_src & has(loose, "OUT") & has(loose, "SYNC"), DL_LOSS, "Downlink Out of Sync Indication"),
        ev(rrc & has(loose, "UL") & has(loose, "SYNC") & has(loose, "LOSS"), UL_LOSS, "Uplink Synchronization Loss"),
        ev(sync_src & has(loose, "RL FAILURE", "RADIO LINK FAILURE", "RLF", "REESTABLISHMENT"), "RLF indication", F.coalesce(msg, F.lit("Radio Link Failure Indication"))),
        ev(rrc & has(up, "T310_EXPIRY", "T310 EXPIRED"), "T310", "Timer T310 Expired"),
        ev(rrc & has(up, "T312_EXPIRY", "T312 EXPIRED"), "T312", "Timer T312 Expired"),
        ev((h == "HOA") & F.coalesce(*src).isNotNull(), "A3/A5 Event", hoa_text),
        ev(l3 & msg.isin("RELEASE", "DISCONNECT"), "CS Release", "CS Call Released"),
        ev((h == "RRD") & (part(6) == "1"), "Call Drop", "RRD Release Cause 1"), ev((h == "RRD") & (part(6) == "5"), "RLF indication", "RRD Release Cause 5"),
        ev(alarm("16", "2"), "RLF indication", F.concat(F.lit("Radio Resource Alarm (RRA Cause "), part(5), F.lit(")"))),
        ev(alarm("12"), DL_LOSS, "Radio Resource Alarm (RRA Cause 12)"), ev(alarm("4"), UL_LOSS, "Radio Resource Alarm (RRA Cause 4)"),
        ev((h == "CAF") & (part(6) == "2") & (F.coalesce(msg, F.lit("")) != "RRC_CONNECTION_RELEASE"), "RLF indication", "Channel Activation Failure (CAF)"),
    ]
    whole = lambda c, i: F.when(h == "HOA", c.cast("long")).alias(i)
    base = list(keep) if keep else [c for c in records.columns if c not in ("parts", "raw", "header")]
    d = records.where(h.isin("RRCSM", "L3SM", "HOA", "RRD", "RRA", "CAF"))
    return d.select(
        *base, whole(src[1], "src_pci"), whole(src[0], "src_earfcn"), whole(src[3], "tgt_pci"), whole(src[2], "tgt_earfcn"),
        F.explode(F.array_compact(F.array(*rules))).alias("e")).select(*base, "src_pci", "src_earfcn", "tgt_pci", "tgt_earfcn", "e.*")


def _any(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


# Direction by message name, first match counts.
DIRECTIONS = [
    ("UPLINK", "UL"), ("DOWNLINK", "DL"), ("SERVICE_REQUEST", "UL"), ("SERVICE_ACCEPT", "DL"), ("PDP_CONTEXT_REQUEST", "UL"),
    ("PDP_CONTEXT_ACCEPT", "DL"), ("RRC_CONNECTION_REQUEST", "UL"), ("RRC_CONNECTION_SETUP", "DL"), ("RRC_CONNECTION_RELEASE", "DL"),
    ("SYSTEM_INFORMATION", "DL"), ("MEASUREMENT_CONTROL", "DL"), ("MEASUREMENT_REPORT", "UL"), ("SECURITY_MODE_COMMAND", "DL"),
    ("SECURITY_MODE_COMPLETE", "UL"), ("IDENTITY_REQUEST", "DL"), ("IDENTITY_RESPONSE", "UL"), ("AUTHENTICATION_REQUEST", "DL"),
    ("AUTHENTICATION_RESPONSE", "UL"), ("LOCATION_UPDATE_REQUEST", "UL"), ("LOCATION_UPDATE_ACCEPT", "DL"),
    ("ROUTING_AREA_UPDATE_REQUEST", "UL"), ("ROUTING_AREA_UPDATE_ACCEPT", "DL"), ("CALL_PROCEEDING", "DL"),
]


def signalling_rows(records: DataFrame) -> DataFrame:
    """Rows of RRC and layer-3 headers: message, direction, channel, frequency, code and raw payload."""
    d = records.where(F.contains("header", F.lit("RRC")) | F.contains("header", F.lit("L3")))
    worded = F.filter(F.slice("parts", 3, F.greatest(F.size("parts") - 2, F.lit(0))), lambda x: (F.length(F.trim(x)) > 5) & ~F.trim(x).rlike(r"^\d+$"))
    named = F.when((part(5) != "") & ~part(5).rlike(r"^\d+$"), part(5))
    d = d.withColumn("message", F.coalesce(named, F.trim(F.try_element_at(worded, F.lit(1))), F.lit("Unknown")))
    m, up = F.upper("message"), F.upper("raw")
    guess = F
    for text, way in DIRECTIONS:
        guess = guess.when(F.contains(m, F.lit(text)), way)
    guess = guess.when(F.contains(m, F.lit("SETUP")) & ~F.contains(m, F.lit("SETUP_COMPLETE")), "UL").otherwise("N/A")
    way = (
        F.when(F.contains(up, F.lit("UPLINK")), "UL").when(F.contains(up, F.lit("DOWNLINK")), "DL").when(part(2) == "0", "DL").when(part(2) == "1", "UL")
        .when(part(4) == "1", "UL").when(part(4) == "2", "DL").otherwise(guess)
    )
    last = F.trim(F.element_at("parts", -1))
    return d.withColumn("direction", way).withColumn("channel", F.when(part(6) != "", part(6))).withColumn("freq", num(part(7))).withColumn("sc", integer(part(8))).withColumn(
        "payload_hex", F.when(last.rlike("(?i)^[0-9A-F]+$") & (F.length(last) >= 16), last)).drop("parts", "header")


def gps_rows(records: DataFrame) -> DataFrame:
    d = records.where("header = 'GPS'").withColumn("lat", num(part(4))).withColumn("lon", num(part(3))).withColumn("alt", num(part(5))).withColumn("speed", num(part(8)))
    return d.where("lat is not null and lon is not null").drop("parts", "raw", "header")


# Prefixes of short cell ids in payloads and the controllers they stand for.
CONTROLLERS = {"1BA": 442, "1BB": 443, "1BC": 444, "1BD": 445, "1BE": 446}
_IDENTITY_MESSAGES = "RECONFIGURATION|ACTIVE_SET_UPDATE|MEASUREMENT_CONTROL|CELL_UPDATE|TRANSPORT_CHANNEL|HANDOVER_FROM_UTRAN|SYSTEM_INFORMATION"


def identity_track(records: DataFrame) -> DataFrame:
    """Serving identity states found in a log: technology, long cell id, controller, location area, scrambling code."""
    h = F.col("header")
    tech = integer(part(3))
    d = records.where(h.isin("CHI", "EDCHI", "PCHI", "RRCSM", "CREL", "RRD"))
    ints = F.transform("parts", lambda x, i: F.struct(i.alias("i"), integer(x).alias("v"), x.alias("t")))
    d = d.withColumn("_i", ints)
    big = F.try_element_at(F.filter("_i", lambda x: (x["i"] >= 6) & (x["v"] > 20000)), F.lit(1))
    d = d.withColumn("_big", big)
    around = F.filter("_i", lambda x: (x["i"] > F.col("_big.i")) & (x["i"] <= F.col("_big.i") + 4) & ~F.contains(x["t"], F.lit(".")) & (x["t"] != "") & x["v"].between(1, 65534))
    d = d.withColumn("_near", around)
    lac = F.try_element_at("_near", F.lit(1))["v"]
    psc = F.try_element_at(F.filter(F.slice("_near", 2, 4), lambda x: x["v"] <= 511), F.lit(1))["v"]
    plain = lambda lo, hi: F.try_element_at(F.filter(
        "_i", lambda x: (x["i"] >= 6) & ~F.contains(x["t"], F.lit(".")) & (x["v"] > lo) & (x["v"] < hi)), F.lit(1))["v"]
    rnc2, cid2 = plain(10, 4096), plain(4096, 65535)
    both = rnc2.isNotNull() & cid2.isNotNull()
    kinds = {"rat": "string", "cid": "long", "rnc": "long", "lac": "long", "psc": "long", "freq": "double", "source": "string", "event": "string"}
    st = lambda **kw: F.struct(*[(kw[k] if k in kw else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    shift = lambda c: c * 65536
    chi3 = st(
        rat=F.lit("UMTS"), source=F.lit("CHI"), cid=F.when(F.col("_big").isNotNull(), F.col("_big.v")).when(both, shift(rnc2) + cid2),
        rnc=F.when(F.col("_big").isNotNull(), F.shiftright(F.col("_big.v"), 16)).when(both, rnc2), lac=F.when(F.col("_big").isNotNull(), lac),
        psc=F.when(F.col("_big").isNotNull(), psc))
    long_row = F.size("parts") > 10
    chi4 = st(rat=F.lit("LTE"), source=F.lit("CHI"), cid=F.when(long_row, integer(part(9))), lac=F.when(long_row, integer(part(10))))
    hexa = F.trim(F.element_at("parts", -1))
    body = F.substr(hexa, F.lit(9))
    spot, ctrl = F.lit(None).cast("int"), F.lit(None).cast("long")
    for prefix, rnc in reversed(CONTROLLERS.items()):
        seen = F.instr(body, prefix)
        spot, ctrl = F.when(seen > 0, seen).otherwise(spot), F.when(seen > 0, F.lit(rnc)).otherwise(ctrl)
    short = F.conv(F.substr(body, spot, F.lit(6)), 16, 10).cast("long")
    fits = (spot + 5 <= F.length(body)) & F.substr(body, spot, F.lit(6)).rlike("^[0-9A-Fa-f]{6}$")
    signalled = st(rat=F.lit("UMTS"), source=F.lit("signaling_rrc"), cid=shift(F.shiftright(short, 12)) + short.bitwiseAND(F.lit(0xFFF)) * 16, rnc=ctrl, psc=integer(part(8)))
    relevant = (tech == 5) & (F.length(hexa) > 30) & part(5).rlike(_IDENTITY_MESSAGES) & F.coalesce(fits, F.lit(False))
    state = (
        F.when((h == "CHI") & (tech == 5), chi3).when((h == "CHI") & (tech == 7), chi4)
        .when(h.isin("EDCHI", "PCHI") & (tech == 5) & (num(part(10)) > 0), st(source=h, freq=num(part(10)), psc=integer(part(11))))
        .when((h == "RRCSM") & relevant, signalled)
        .when((h == "CREL") & (integer(part(10)) == 5) & integer(part(12)).isNotNull() & integer(part(13)).isNotNull(),
              st(rat=F.lit("UMTS"), source=h, cid=integer(part(13)), rnc=integer(part(12))))
        .when((h == "RRD") & part(6).isin("1", "5"), st(source=F.lit("RRD_EVENT"), event=F.when(part(6) == "1", "Call Drop").otherwise("Call Fail")))
    )
    base = [c for c in records.columns if c not in ("parts", "raw", "header")]
    return d.select(*base, F.explode(F.array_compact(F.array(state))).alias("s")).select(*base, "s.*")


def event_1a_history(records: DataFrame) -> DataFrame:
    """Event-1A parameter runs in UMTS identity rows: hysteresis, threshold, range, time to trigger, filter, EcNo threshold."""
    d = records.where((F.col("header") == "CHI") & (integer(part(3)) == 5))
    n = F.size("parts")
    starts = F.when(n >= 16, F.sequence(F.lit(10), n - 6)).otherwise(F.array().cast("array<int>"))

    def run(x):
        at = lambda j: F.try_element_at("parts", (x + j + 1).cast("int"))
        hyst, reach, ttt = num(at(0)), num(at(2)), integer(at(3))
        ok = hyst.between(0, 10) & reach.between(0, 10) & ttt.isin(1280, 640, 320, 160, 100, 200)
        return F.when(ok, F.struct(
            x.cast("long").alias("position"), hyst.alias("hysteresis"), num(at(1)).alias("threshold_rscp"), reach.alias("range"), ttt.alias("time_to_trigger"), num(at(4)).alias("filter_coef"),
            num(at(5)).alias("threshold_ecno")))

    base = [c for c in records.columns if c not in ("parts", "raw", "header")]
    return d.select(*base, F.explode(F.filter(F.transform(starts, run), lambda r: r.isNotNull())).alias("r")).select(*base, "r.*")


STICKY = ("tx", "tpc", "node_b_tx", "timing_advance", "cqi_dl")


def sticky_states(records: DataFrame, keys: Sequence[str] = KEYS, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """At each power, timing-advance and channel-quality row the latest value of every kind known by then.

    Values that can't be (an advance beyond 0 to 2000, a quality beyond 1 to 15, a quality of another technology than LTE) leave
    the known one as it is.
    """
    h = F.col("header")
    strict = lambda i, lo, hi: F.when(F.trim(part(i)).try_cast("double").between(lo, hi), F.trim(part(i)).try_cast("double"))
    advance = num(part(4))
    values = {
        "tx": F.when(h == "TXPC", num(part(4))), "tpc": F.when(h == "TXPC", integer(part(5))), "node_b_tx": F.when(h == "RXPC", num(part(5))),
        "timing_advance": F.when((h == "TAD") & advance.between(0, 2000), advance),
        "cqi_dl": F.when((h == "CQI") & (integer(part(3)) == 7), F.coalesce(strict(7, 1, 15), strict(8, 1, 15))),
    }
    d = records.where(h.isin("TXPC", "RXPC", "TAD", "CQI"))
    base = [c for c in records.columns if c not in ("parts", "raw", "header", *values)]
    d = d.select(*base, *[v.alias(n) for n, v in values.items()])
    return ordered.with_last_known(d, keys, {n: n for n in values}, seq="line_no", block_ms=block_ms)


def measurement_points(cells: DataFrame, gps: DataFrame, identities: DataFrame, states: DataFrame, keys: Sequence[str] = KEYS, block_ms: int = ordered.HOUR_MS) -> DataFrame:
    """Cell measurements with the position, identity and sticky radio state known at their time; rows without position are dropped."""
    g = gps.select(*keys, "ts_ms", F.col("line_no").alias("seq"), "lat", "lon", "alt", "speed")
    i = identities.where("event is null").select(*keys, "ts_ms", F.col("line_no").alias("seq"), "rat", "cid", "rnc", "lac", "psc")
    d = timejoin.asof_backward(cells, g, keys, left_seq="line_no", value="gps", block_ms=block_ms).where("gps is not null")
    d = timejoin.asof_backward(d, i, keys, left_seq="line_no", value="identity", block_ms=block_ms)
    s = states.select(*keys, "ts_ms", F.col("line_no").alias("seq"), *[c for c in STICKY if c in states.columns])
    return timejoin.asof_backward(d, s, keys, left_seq="line_no", value="state", block_ms=block_ms)
