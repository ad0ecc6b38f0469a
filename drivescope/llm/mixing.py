"""Mixing sources to target weights by weighted sampling without replacement, in whole epochs and a last fraction.

A source's target is its weight's share of all words, at most ``max_epochs`` times its own words; what a source can't take is
shared by the others by weight, until none is above its limit. A target of 2.3 source sizes means two complete epochs of
every document, then a selection of 0.3: documents are ordered by exponential keys ``-ln(u) / quality``, which draws them
without replacement with chances by quality (Efraimidis and Spirakis), and taken until the words reach the budget. The
document on the border gives the words that are missing, so a source's taken words equal its rounded target.

No source is sorted as a whole: keys are binned first, sums of bins tell which bins are full, and only the rows of one bin
are put in order, so a source with a third of all rows is dealt over as many tasks as it has bins.

Defined results: a null text has no words; null is a source of its own, the last; an empty table gives an empty result; a
table without words takes none; repeated rows count each for itself, in an order fixed by id and checksum of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.frames import each_batch, id_and_text
from drivescope.operators.staging import materialize

BINS = 4096
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, quality = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
    for a, b, w in T.word_chunks(batch.column("text")):
        sizes[a:b] = w.counts()
        letters, filled = (np.r_[0, np.cumsum(table[w.data])][w.offsets] for table in (_LETTER, T.WORD_BYTES))
        quality[a:b] = np.maximum(0.05, np.diff(letters) / np.maximum(1, np.diff(filled)))
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("crc"), pa.array(sizes), pa.array(quality)], ["id", "source", "crc", "size", "quality"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, crc, size`` in words and ``quality`` (share of letters among the bytes that aren't space, 0.05 at least)."""
    d = id_and_text(docs, id_col, text_col, source=source_col).withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    kinds = f"id {d.schema['id'].dataType.simpleString()}, source {d.schema['source'].dataType.simpleString()}, crc long, size long, quality double"
    return d.mapInArrow(each_batch(_measure), kinds)


def targets(sources: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``source, source_size``; a row for each source.

    Filling up by weight under limits: in the order of limit / weight, the limited sources come first.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = ~F.col("limited")
    return (sources.withColumn("place", F.row_number().over(everywhere) - 1)
            .withColumn("weight", F.col("place") % cycle + 1)
            .withColumn("limit", F.col("source_size") * float(max_epochs))
            .withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
            .withColumn("limited", F.col("limit") * F.col("open") <= F.col("rest") * F.col("weight"))
            .withColumn("level", F.sum("source_size").over(whole) - F.sum(F.when(free, 0.0).otherwise(F.col("limit"))).over(whole))
            .withColumn("share", F.sum(F.when(free, F.col("weight")).otherwise(0)).over(whole))
            .withColumn("target", F.when(F.col("limited"), F.col("limit")).otherwise(F.col("level") * F.col("weight") / F.col("share")))
            .select("source", "place", "source_size", "weight", "target"))


def mix(rows: DataFrame, seed: int = 11, max_epochs: int = 3) -> DataFrame:
    """``id, source, crc, size, source_size, target, taken`` for rows of ``sized``; ``taken`` counts words, repeats included."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("crc")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = rows.withColumn("key", -F.log(u) / F.col("quality"))
    keyed = materialize(keyed.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int")), "mix")
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    plan = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), max_epochs)
    ahead = Window.partitionBy("place").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows a source
    bins = (bins.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
            .withColumn("epochs", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
            .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
            .withColumn("bins_ahead", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0)))
            .select(F.col("source").alias("s"), F.col("bin").alias("b"), "source_size", "target", "epochs", "budget", "bins_ahead"))
    before = Window.partitionBy("source", "bin").orderBy("key", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("bins_ahead") - F.coalesce(F.col("rows_ahead"), F.lit(0))
    return (keyed.withColumn("rows_ahead", F.sum("size").over(before))
            .join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
            .select("id", "source", "crc", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")))


def _first_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The text up to the end of word number ``part``."""
    parts, at = batch.column("__part").to_numpy(), batch.schema.get_field_index("text")
    texts: list[str] = []
    for a, b, w in T.word_chunks(batch.column("text")):
        for i in range(b - a):
            if parts[a + i] < 0:
                texts.append(batch.column("text")[a + i].as_py())
            else:
                stop = w.ends[w.first[i] + parts[a + i] - 1]
                texts.append(bytes(w.data[w.offsets[i] : stop]).decode())
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))


def mixed_documents(docs: DataFrame, seed: int = 11, max_epochs: int = 3) -> DataFrame:
    """The documents of the mix: each row as often as it was taken, the one on a source's border once more, cut to the words needed."""
    rows = mix(sized(docs), seed, max_epochs)
    plan = rows.groupBy(F.col("id").alias("__id"), F.col("crc").alias("__crc")).agg(F.sort_array(F.collect_list(F.struct("size", "taken"))).alias("__takes"))
    columns = docs.columns
    d = docs.withColumn("__own", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    again = Window.partitionBy("doc_id", "__own").orderBy(F.lit(0))  # equal rows share their list of amounts
    d = (d.withColumn("__nth", F.row_number().over(again)).join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__crc")))
         .withColumn("__take", F.element_at("__takes", F.col("__nth")))
         .withColumn("__size", F.greatest(F.col("__take.size"), F.lit(1)))
         .withColumn("__rest", F.col("__take.taken") % F.col("__size"))
         .withColumn("__copies", F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("__take.taken") / F.col("__size")).cast("int")))
         .withColumn("__part", F.explode(F.concat("__copies", F.when(F.col("__rest") > 0, F.array("__rest")).otherwise(F.array().cast("array<bigint>"))))))
    d = d.select(*[F.col(f"`{c}`") for c in columns], "__part")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    cut = d.mapInArrow(each_batch(_first_words), kinds)
    return (cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else cut).select(*[F.col(f"`{c}`") for c in columns])
