"""Near-duplicates by min-max hashing: signatures, bands, exact confirmation, components.

Under each permutation of the shingles both the least and the greatest value are kept, so a signature of 2 p values costs p
hash evaluations. Bands of ``ROWS`` values bring documents together; the number of bands follows from the similarity and from
the chance ``MISS`` that a pair right at the threshold meets in none.

Documents with equal sets are one class, known by the sums of their hashes. A bucket's classes are compared with two of its
members only, the first one and the one with most company in all its buckets; each comparison is exact, on full sets. After
that the classes of most buckets are one component, and no further comparison could add anything. For the buckets that
still hold several components, all pairs across components must be known; they come from an exact join: two sets as alike as
asked share one of their rarest shingles (prefix filter), the places of the first shared one bound what can be common
(position filter), and shingles that no other candidate has bound the size of possible partners. Copies with many own edits thus have no candidates, and
groups of copies are never paired off among themselves.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle; rows with equal ids and texts are one document; a row without id is linked with
nothing and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.components import components
from drivescope.llm.frames import id_and_text
from drivescope.operators.staging import materialize

ROWS, MISS, PER_TASK = 4, 1e-6, 512
U64 = np.uint64


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending, in one array, and its cuts. ASCII letters count as lower-case ones."""
    h, counts = w.hashes(lower=True), w.counts()
    begin = np.flatnonzero(T.run_mask(w.first, k))
    short = np.flatnonzero((counts > 0) & (counts < k))
    values = np.r_[T.run_hashes(h, k)[begin], T.span_hashes(h, w.first[short], w.first[short + 1])]
    doc = np.r_[np.searchsorted(w.first, begin, side="right") - 1, short]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])][: len(values)]
    return values[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def signatures(values: np.ndarray, cuts: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band keys: documents x bands, of documents that have shingles."""
    need = bands * rows
    turns = T.mix(np.arange(2 * -(-need // 2), dtype=U64), 23)
    low, high = [], []
    for a, b in zip(turns[::2] | U64(1), turns[1::2], strict=True):
        turned = (values ^ b) * a
        low.append(np.minimum.reduceat(turned, cuts[:-1]))
        high.append(np.maximum.reduceat(turned, cuts[:-1]))
    slots = np.stack([*low, *high])[:need].reshape(bands, rows, -1)
    keys = np.zeros((bands, slots.shape[2]), dtype=U64)
    for i in range(rows):
        keys = T.mix(keys + slots[:, i], 31 + i)
    return T.mix(keys + np.arange(bands, dtype=U64)[:, None], 41).T


def _sign(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in T.word_chunks(batch.column("text")):
                values, cuts = shingle_sets(w, k)
                size = np.diff(cuts)
                some = np.flatnonzero(size)
                keys, sums = np.zeros((0, bands), dtype=U64), np.zeros((2, b - a), dtype=U64)
                if len(some):
                    keys = signatures(values, np.r_[cuts[some], cuts[-1]], bands)
                    for i in range(2):
                        sums[i, some] = np.add.reduceat(T.mix(values, 51 + i), cuts[some])
                offsets = np.r_[0, np.cumsum(np.where(size > 0, bands, 0))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("crc").slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)),
                                                  pa.array(sums[1].view(np.int64)), T.long_arrays(np.ascontiguousarray(keys).reshape(-1), offsets)], ["id", "crc", "n", "sum_a", "sum_b", "keys"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in T.word_chunks(batch.column("text")):
                values, cuts = shingle_sets(w, k)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(np.diff(cuts).astype(np.int64)), T.long_arrays(values, cuts)], ["node", "n", "shingles"])

    return run


def _confirm(percent: int):
    """Rows of a hub follow the hub's own row; links are those with enough in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, dtype=np.int64)
        for batch in batches:
            lists = batch.column("shingles")
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, own in enumerate(batch.column("is_hub").to_pylist()):
                one = flat[cuts[i] : cuts[i + 1]].view(U64)
                if own:
                    hub = one.copy()
                    continue
                at = np.minimum(np.searchsorted(hub, one), len(hub) - 1)
                common = int((hub[at] == one).sum())
                linked[i] = 100 * common >= percent * (len(hub) + len(one) - common)
            chosen = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(chosen), batch.column("hub").take(chosen)], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``node, hub``) whose sets have ``percent`` of their union in common, as ``u, v``.

    A hub's partners are dealt over as many tasks as they need, ``PER_TASK`` each; its set goes to all of them.
    """
    pairs = materialize(pairs, "pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("parts"))
    members = pairs.join(parts, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    hubs = parts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    rows = members.unionByName(hubs).join(sets.select("node", "shingles"), "node")
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("is_hub").desc()).select("node", "hub", "is_hub", "shingles")
    kind = pairs.schema["node"].dataType.simpleString()
    return materialize(dealt.mapInArrow(_confirm(percent), f"u {kind}, v {kind}"), "links")


def _candidates(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that an exact prefix join can't rule out, from ``node, component``."""
    t = percent / 100
    tokens = mixed.join(sets, "node").select("node", "component", "n", F.explode("shingles").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("across")).where("df > 1"), "tokens")
    known = tokens.join(shared, "token").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "across"))).alias("known"))
    common = F.size("known")  # shingles that another candidate has: no more can be in common with anything
    most = F.floor(common * ((100 + percent) / percent) + 1e-6).cast("long") - F.col("n")
    prefix = F.col("n") - F.ceil(F.col("n") * t - 1e-6) + 1 - (F.col("n") - common)  # the rarest of all come first
    held = known.withColumn("low", F.ceil(F.col("n") * t - 1e-6).cast("long")).withColumn("high", F.least(F.floor(F.col("n") / t + 1e-6).cast("long"), most)).where(prefix > 0).where("high >= low")
    placed = F.transform(F.slice("known", F.lit(1), F.greatest(F.lit(0), prefix.cast("int"))),
                         lambda x, i: F.struct(x["token"].alias("token"), (F.col("n") - common + i + 1).alias("pos"), x["across"].alias("across")))
    held = held.select("node", "component", "n", "low", "high", F.inline(F.filter(placed, lambda x: x["across"])))
    held = materialize(held.drop("across"), "prefixes")
    step = math.log(1.03)
    klass = lambda c: F.floor(F.log(c.cast("double")) / step).cast("int")
    smaller = held.where("high >= n").select("token", klass(F.col("n")).alias("size"), *[F.col(c).alias(f"y_{c}") for c in ("node", "component", "n", "high", "pos")])
    greater = held.withColumn("top", F.least("high", "n")).where("top >= low").withColumn("size", F.explode(F.sequence(klass(F.col("low")), klass(F.col("top")))))
    fits = ((F.col("component") != F.col("y_component")) & F.col("y_n").between(F.col("low"), F.col("top")) & (F.col("n") <= F.col("y_high"))
            & ((F.col("n") > F.col("y_n")) | (F.col("node") > F.col("y_node"))))
    # Of the first shingle that two sets share in this order: what stands before it in either can't be common.
    shared_at_most = 1 + F.least(F.col("n") - F.col("pos"), F.col("y_n") - F.col("y_pos"))
    fits = fits & (100 * shared_at_most >= percent * (F.col("n") + F.col("y_n") - shared_at_most))
    found = greater.join(smaller, ["token", "size"]).where(fits)
    return found.select("node", F.col("y_node").alias("hub")).distinct()


def near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, crc, n_shingles, component_id`` for every row; ``crc`` is the text's checksum.

    Linked are documents whose sets of ``k``-word shingles have at least ``percent`` of their union in common;
    ``component_id`` is the smallest id that links lead to.
    """
    d = id_and_text(docs, id_col, text_col).withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    kind = d.schema["id"].dataType.simpleString()
    bands = band_count(percent)
    signed = materialize(d.mapInArrow(_sign(k, bands), f"id {kind}, crc long, n long, sum_a long, sum_b long, keys array<long>"), "signed")
    identity = ["n", "sum_a", "sum_b"]
    classes = materialize(signed.where("n > 0 and id is not null").groupBy(*identity).agg(F.min(F.struct("id", "crc")).alias("node"), F.any_value("keys").alias("keys")), "classes")
    banded = classes.select("node", F.explode("keys").alias("key"))  # the band's number is part of its key
    full = materialize(banded.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1"), "buckets")
    inside = materialize(banded.join(full, "key"), "inside")
    company = inside.groupBy("node").agg(F.sum("members").alias("company"))
    central = inside.join(company, "node").groupBy("key").agg(F.max(F.struct(F.col("company"), F.col("node").alias("most"))).alias("best")).select("key", F.col("best.most").alias("most"))
    nodes = inside.select("node").distinct()
    texts = d.select("text", F.struct("id", "crc").alias("node")).where("node.id is not null").join(nodes, "node").dropDuplicates(["node"]).select("node", "text")
    node = texts.schema["node"].dataType.simpleString()
    sets = materialize(texts.mapInArrow(_sets(k), f"node {node}, n long, shingles array<long>"), "sets")
    hubs = inside.join(central, "key").select("node", F.explode(F.array("first", "most")).alias("hub")).where("node != hub")
    ordered = hubs.select(F.col("node"), F.col("hub")).distinct()
    links = confirmed(ordered, sets, percent)
    known = materialize(components(links), "components")
    placed = inside.select("key", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    several = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
    mixed = materialize(placed.join(several, "key").select("node", "component").distinct(), "mixed")
    more = confirmed(_candidates(mixed, sets, percent), sets, percent)
    known = components(links.unionByName(more))
    named = classes.select(*identity, "node").join(known, "node", "left").select(*identity, F.coalesce("component.id", "node.id").alias("component_id"))
    return (signed.select("id", "crc", *identity).join(named.where("n > 0"), identity, "left")
            .select("id", "crc", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id")).alias("component_id")))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are linked to a smaller id; of equal rows one stays, rows without id all."""
    found = near_duplicates(docs, k, percent)
    gone = found.where("id <> component_id").select(F.col("id").alias("__id"), F.col("crc").alias("__crc")).distinct()
    own = docs.withColumn("__own", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    left = own.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__crc")), "left_anti")
    again = Window.partitionBy("doc_id", "__own").orderBy(F.lit(0))
    return left.withColumn("__nth", F.row_number().over(again)).where("__nth = 1 or doc_id is null").select(*[F.col(f"`{c}`") for c in docs.columns])
