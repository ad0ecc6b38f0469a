"""SimHash fingerprints of documents, and block tables that find those within a Hamming radius.

Terms are pairs of neighbouring words (a text of one word has that word only). A term's hash votes on 64 signed bits, once for
each occurrence and with its weight; the sign of the sum is the bit. Pairs of short words, the frequent ones that all texts
of a language share, have a quarter of the weight of others.

Defined results: null and empty texts have the fingerprint 0; equal texts have equal ones; a tie of votes gives 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.frames import each_batch, id_and_text, partitions
from drivescope.operators.ordered import attach

U64 = np.uint64
LONG, SHORT, SHORT_BYTES = 4, 1, 7
# Spread: eight votes of a byte as eight 8-bit counters of one number; up to 255 bytes add up without overflow.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=U64)


def _votes(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the hashes ``h[cuts[i]:cuts[i + 1]]`` have each bit set: documents x 64."""
    n = len(cuts) - 1
    out = np.zeros((n, 64), dtype=np.int64)
    if not len(h):
        return out
    # Groups of at most 255 hashes within a document, each summed as packed counters.
    counts = np.diff(cuts)
    groups = -(-counts // 255)
    doc = np.repeat(np.arange(n), groups)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(groups) - groups, groups)
    begins = cuts[:-1][doc] + 255 * nth
    if not len(begins):
        return out
    bytes_of = h.view(np.uint8).reshape(-1, 8)
    packed = np.empty((len(begins), 8), dtype=U64)
    for i in range(8):
        packed[:, i] = np.add.reduceat(_SPREAD[bytes_of[:, i]], begins)
    np.add.at(out, doc, packed.view(np.uint8).reshape(-1, 64).astype(np.int64))
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint for each text."""
    out = np.zeros(len(texts), dtype=U64)
    for a, b, w in T.word_chunks(texts):
        h = w.hashes()
        counts = w.counts()
        pairs, inside = T.run_hashes(h, 2), T.run_mask(w.first, 2)
        begin = np.flatnonzero(inside)
        single = w.first[:-1][counts == 1]
        at, terms = np.r_[begin, single], np.r_[pairs[begin], T.mix(h[single], 3)]
        order = np.argsort(at, kind="stable")
        at, terms = at[order], terms[order]
        length = w.ends[np.minimum(at + 1, len(h) - 1)] - w.starts[at] if len(at) else at
        ones, most = np.zeros((b - a, 64), dtype=np.int64), np.zeros(b - a, dtype=np.int64)
        for weight, chosen in ((LONG, length > SHORT_BYTES), (SHORT, length <= SHORT_BYTES)):
            cuts = np.searchsorted(at[chosen], w.first)
            ones += weight * _votes(terms[chosen], cuts)
            most += weight * np.diff(cuts)
        bits = 2 * ones > most[:, None]
        out[a:b] = np.packbits(bits, axis=1, bitorder="little").view(U64)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of bits that differ."""
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` (a signed 64-bit number) for every document."""
    d = id_and_text(docs, id_col, text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], ["id", "fingerprint"])

    return d.mapInArrow(each_batch(one), f"id {d.schema['id'].dataType.simpleString()}, fingerprint long")


def _masks(radius: int, blocks: int | None = None) -> list[int]:
    """The bits that each block table compares."""
    blocks = blocks or radius + 3
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius and be 64 at most")
    borders = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(borders, borders[1:], strict=False)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(masks: list[int]) -> list[int]:
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _keyed(prints: DataFrame, signed: list[int]) -> DataFrame:
    """``fingerprint, table, key``: each different fingerprint in each block table."""
    one = prints.select("fingerprint").where("fingerprint is not null").distinct()
    return one.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs ``a < b`` of different fingerprints at most ``radius`` bits apart, with ``distance``.

    The 64 bits are cut into ``blocks`` (radius + 3 unless given); two fingerprints within the radius agree on at least
    ``blocks - radius`` of them, so one table for each choice of that many blocks, keyed by their bits, finds every pair. A
    pair is reported by the first table in which it meets. Equal fingerprints count once: join copies by fingerprint.
    """
    signed = _signed(_masks(radius, blocks))
    keyed = _keyed(prints, signed)
    a, b = (keyed.select(F.col("fingerprint").alias(n), "table", "key") for n in "ab")
    distance: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    earlier = F.array(*[F.lit(m) for m in signed])
    first = ~F.exists(F.slice(earlier, 1, F.col("table")), lambda m: F.col("a").bitwiseAND(m) == F.col("b").bitwiseAND(m))
    return a.join(b, ["table", "key"]).where((F.col("a") < F.col("b")) & (distance <= radius) & first).select("a", "b", distance.cast("int").alias("distance"))


def _tile_counts(prints: np.ndarray, left: np.ndarray, same: bool, table: int, radius: int, masks: np.ndarray) -> np.ndarray:
    """For each fingerprint of a tile, how many of the other side (all, where ``same``) are near and first meet in this table."""
    a, b = (np.arange(len(prints)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    out = np.zeros(len(prints), dtype=np.int64)
    step = max(1, (1 << 22) // max(1, len(b)))
    for i in range(0, len(a), step):
        x = prints[a[i : i + step], None] ^ prints[None, b]
        rows, columns = np.nonzero((np.bitwise_count(x) <= radius) & (x != 0))
        x = x[rows, columns]
        first = np.ones(len(x), dtype=bool)
        for m in masks[:table]:
            first &= (x & m) != 0
        out[a] += np.bincount(rows[first] + i, minlength=len(a))
        if not same:
            out[b] += np.bincount(columns[first], minlength=len(b))
    return out


def near_counts(prints: DataFrame, radius: int = 3, blocks: int | None = None, side: int = 8192) -> DataFrame:
    """``fingerprint, n_near`` of each fingerprint that has different ones within ``radius``: how many. No pairs are written.

    Tables and the first meeting as in ``near_fingerprints``. Each key's fingerprints are compared as arrays; a key with more
    than ``side`` of them is cut into parts by hash, and each two parts are a tile of its own, so no key stays in one task.
    """
    masks = _masks(radius, blocks)
    met = _keyed(prints, _signed(masks)).withColumn("met", F.count("*").over(Window.partitionBy("table", "key"))).where("met > 1")
    parts = F.ceil(F.col("met") / side).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(F.col("own"), p).alias("low"), F.greatest(F.col("own"), p).alias("high")))
    dealt = met.withColumn("parts", parts).withColumn("own", own).select("fingerprint", "table", "key", "own", F.inline(tiles))
    tile = ["table", "key", "low", "high"]
    dealt = dealt.repartition(partitions(prints.sparkSession), *tile).sortWithinPartitions(*tile)
    tables = np.array(masks, dtype=U64)

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: rows.column(c).to_numpy() for c in ("fingerprint", "own", *tile)}
        new = np.logical_or.reduce([np.diff(columns[c]) != 0 for c in tile])
        borders = np.r_[0, np.flatnonzero(new) + 1, len(new) + 1]
        found = np.zeros(len(new) + 1, dtype=np.int64)
        for i, j in zip(borders.tolist(), borders[1:].tolist(), strict=False):
            low = columns["low"][i]
            found[i:j] = _tile_counts(columns["fingerprint"][i:j].view(U64), columns["own"][i:j] == low, low == columns["high"][i], int(columns["table"][i]), radius, tables)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(columns["fingerprint"][some]), pa.array(found[some])], ["fingerprint", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows from the begin of the tile that isn't complete
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = lambda r, at: [r.column(c)[at].as_py() for c in tile]
            if held and ends(batch, 0) != ends(held[-1], held[-1].num_rows - 1):
                yield from counted(pa.Table.from_batches(held))
                held = []
            begin = max(int(np.flatnonzero(np.diff(batch.column(c).to_numpy()))[-1:].max(initial=-1)) + 1 for c in tile)
            if begin:
                yield from counted(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from counted(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "fingerprint long, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def with_near_counts(rows: DataFrame, radius: int = 3, blocks: int | None = None, spread: int = 32) -> DataFrame:
    """Adds ``n_near``, different fingerprints within ``radius``, and ``n_equal``, other rows of the same fingerprint, to rows with ``fingerprint``, a long.

    ``rows`` are read three times: materialise them. A fingerprint of many rows is dealt over ``spread`` tasks.
    """
    copies = rows.groupBy("fingerprint").agg((F.count("*") - 1).alias("n_equal")).where("n_equal > 0")
    per_print = copies.join(near_counts(rows, radius, blocks), "fingerprint", "full")
    many = attach(rows, per_print, ["fingerprint"], "left", by=["id"], spread=spread)
    return many.withColumn("n_near", F.coalesce("n_near", F.lit(0))).withColumn("n_equal", F.coalesce("n_equal", F.lit(0)))
