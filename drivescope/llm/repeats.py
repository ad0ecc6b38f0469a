"""Substring dedup by seed and extend: passages of at least ``min_words`` words that occur more than once.

Seeds: the runs of ``SEED`` words of a document are hashed, and every window of ``min_words`` words is owned by its smallest
one (winnowing): equal windows have equal owners wherever they stand. Neighbouring windows of one owner make a segment; the
join of documents on owners leaves those that occur twice. Segments of one owner that have all words in common are one
class: with two members, all of their windows are repeats, without looking at pairs. Where an owner has several classes, a
match ends somewhere inside: each lone segment and one member of each larger class are extended window by window to both
sides of the seed, and windows that two of them share are repeats. Overlapping repeats unite to maximal ones.

Work and rows grow with the words, never with the pairs of a group: copies meet in counts. Keys are pairs of 64-bit hashes.

Defined results: words are runs without ASCII white space, unchanged; null texts have none; texts shorter than ``min_words``
hold no repeat; a passage that recurs within one document counts; rows with equal id and text count each, and get the same
spans; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.frames import each_batch, id_and_text
from drivescope.operators.staging import materialize

SEED = 8
U64 = np.uint64


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, in steps that double."""
    pick, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def segments_of(w: T.Words, min_words: int, seed: int) -> tuple[np.ndarray, ...]:
    """``first window, windows, owner, content, again`` of the segments; ``again``: the owner may stand twice in its segment."""
    h, seeds = w.hashes(), min_words - seed + 1
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, U64, U64, bool))
    fits = T.run_mask(w.first, min_words)
    at = np.flatnonzero(fits)
    if not len(at):
        return empty
    grams = T.run_hashes(h, seed)
    least = _sliding(grams, seeds, True)
    owner = least[at]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(at)])
    first = at[begin]
    # Places that own a window: the greatest owner among the windows around equals the place's own hash.
    valid = np.where(fits, least, U64(0))
    padded = np.concatenate([np.zeros(seeds - 1, dtype=U64), valid, np.zeros(seeds - 1, dtype=U64)])
    owning = grams[_sliding(padded, seeds, False) == grams]
    twice = owning[1:][owning[1:] == owning[:-1]]
    again = np.isin(owner[begin], twice) if len(twice) else np.zeros(len(begin), dtype=bool)
    return first, count, owner[begin], T.span_hashes(h, first, first + count + min_words - 1), again | (count > seeds)


def _doc_of(w: T.Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, side="right") - 1


def _segments(min_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in T.word_chunks(batch.column("text")):
                first, count, owner, content, again = segments_of(w, min_words, seed)
                doc = _doc_of(w, first)
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("crc").take(rows), pa.array(owner.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first - w.first[doc]).astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(again)], ["id", "crc", "owner", "content", "first", "count", "again"])

    return run


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("open")
            cuts, flat = lists.offsets.to_numpy(), lists.flatten()
            firsts, counts, owners = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            cuts = cuts - cuts[0]
            for a, b, w in T.word_chunks(batch.column("text")):
                span = slice(cuts[a], cuts[b])
                doc = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                count = counts[span]
                start = np.repeat(firsts[span] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum())) if len(count) else count
                of, owner = np.repeat(doc, count), np.repeat(owners[span], count)
                where = start + w.first[of]
                content = T.run_hashes(w.hashes(), min_words)[where] if len(where) else np.zeros(0, dtype=U64)
                rows = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("crc").take(rows), pa.array(owner), pa.array(content.view(np.int64)), pa.array(start.astype(np.int32))],
                                                 ["id", "crc", "owner", "content", "first"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    d = id_and_text(docs, id_col, text_col).withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    return d, d.schema["id"].dataType.simpleString()


def repeated_spans(docs: DataFrame, min_words: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, crc, spans`` for documents that hold repeats: windows that recur, as (first window, windows), sorted.

    ``crc`` is the text's checksum; both together name a document. The words of a span are those from its first window's
    first word to its last window's last.
    """
    d, kind = _keyed(docs, id_col, text_col)
    seed = min(seed, min_words)
    found = d.mapInArrow(_segments(min_words, seed), f"id {kind}, crc long, owner long, content long, first int, count int, again boolean")
    owners = materialize(found.groupBy("owner").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1").select("owner"), "owners")
    seeds = materialize(found.join(owners, "owner"), "seeds")
    classes = seeds.groupBy("owner", "content").agg(F.count("*").alias("members"), F.max("again").alias("loops"), F.min(F.struct("id", "crc", "first")).alias("chosen"))
    many = classes.groupBy("owner").agg(F.count("*").alias("classes"))
    classes = materialize(classes.join(many, "owner").select("owner", "content", "members", "chosen", ((F.col("classes") > 1) | F.col("loops")).alias("open")), "classes")
    me = F.struct("id", "crc", "first")
    state = seeds.join(classes, ["owner", "content"])
    opened = F.col("open") & ((F.col("members") == 1) | me.eqNullSafe(F.col("chosen")))
    per_doc = materialize(state.where(opened | (F.col("members") > 1)).groupBy("id", "crc").agg(
        F.collect_set(F.when(F.col("members") > 1, F.struct("first", "count"))).alias("whole"), F.collect_set(F.when(opened, F.struct("first", "count", "owner"))).alias("open")), "marks")
    asked = per_doc.where(F.size("open") > 0).select(F.col("id").alias("i"), F.col("crc").alias("c"), "open")
    texts = d.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("crc") == F.col("c"))).select("id", "crc", "text", "open")
    windows = materialize(texts.mapInArrow(_windows(min_words), f"id {kind}, crc long, owner long, content long, first int"), "windows")
    shared = materialize(windows.groupBy("owner", "content").agg(F.count("*").alias("n")).where("n > 1").select("owner", "content"), "shared")
    single = windows.join(shared, ["owner", "content"]).select("id", "crc", "first", F.lit(1).alias("count"))
    whole = per_doc.select("id", "crc", F.inline("whole"))
    return whole.unionByName(single).groupBy("id", "crc").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("spans"))


def _cut_texts(min_words: int):
    """Words, words removed and the others, joined by a space, for texts and their lists of spans."""
    def run(texts: list[str | None], spans: pa.Array) -> Iterator[tuple[int, int, bytes]]:
        flat, sizes = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
        firsts, counts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        ends = np.cumsum(sizes)
        for text, stop, size in zip(texts, ends.tolist(), sizes.tolist(), strict=True):
            words = (text or "").encode().split()  # of bytes: at ASCII white space only
            n = len(words)
            if size:
                first, count = firsts[stop - size : stop], counts[stop - size : stop]
                edge = np.bincount(first, minlength=n + 1) - np.bincount(first + count + min_words - 1, minlength=n + 1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
            yield n, n - len(words), b" ".join(words)

    return run


def _cut(min_words: int):
    cut = _cut_texts(min_words)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = zip(*cut(batch.column("text").to_pylist(), batch.column("spans")), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("crc"), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(kept, type=pa.binary()).cast(pa.string())],
                                          ["id", "crc", "n_words", "n_removed", "kept"])

    return each_batch(one)


def documents_without_repeats(docs: DataFrame, min_words: int, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs``; a text that holds repeats becomes its other words, joined by one space, and ``n_chars`` follows."""
    spans = repeated_spans(docs, min_words, seed).select(F.col("id").alias("__id"), F.col("crc").alias("__crc"), F.col("spans").alias("__spans"))
    own = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    both = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__crc")), "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__spans")
    cut = _cut_texts(min_words)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        kept = [k.decode() if removed else t for t, (_, removed, k) in zip(texts, cut(texts, batch.column(batch.num_columns - 1)), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(kept, type=batch.schema.field(at).type))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)
    out = both.mapInArrow(each_batch(one), kinds)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeats(docs: DataFrame, min_words: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, crc, n_words, n_removed, kept``: the words outside all repeats, joined by one space, for every row of ``docs``."""
    d, kind = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, min_words, seed, id_col, text_col).select(F.col("id").alias("i"), F.col("crc").alias("c"), "spans")
    both = d.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("crc") == F.col("c")), "left").select("id", "crc", "text", "spans")
    return both.mapInArrow(_cut(min_words), f"id {kind}, crc long, n_words long, n_removed long, kept string")
