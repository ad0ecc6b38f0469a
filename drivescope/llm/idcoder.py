"""Token-id files: blocks of ids under an adaptive context-mixing range coder.

A block holds whole documents: its header, a table of document ids and lengths, and the coded ids; it can be read alone, since
the model starts anew in each block, and carries a checksum of its content. The ids of a block are cut into lanes of equal
length that are coded side by side, one id of each lane in a step, so that a step is a few array operations.

The model predicts an id from the two before it in the lane (order 2), from the one before (order 1), and by counts of the
ids so far (order 0). Orders 1 and 2 name one id each with a confidence; counts of hits by pair of confidences mix the three
into intervals: the id of order 2, that of order 1, or an escape followed by the order-0 interval. A 64-bit range coder
without carries writes 32-bit words. The model learns after every step from all lanes, in the decoder as in the encoder.

Files are Parquet tables of such blocks, one file for a range of document ids, so any store that Spark writes to holds them.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.frames import id_and_text
from drivescope.llm.neighbours import in_blocks

U64 = np.uint64
MAGIC, VERSION = b"DIDC", 2
HEADER = struct.Struct("<4sBIIIHI")  # magic, version, documents, ids, vocabulary, lanes, checksum of what follows
NO_ID = -(2**63)  # stands for a null id
BLOCK_IDS, MAX_LANES, STEPS = 1 << 20, 4096, 64
_PARTS, _LEAST = 12, 16  # flags share 2**12 parts, 16 at least each
_HASH_BITS, _TRUST = 18, 3
_TOP = (1 << _TRUST) - 1
_GAIN, _ROUND = 24, 16
_WORD = U64(32)
_LOW = U64(0xFFFFFFFF)


class Model:
    """Predictions for one id of each lane, and what they learn."""

    def __init__(self, lanes: int, vocabulary: int):
        self.counts = np.ones(vocabulary, dtype=U64)
        self.below = np.arange(vocabulary + 1, dtype=U64)
        self.missed: list[np.ndarray] = []
        # An id and a confidence in one number for each context; none at first.
        self.after_1 = np.full(vocabulary + 1, -1 << _TRUST, dtype=np.int32)
        self.after_2 = np.full(1 << _HASH_BITS, -1 << _TRUST, dtype=np.int32)
        self.flags = np.tile(np.array([2, 1, 3], dtype=np.int64), (2 << 2 * _TRUST, 1))
        self.previous = np.full(lanes, vocabulary, dtype=np.int64)
        self.turned = self.previous * 0x9E3779B1
        self.step = 0

    def predict(self) -> None:
        """Ids ``two`` and ``one`` of order 2 and 1, and ``borders``: four for each flag context ``at``, in parts."""
        self.slot = ((self.previous * 0x2545F491 + self.turned) >> 7) & ((1 << _HASH_BITS) - 1)
        self.held_2, self.held_1 = self.after_2[self.slot], self.after_1[self.previous]
        self.two, self.one = self.held_2 >> _TRUST, self.held_1 >> _TRUST
        self.context = (((self.held_2 & _TOP) << _TRUST | (self.held_1 & _TOP)) << 1) + (self.two == self.one)
        parts = _LEAST + self.flags * ((1 << _PARTS) - 3 * _LEAST) // self.flags.sum(axis=1, keepdims=True)
        borders = np.zeros((len(parts), 4), dtype=U64)
        borders[:, 1], borders[:, 2], borders[:, 3] = parts[:, 0], parts[:, 0] + parts[:, 1], 1 << _PARTS
        self.borders, self.at = borders.reshape(-1), self.context << 2

    def narrow(self, low: np.ndarray, span: np.ndarray, part: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a flag."""
        at = self.at + kind
        begin = self.borders[at]
        return low + part * begin, part * (self.borders[at + 1] - begin)

    def learn(self, ids: np.ndarray, kind: np.ndarray, escaped: np.ndarray) -> None:
        """``kind``: 0 and 1 where order 2 or 1 was right, else 2."""
        self.flags += 2 * np.bincount(self.context * 3 + kind, minlength=self.flags.size).reshape(self.flags.shape)
        if self.step % 64 == 0 and self.flags.max() > 1 << 20:
            self.flags = (self.flags >> 1) + 1
        new = ids << _TRUST | 1
        for table, at, held, guess in ((self.after_2, self.slot, self.held_2, self.two), (self.after_1, self.previous, self.held_1, self.one)):
            trust = held & _TOP
            worse = held - trust + (trust >> 1)  # half the confidence; at none the new id takes the place
            table[at] = np.where(guess == ids, held + (trust < _TOP), np.where(trust > 1, worse, new))
        self.missed.append(ids[escaped])
        self.step += 1
        if self.step % _ROUND == 0 or self.step < _ROUND:
            missed = np.concatenate(self.missed)
            self.missed = []
            self.counts += U64(_GAIN) * np.bincount(missed, minlength=len(self.counts)).astype(U64)
            if int(self.below[-1]) + _GAIN * len(missed) > 1 << 23:
                self.counts = (self.counts + U64(1)) >> U64(1)
            np.cumsum(self.counts, out=self.below[1:])
        self.turned = self.previous * 0x9E3779B1
        self.previous = ids.astype(np.int64)


def _lanes(n: int) -> int:
    return max(1, min(MAX_LANES, n // STEPS))


def encode_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    """Coded words of the lanes: word counts, then the words of each lane."""
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, low, span = Model(lanes, vocabulary), np.zeros(lanes, dtype=U64), np.full(lanes, 2**64 - 1, dtype=U64)
    words, who = [], []
    for t in range(steps):
        x = grid[t]
        model.predict()
        kind = np.where(x == model.two, 0, 2 - (x == model.one))
        low, span = model.narrow(low, span, span >> U64(_PARTS), kind)
        escaped = np.flatnonzero(kind == 2)
        if len(escaped):
            v, inner = x[escaped], span[escaped] // model.below[-1]
            low[escaped] += inner * model.below[v]
            span[escaped] = inner * model.counts[v]
        low, span, out = _settle(low, span)
        if len(out):
            words.append((low[out] >> _WORD).astype(np.uint32))
            who.append(out)
            low[out] <<= _WORD
            span[out] <<= _WORD
        model.learn(x, kind, escaped)
    for _ in range(2):  # the last words of each lane
        words.append((low >> _WORD).astype(np.uint32))
        who.append(np.arange(lanes))
        low = low << _WORD
    lane = np.concatenate(who)
    order = np.argsort(lane, kind="stable")
    return np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + np.concatenate(words)[order].astype("<u4").tobytes()


def _settle(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes whose upper word stands firm; a narrow span across a border is shortened to its nearer side first."""
    small = span <= _LOW
    firm = ((low ^ (low + span)) >> _WORD) == 0
    cut = small & ~firm
    if cut.any():
        span = np.where(cut, (U64(0) - low) & _LOW, span)
    return low, span, np.flatnonzero(firm | small)


def decode_ids(data: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ``n`` ids of ``encode_ids``."""
    lanes = _lanes(n)
    steps = -(-n // lanes)
    counts = np.frombuffer(data, dtype="<u4", count=lanes).astype(np.int64)
    words = np.r_[np.frombuffer(data, dtype="<u4", offset=4 * lanes).astype(U64), U64(0)]
    at = np.cumsum(counts) - counts
    model, low, span = Model(lanes, vocabulary), np.zeros(lanes, dtype=U64), np.full(lanes, 2**64 - 1, dtype=U64)
    code = (words[at] << _WORD) | words[at + 1]
    at = at + 2
    grid = np.empty((steps, lanes), dtype=np.int32)
    for t in range(steps):
        model.predict()
        part = span >> U64(_PARTS)
        place = (code - low) // part
        kind = (place >= model.borders[model.at + 1]).astype(np.int64) + (place >= model.borders[model.at + 2])
        low, span = model.narrow(low, span, part, kind)
        x = np.where(kind == 0, model.two, model.one)
        escaped = np.flatnonzero(kind == 2)
        if len(escaped):
            total = model.below[-1]
            inner = span[escaped] // total
            value = np.minimum((code[escaped] - low[escaped]) // inner, total - U64(1))
            order = np.argsort(value)  # sorted needles search faster
            v = np.empty(len(value), dtype=np.int64)
            v[order] = np.searchsorted(model.below, value[order], side="right") - 1
            low[escaped] += inner * model.below[v]
            span[escaped] = inner * model.counts[v]
            x[escaped] = v
        low, span, out = _settle(low, span)
        if len(out):
            low[out] <<= _WORD
            span[out] <<= _WORD
            code[out] = (code[out] << _WORD) | words[np.minimum(at[out], len(words) - 1)]
            at[out] += 1
        grid[t] = x
        model.learn(x, kind, escaped)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def pack_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: header, documents, ids. Document ids are stored as differences."""
    body = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    body = struct.pack("<I", len(body)) + body + (encode_ids(ids, vocabulary) if len(ids) else b"")
    return HEADER.pack(MAGIC, VERSION, len(doc_ids), len(ids), vocabulary, _lanes(len(ids)), zlib.crc32(body)) + body


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block; a wrong checksum raises."""
    magic, version, docs, n, vocabulary, _, checksum = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != checksum:
        raise ValueError("not a block of ids, or a damaged one")
    size = struct.unpack_from("<I", body)[0]
    table = zlib.decompress(body[4 : 4 + size])
    doc_ids = np.cumsum(np.frombuffer(table, dtype="<i8", count=docs))
    lengths = np.frombuffer(table, dtype="<u4", offset=8 * docs).astype(np.int64)
    return doc_ids, lengths, decode_ids(bytes(body[4 + size :]), n, vocabulary) if n else np.zeros(0, dtype=np.int32)


# Bytes of Latin letters: A-Z, a-z, and of two-byte characters from U+00C0 on (two signs among them excepted below).
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
# Bytes with which white space beyond ASCII's usual six begins.
_HINTS = np.zeros(256, dtype=bool)
_HINTS[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Tokens:
    """Ids of whole texts by the tokenizers library, which sees each stretch of a text once while it is remembered.

    The file's pattern never joins characters across the borders of stretches, so their ids in a row are the text's ids. A
    stretch is what stands between white space, with one space before it, cut once where Latin letters end at an ASCII sign or
    digit; a run of white space is a stretch without its last character, which is the next one's space or stands alone.
    Texts with a special token's string or with white space beyond ASCII go to the library whole.

    Stretches are known by a 128-bit hash in a table of fixed size; their ids lie in one array, which is dropped together
    with the table when it is full.
    """

    def __init__(self, path: str, slots: int = 1 << 21, kept_ids: int = 1 << 23):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.slots, self.kept_ids = slots, kept_ids
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((self.slots, 2), dtype=U64)
        self.place, self.length = np.zeros(self.slots, dtype=np.int64), np.full(self.slots, -1, dtype=np.int32)
        self.ids, self.used = np.zeros(self.kept_ids, dtype=np.int32), 0

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and how many each has."""
        lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum())), sizes

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans of the stretches of documents ``data[offsets[i]:offsets[i + 1]]``, and each document's first one."""
        w = T.words_of(data, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), w.counts())
        before = np.r_[np.int64(0), w.ends[:-1]][: len(w.starts)]  # where the white space ahead begins
        before = np.maximum(before, offsets[:-1][doc])
        begin = w.starts - ((w.starts > before) & (data[w.starts - 1] == 32))
        other = ~_LETTERS[data]
        if len(data) > 1:
            other[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
        other = np.r_[np.flatnonzero(other), len(data)]
        stop = other[np.searchsorted(other, w.starts)]
        two = (stop > w.starts) & (stop < w.ends) & (data[np.minimum(stop, max(0, len(data) - 1))] < 128)
        middle = np.where(two, stop, w.ends)
        last = w.starts - 1  # the white space's last character
        alone = (w.starts > before) & (begin == w.starts)
        run = last > before
        tail = np.maximum(np.r_[w.ends, 0][np.maximum(w.first[1:] - 1, 0)], offsets[:-1])
        tail = np.where(w.counts() > 0, tail, offsets[:-1])
        rest = offsets[1:] > tail
        starts = np.concatenate([begin, stop[two], before[run], last[alone], tail[rest]])
        ends = np.concatenate([middle, w.ends[two], last[run], w.starts[alone], offsets[1:][rest]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        return starts, ends, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        strings = texts.to_pylist()
        data, offsets = T.bounds(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends, first = self.stretches(data, offsets)
        keys = np.stack([T.piece_hashes(data, starts, ends, seed) for seed in (61, 62)], axis=1)
        slot = (keys[:, 0] & U64(self.slots - 1)).astype(np.int64)
        held = self.keys[slot]
        known = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1]) & (self.length[slot] >= 0)
        place, length = self.place[slot], self.length[slot].astype(np.int64)
        gaps = np.flatnonzero(~known)
        if len(gaps):
            _, chosen, back = np.unique(keys[gaps, 0], return_index=True, return_inverse=True)
            chosen = gaps[chosen]
            raw = data.tobytes()
            fresh, sizes = self.whole([raw[a:b].decode() for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)])
            total = len(fresh)
            if self.used + total > len(self.ids):
                held = self.ids
                self._forget()
                if total > len(self.ids):
                    self.ids = np.zeros(total, dtype=np.int32)
                hits = np.flatnonzero(known)  # what was known stays readable for this batch
                place[hits] += total
                pool = np.concatenate([np.zeros(total, dtype=np.int32), held])
            else:
                pool = self.ids
            at = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + total] = fresh
            pool[self.used : self.used + total] = fresh
            self.used += total
            self.keys[slot[chosen]], self.place[slot[chosen]], self.length[slot[chosen]] = keys[chosen], at, sizes
            place[gaps], length[gaps] = at[back], sizes[back]
        else:
            pool = self.ids
        ahead = np.r_[0, np.cumsum(length)]
        flat = pool[np.repeat(place - ahead[:-1], length) + np.arange(ahead[-1])]
        cuts = ahead[first].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        hinted = np.diff(np.searchsorted(np.flatnonzero(_HINTS[data]), offsets)).tolist()
        odd = [i for i, t in enumerate(strings) if (hinted[i] and self.odd(t)) or any(s in t for s in self.special)]
        if odd:
            ids, sizes = self.whole([strings[i] for i in odd])
            for i, part in zip(odd, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = part.tobytes()
        return out


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its cores
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def write_id_files(docs: DataFrame, vocabulary_file: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> None:
    """Writes the ids of all texts, ``end_id`` after each, in ascending order of whole-number ids, rows without id first.

    Null texts count as empty. Rows of one id are ordered by their text's checksum.
    """
    d = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    dealt = in_blocks(d.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))), "id", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = tokens(vocabulary_file), None, 0
        ids: list[int] = []
        coded: list[bytes] = []
        size = 0
        end = np.int32(end_id).tobytes()

        def block() -> pa.RecordBatch:
            payload = pack_block(np.array(ids, dtype=np.int64), np.array([len(c) // 4 for c in coded]), np.frombuffer(b"".join(coded), dtype=np.int32), own.vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([seq], type=pa.int32()), pa.array([size], type=pa.int64()), pa.array([payload], type=pa.binary())],
                                              ["part", "seq", "n_ids", "block"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                for i, got, b in zip(piece.column("id").to_pylist(), own.encode(piece.column("text")), piece.column("block").to_pylist(), strict=True):
                    if ids and (b != part or size >= block_ids):
                        yield block()
                        seq = seq + 1 if b == part else 0
                        ids, coded, size = [], [], 0
                    part = b
                    ids.append(NO_ID if i is None else i)
                    coded.append(got + end)
                    size += len(got) // 4 + 1
        if ids:
            yield block()

    dealt.mapInArrow(run, "part int, seq int, n_ids long, block binary").write.parquet(path)


def read_id_files(spark: SparkSession, path: str, each: Callable[[np.ndarray], int] | None = None, named: str = "ids_crc32") -> DataFrame:
    """``id, start, n_tokens`` and the documents' ``ids`` from the files; with ``each`` a number of the ids, ``named``, in their place."""
    files = spark.read.parquet(path)
    ahead = lambda *by: Window.partitionBy(*by).orderBy("seq" if by else "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range of ids
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead()), F.lit(0)).alias("part_start"))
    places = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(ahead("part")), F.lit(0)).alias("in_part")).join(F.broadcast(parts), F.col("part") == F.col("p"))
    places = places.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("part_start") + F.col("in_part")).alias("start"))
    blocks = files.select("part", "seq", "block").join(places, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("start", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column("start"), batch.column("block"), strict=True):
                doc_ids, lengths, ids = unpack_block(block.as_py())
                cuts = np.r_[0, np.cumsum(lengths)]
                got = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)) if each is None else pa.array([each(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start.as_py() + cuts[:-1]), pa.array(lengths), got], ["id", "start", "n_tokens", "ids" if each is None else named])

    return blocks.mapInArrow(run, "id long, start long, n_tokens long, " + ("ids array<int>" if each is None else f"{named} long"))
