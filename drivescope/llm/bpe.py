"""Byte-pair encoding with word ends, and decoding.

A word starts as a doubly linked list of byte symbols. A priority queue holds the merge rank and place of every neighbouring
pair that can merge; the lowest rank is taken first, the leftmost of equals; an entry whose pair has changed meanwhile is
stale and skipped. Decoding joins the vocabulary's strings, with a space between them since the file names no decoder.

The vocabulary file is a parameter and read on each worker. Words recur, so results are kept in two tables of bounded size,
of which the older one is dropped when the younger is full.

Defined results: null and empty texts have no ids and decode to the empty text; strings of special tokens in a text become
their ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from drivescope.llm.frames import id_and_text


class Recent:
    """A map of bounded size that keeps what was used lately."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def turn(self) -> None:
        self.old, self.young = self.young, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.turn()
        self.young[key] = value


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one after U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Codec:
    """Vocabulary and merges of a tokenizer file of the word-end kind."""

    def __init__(self, path: str, kept: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        symbols = byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + suffix] for s in symbols]
        #: left id, right id in one number -> rank and merged id in one number
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 17 | vocab[right]] = rank << 17 | vocab[left + right]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        self.words, self.chunks = Recent(kept), Recent(kept)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges a word's symbols by rank."""
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [merges.get(ids[i] << 17 | ids[i + 1], -1) for i in range(n - 1)]
        now.append(-1)
        queue = [(found >> 17) << 32 | i for i, found in enumerate(now) if found >= 0]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            found = now[i]
            if found < 0 or found >> 17 != entry >> 32:
                continue  # stale
            gone = after[i]
            ids[i], ids[gone], now[gone] = found & 0x1FFFF, -1, -1
            right, left = after[gone], before[i]
            after[i] = right
            if right < n:
                before[right] = i
                now[i] = found = merges.get(ids[i] << 17 | ids[right], -1)
                if found >= 0:
                    heapq.heappush(queue, (found >> 17) << 32 | i)
            else:
                now[i] = -1
            if left >= 0:
                now[left] = found = merges.get(ids[left] << 17 | ids[i], -1)
                if found >= 0:
                    heapq.heappush(queue, (found >> 17) << 32 | left)
        return [i for i in ids if i >= 0]

    def word(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self.merge(ids)

    def chunk(self, chunk: str) -> np.ndarray:
        """Ids of a stretch without white space."""
        ids: list[int] = []
        for part in self.split_special(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # Each character by itself: the lower-case sigma at a word's end stays the common one.
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            for piece in self.pieces(part):
                found = self.words.young.get(piece)
                if found is None:
                    found = self.words.old.get(piece) or self.word(piece)
                    self.words.put(piece, found)
                ids += found
        return np.array(ids, dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        # Characters that split() takes for white space although the file's pattern does not.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = [c for c in regex.split(r"[\t-\r \x85\xa0  -     　]+", text) if c]
        else:
            chunks = text.split()
        young, old = self.chunks.young, self.chunks.old
        out = []
        for c in chunks:
            found = young.get(c)
            if found is None:
                found = old.get(c)
                if found is None:
                    found = self.chunk(c).tobytes()
                self.chunks.put(c, found)
                young, old = self.chunks.young, self.chunks.old
            out.append(found)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this process; Spark keeps workers, so the tables of recent words outlive a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _run(path: str, decode: bool, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [own.encode(t) for t in part.column("text").to_pylist()]
                cuts = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                out = [part.column("id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids])))]
                if decode:
                    out.append(pa.array([own.decode(i) for i in ids], type=pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, rows: int = 256) -> DataFrame:
    """``id, ids`` of every whole text, and with ``decode`` the text ``decoded`` from the ids; one pass, no shuffle."""
    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(_run(path, decode, rows), f"id {d.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode)


def bpe_decode(encoded: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """``id, decoded`` from ``id, ids``; null counts as no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [own.decode(np.array(i or [], dtype=np.int64)) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, type=pa.string())], ["id", "decoded"])

    e = encoded.select("id", "ids")
    return e.mapInArrow(run, f"id {e.schema['id'].dataType.simpleString()}, decoded string")
