"""Words and hashes of whole texts, vectorised over the bytes of an Arrow batch.

A hash of a piece takes eight bytes at a time through a bijective mixing, so pieces of up to eight bytes have different
hashes and longer ones meet by chance only; pieces beyond ``LONG`` bytes, which are few, are digested one by one. Runs of words
are hashed by halves: a run of 2n words from its two runs of n, any other length from the powers of two it consists of. No
step is linear in the bytes, so no pattern of letters or words makes different texts meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
LONG = 64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)  # the lowest n bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# ASCII white space: space and U+0009 to U+000D.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[32, *range(9, 14)]] = True
WORD_BYTES = ~SPACE_BYTES


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective mixing of 64-bit integers."""
    z = x + U64((seed * _BASE + _STEP) & (2**64 - 1))
    z ^= z >> U64(30)
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


@dataclass
class Words:
    """The words of some whole documents: byte spans, and the first word of each document (one entry more than documents)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash for each word; A-Z count as a-z where ``lower``."""
        return piece_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends, 7)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash for each span of bytes; other seeds are independent of each other."""
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(U64), seed)
    if not len(out):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    short, at = np.flatnonzero(length <= LONG), 0
    while len(short):
        left = length[short] - at
        block = eights[starts[short] + np.minimum(at, length[short])]
        block &= _FIRST[np.minimum(left, 8)]
        out[short] = mix(out[short] ^ block, seed)
        short = short[left > 8]
        at += 8
    long = np.flatnonzero(length > LONG)
    if len(long):
        key, raw = seed.to_bytes(8, "little"), data.tobytes()
        out[long] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), dtype="<u8")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(_BASE) + right)


def run_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``k`` consecutive words of the array, runs over document borders included."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    power, size, out, done = words, 1, None, 0
    while True:
        if k & size:
            part = power[done : done + n]
            out, done = (part if out is None else _joined(out, part)), done + size
        if done == k:
            return mix(out, seed + k)
        power, size = _joined(power[:-size], power[size:]), 2 * size


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run of words ``starts[i]:ends[i]``, its length included."""
    length, at = ends - starts, starts.copy()
    out, power, size, longest = mix(length.astype(U64), 11), words, 1, int(length.max(initial=0))
    while size <= longest:
        some = np.flatnonzero(length & size)
        out[some] = _joined(out[some], power[at[some]])
        at[some] += size
        if 2 * size <= longest:
            power = _joined(power[:-size], power[size:])
        size *= 2
    return out


def run_mask(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``run_hashes`` lie within one document."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, dtype=bool)
    ok = np.zeros(n + 1, dtype=np.int32)
    counts = np.diff(first)
    long = counts >= k
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[:-1][long] + counts[long] - k + 1, -1)
    return np.cumsum(ok)[: n - k + 1].astype(bool)


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets; null counts as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        width = np.int32
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=width, count=len(texts) + 1, offset=texts.offset * np.dtype(width).itemsize).astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def word_chunks(texts: pa.Array, word_bytes: np.ndarray = WORD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of whole documents of about ``chunk_bytes``."""
    data, offsets = bounds(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        stop = min(stop, n)
        part, local = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        yield row, stop, words_of(part, local, word_bytes)
        row = stop


def words_of(part: np.ndarray, local: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> Words:
    """Words of the documents ``part[local[i]:local[i + 1]]``."""
    inside = word_bytes[part]
    begins, stops = inside.copy(), inside.copy()
    border = local[1:-1]
    border = border[(border > 0) & (border < len(part))]
    follows = np.zeros(len(part), dtype=bool)
    follows[border] = True
    begins[1:] &= ~inside[:-1] | follows[1:]
    stops[:-1] &= ~inside[1:] | follows[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(part, local, starts, ends, np.searchsorted(starts, local))


def long_arrays(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Lists of 64-bit integers from a flat array and offsets."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))
