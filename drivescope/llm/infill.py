"""Fill-in-the-middle: documents cut at two places and put together in another order.

Texts are cut at units (white space and the word after it) found in the bytes. Between bytes and code points a sparse index
translates: it records only the multibyte characters, each one's place and the bytes it takes beyond one, summed up. A cut is
translated by a binary search among them; between two of them, and so in ASCII text everywhere, translation is a subtraction.

Defined results: a null text counts as empty; an empty text and one that contains a marker stay plain; a null id draws like an
empty one; equal ids draw alike, and rows with equal ids or texts stay apart; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.llm.frames import id_and_text
from drivescope.llm.text import SPACE_BYTES, Words, word_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # no marker ends as another begins, so none can arise where pieces meet


class SparseIndex:
    """The multibyte characters of some UTF-8 bytes: byte place, code-point place, excess bytes of those ahead."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.zeros(len(lead) + 1, dtype=np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points ahead of byte cuts that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.bytes, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes ahead of code-point cuts."""
        return cuts + self.excess[np.searchsorted(self.chars, cuts)]


@dataclass
class Units:
    """The units of some documents: each is white space with the word after it, or the white space at the text's end."""

    words: Words

    def __post_init__(self) -> None:
        w = self.words
        self.begin, self.end = w.offsets[:-1], w.offsets[1:]
        tail = np.zeros(len(self.begin), dtype=bool)
        filled = self.end > self.begin
        tail[filled] = SPACE_BYTES[w.data[self.end[filled] - 1]]
        self.n_words = w.counts()
        self.n = self.n_words + tail

    def after(self, units: np.ndarray) -> np.ndarray:
        """The byte where the first ``units`` units of each document end."""
        out = np.where(units > self.n_words, self.end, self.begin)
        inside = (units > 0) & (units <= self.n_words)
        out[inside] = self.words.ends[self.words.first[:-1][inside] + units[inside] - 1]
        return out


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 for each id, the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _arrange(rate: int, spm_share: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def rows(batch: pa.RecordBatch, low: int, words: Words) -> pa.RecordBatch:
        units = Units(words)
        count = len(units.n)
        h1, h2, h3, h4 = (batch.column(f"h{i}").slice(low, count).to_numpy() for i in range(1, 5))
        one, two = h1 % (units.n + 1), h2 % (units.n + 1)
        first, second = units.after(np.minimum(one, two)), units.after(np.maximum(one, two))
        index = SparseIndex(words.data)
        start, a, b = (index.to_chars(c) for c in (units.begin, first, second))
        raw = words.data.tobytes()
        forms, outputs = [], []
        for i in range(count):
            lo, x, y, hi = int(units.begin[i]), int(first[i]), int(second[i]), int(units.end[i])
            text = raw[lo:hi]
            if not text or h3[i] % 100 >= rate or any(mark in text for mark in marks):
                forms.append("plain")
                outputs.append(text)
            elif h4[i] % 100 < spm_share:
                forms.append("spm")
                outputs.append(b"".join((s, raw[y:hi], p, raw[lo:x], m, raw[x:y])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, raw[lo:x], s, raw[y:hi], m, raw[x:y])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").slice(low, count), pa.array(units.n), pa.array(forms, type=pa.string()), pa.array(a - start, mask=plain), pa.array(b - a, mask=plain),
             pa.array(outputs, type=pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, words in word_chunks(batch.column("text")):
                yield rows(batch, low, words)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every whole text.

    ``rate`` percent of the texts are rearranged, ``spm_share`` percent of those with the suffix first; ``n`` counts the units,
    and the code points of prefix and middle are null for plain texts.
    """
    rows = id_and_text(docs, id_col, text_col).select("id", "text", *draws(F.col("id"), seed))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_arrange(rate, spm_share), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, by its markers alone."""
    def between(left: str, right: str | None) -> Column:
        start = F.instr(output, left) + len(left)
        return output.substr(start, F.instr(output, right) - start if right else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
