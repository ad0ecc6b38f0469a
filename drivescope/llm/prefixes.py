"""Token counts at every prefix of a text, without encoding any prefix.

The counts are those of a BPE piece model, which merges the pair of neighbours with the best score, the leftmost of equals.
Two facts make them a dynamic program over prefixes. A list of pieces is the encoding of its joined text exactly if each two
neighbours are the encoding of theirs, since merges on one side of a border don't depend on the other side until something
crosses the border. Hence the encoding of a prefix is that of a shorter prefix and one more piece, and exactly one piece that
ends there fits behind the shorter prefix's last piece. So ``count[i] = count[i - len(piece)] + 1``, with one step a position.

No piece holds a mark of a space behind another character, so texts fall apart into chunks: spaces and the word after them.
A chunk's counts are computed once and kept in a bounded table; the counts of a text are its chunks' counts on top of the
totals of the chunks ahead. A prefix's count, the cut at a budget and the total are then look-ups.

Defined results: a null text counts as empty, which has no tokens; rows with equal ids or texts stay apart; a null id stays
null; an empty table gives an empty table; a text may be one word of any length.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivescope.llm.frames import id_and_text
from drivescope.llm.text import bounds

SPACE = "▁"  # the mark that stands for a space in pieces
KEPT_CHARS, KEPT_WORD, KEPT_PAIRS = 1 << 22, 256, 1 << 19  # sizes of the tables in a worker
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_COUNT = np.dtype("<u4")


def _read_model(path: str) -> dict[str, float]:
    """Score by piece; other kinds of models are refused, since their counts would be wrong."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, kinds = proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
    if not plain or not bpe or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: not a BPE model with byte fallback, plain normalisation and ordinary pieces")
    scores = {p.piece: p.score for p in model.pieces if p.type == normal}
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError(f"{path}: a piece reaches over a space")
    return scores


class _Chunks(dict):
    """Counts at the prefixes of chunks: a recent and an older table of bounded size, so that frequent chunks stay."""

    def __init__(self, compute: Callable[[str], bytes]):
        self.compute, self.older, self.held = compute, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        counts = self.older.get(chunk)
        if counts is None:
            counts = self.compute(chunk)
        if len(chunk) <= KEPT_WORD:
            if self.held > KEPT_CHARS:
                self.older, self.held = dict(self), 0
                self.clear()
            self[chunk] = counts
            self.held += len(chunk) + 8
        return counts


class PrefixTable:
    """Counts of tokens at the prefixes of texts, for one model."""

    def __init__(self, path: str):
        self.scores = _read_model(path)
        self.pieces = ["", *self.scores]  # number 0: a text's beginning, or an unknown character
        self.places = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces[1:], 1):
            self.places.add_word(piece, (number, len(piece)))
        self.places.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks = _Chunks(lambda chunk: np.array(self.chunk_counts(chunk), dtype=_COUNT).tobytes())

    def merged(self, text: str) -> list[str]:
        """Encoding of a short string by its definition."""
        parts = list(text)
        scored = [self.scores.get(a + b, -math.inf) for a, b in itertools.pairwise(parts)]
        while scored and (best := max(scored)) > -math.inf:
            at = scored.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scored[at]
            for i in (at - 1, at):
                if 0 <= i < len(scored):
                    scored[i] = self.scores.get(parts[i] + parts[i + 1], -math.inf)
        return parts

    def fits(self, before: int, number: int) -> bool:
        """Whether a piece can follow the piece ``before`` (0: begin a run) in an encoding."""
        left, right = self.pieces[before], self.pieces[number]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[before, number] = self.merged(left + right) == ([left, right] if before else [right])
        return known

    def chunk_counts(self, chunk: str) -> list[int]:
        """The dynamic program over a chunk, from the prefix of one character on."""
        last, counts, at, pairs = [0], [0], 0, self.pairs

        def unknown(until: int) -> None:
            for c in chunk[at:until]:  # unknown characters become bytes and join nothing
                last.append(0)
                counts.append(counts[-1] + len(c.encode()))

        for end, (number, size) in self.places.iter(chunk):
            if end < at:
                continue  # the piece that ends here is known
            if end > at:
                unknown(end)
                at = end
            start = end + 1 - size
            fits = pairs.get((last[start], number))
            if fits is None:
                fits = self.fits(last[start], number)
            if fits:
                last.append(number)
                counts.append(counts[start] + 1)
                at += 1
        unknown(len(chunk))
        return counts[1:]

    def counts(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of ``text[:i]``, for i from 0 to its number of code points."""
        chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE))  # the library begins every text with a space
        flat = np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), dtype=_COUNT).astype(np.int64)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        totals = flat[np.cumsum(sizes) - 1]
        flat += np.repeat(np.cumsum(totals) - totals, sizes)
        flat[0] = 0  # the empty prefix, without that space
        return flat


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens; counts may fall again from a prefix to a longer one."""
    return int(np.flatnonzero(counts <= budget)[-1])


@functools.lru_cache(maxsize=1)
def _table(path: str) -> PrefixTable:
    """A worker's table, which its next tasks find filled."""
    return PrefixTable(path)


def _index(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            for i, text in enumerate(batch.column("text")):  # a batch for each text, since its counts are larger than the text
                counts = table.counts(text.as_py()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(counts)], type=pa.int32()), pa.array(counts))], ["id", "counts"])

    return run


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, counts``: tokens of each text's first 0, 1, 2, ... code points, an entry each; ask it with the functions below."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_index(model_path), f"id {rows.schema['id'].dataType.simpleString()}, counts array<int>")


def tokens_within(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points (all, if there are fewer)."""
    at = F.least(chars if isinstance(chars, Column) else F.lit(chars), F.size(counts) - 1)
    return F.get(counts, at.cast("int"))


def chars_within(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return (F.size(counts) - F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), F.lit(True))).cast("long")


def _counted(path: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            texts = batch.column("text")
            tokens, chars, kept = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for i, text in enumerate(texts):
                counts = table.counts(text.as_py())
                tokens[i], chars[i] = counts[-1], len(counts) - 1
                kept[i] = chars[i] if tokens[i] <= budget else longest_prefix(counts, budget)
            size = np.diff(bounds(texts)[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in (size, chars, tokens, kept)]], ["id", "n_bytes", "n_chars", "n_tokens", "kept_chars"])

    return run


def count_tokens(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_chars, n_tokens, kept_chars``: the last entry of each text's prefix counts, and where ``budget`` tokens end.

    ``kept_chars`` is the longest prefix, in code points, of at most ``budget`` tokens. The counts stay inside the tasks.
    """
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_counted(model_path, budget), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_chars long, n_tokens long, kept_chars long")
