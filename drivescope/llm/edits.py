"""How alike a document's fingerprint is to that of its edited text and of the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from drivescope.llm.frames import id_and_text
from drivescope.llm.neighbours import descending_with_guests
from drivescope.llm.simhash import fingerprints, likeness

FIELDS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(ids: list, texts: list[str], nexts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """Results for documents whose next texts are known; ``nexts`` is ``texts`` shifted by one."""
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
    own = fingerprints(pa.array([*texts, nexts[-1]], type=pa.string()))
    other = fingerprints(pa.array(edited, type=pa.string()))
    shown = [[f"{x:016x}" for x in prints.tolist()] for prints in (own[:-1], other)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, type=kind), pa.array([len(t) for t in texts], type=pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), *[pa.array(s) for s in shown],
         pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))], FIELDS)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 1000) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's.

    Edited: the last third (rounded down) of the code points is replaced by as many of the next document's first ones, in
    descending order of ids; after the last document comes the first. One shuffle of the texts, dealt by ranges of ids.
    """
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, arrow = None, [], [], None
        for batch in batches:
            arrow = batch.schema.field("id").type
            columns = (batch.column(c).to_pylist() for c in ("id", "text", "block", "guest"))
            for i, text, b, guest in zip(*columns, strict=True):
                if b != block:
                    block, ids, texts = b, [], []
                if guest:  # the row after the block's last one; further guests share its id
                    if ids:
                        yield _rows(ids, texts, [*texts[1:], text], arrow)
                        ids, texts = [], []
                    continue
                if len(ids) >= rows:
                    yield _rows(ids, texts, [*texts[1:], text], arrow)
                    ids, texts = [], []
                ids.append(i)
                texts.append(text)

    return descending_with_guests(d).mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
