"""Registered queries over a small folder of tables, their digest columns against libraries and brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drivescope.llm import queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = np.random.default_rng(8)
    words = ["data", "Signal", "été", "中文", "x1", "--", "...", "MIT", "license", "GNU", "general", "public", "Apache", "12", "\U0001f600", "a" * 900, "naïve y"]
    made = [" ".join(rng.choice(words, size=int(n))) for n in rng.integers(1, 60, size=70)]
    return [None, "", " \t\n", "1 2 3 4 5 6", "the MIT license, the GNU General Public License and CC-BY", made[0], made[0], *made]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    all_texts = texts()
    ids = [(i * 37) % 1009 for i in range(len(all_texts))]
    sources = [None if i % 11 == 0 else "tiny" if i == 9 else f"s{i % 3}" if i % 2 else "hot" for i in range(len(all_texts))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(all_texts, pa.string()), "lang": ["en"] * len(ids), "source": pa.array(sources, pa.string()),
                             "n_chars": pa.array([len(t or "") for t in all_texts], pa.int64())}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([int(len(t or "") > 200) for t in all_texts], pa.int64())}), at / "labels.parquet")
    return str(at), list(zip(ids, all_texts, sources, strict=True))


def rows(spark, folder, query):
    return {r.doc_id: r for r in query(spark, folder[0]).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, folder):
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation()
    tok.no_padding()
    got = rows(spark, folder, queries.op1_bpe)
    assert len(got) == len(folder[1])
    for i, text, _ in folder[1]:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op2(spark, folder):
    got = rows(spark, folder, queries.op2_quality)
    assert set(got) == {i for i, _, _ in folder[1]}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op7(spark, folder):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.no_truncation()
    tok.no_padding()
    got, start = rows(spark, folder, queries.op7_id_files), 0
    for i, text, _ in sorted(folder[1], key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_op9(spark, folder):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = rows(spark, folder, queries.op9_license_scan)
    for i, text, _ in folder[1]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((p, label) for phrase, label in phrases.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (got[i].first_word, got[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None)) and {x for _, x in at} <= set(got[i].labels.split(","))


def filled(sizes, weights):
    """Shares by weight; sources above three times their size stop there, the rest is shared again."""
    target, whole = {}, sum(sizes.values())
    while True:
        left, open_ = whole - sum(target.values()), [s for s in sizes if s not in target]
        parts = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if parts[s] >= 3 * sizes[s]]
        if not above:
            return target | parts
        target |= {s: 3.0 * sizes[s] for s in above}


def test_op10_draws_the_documents_of_the_smallest_keys(spark, folder):
    got = rows(spark, folder, queries.op10_mix)
    size = {i: len(SPACE.findall(t or "")) for i, t, _ in folder[1]}
    names = sorted({s for _, _, s in folder[1] if s is not None}) + [None]
    total = {s: sum(size[i] for i, _, x in folder[1] if x == s) for s in names}
    target = filled(total, {s: n % 3 + 1 for n, s in enumerate(names)})
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in folder[1]}
    drawn = spark.createDataFrame(list(crc.items()), "id long, crc long").select("id", F.xxhash64(F.lit(11), "id", "crc").alias("h")).collect()
    drawn = {r.id: (r.h % (1 << 52) + 0.5) / (1 << 52) for r in drawn}
    key = {}
    for i, text, _ in folder[1]:
        raw = b"".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
        letters = sum(b >= 128 or chr(b).isalpha() for b in raw)
        key[i] = -math.log(drawn[i]) / max(0.05, letters / max(1, len(raw)))
    for s in names:
        mine = sorted((i for i, _, x in folder[1] if x == s), key=lambda i: (key[i], i))
        epochs = math.floor(target[s] / max(1, total[s]))
        left = math.floor(target[s] - epochs * total[s] + 0.5)
        for i in mine:
            more = max(0, min(size[i], left))
            left -= more
            assert (got[i].size, got[i].source_size, got[i].taken) == (size[i], total[s], epochs * size[i] + more), (s, i)
            assert got[i].target == pytest.approx(target[s])
    assert any(0 < got[i].taken % max(1, size[i]) for i in size) and len({r.taken // max(1, r.size) for r in got.values() if r.size}) > 1
