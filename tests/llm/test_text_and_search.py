"""Operators that need no links between documents: encoding, fingerprints, licenses, id files, top-k, shards, mixing, quality."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import make

from drivescope.llm import bitslice, bpe, edits, hilbert, idcoder, licenses, mixing, quality, queries, simhash
from drivescope.llm import text as T

ODD = ["", " ", "\n\t ", "Σας ΟΔΥΣΣΕΥΣ İstanbul don't THE'S", "é ñ é", "<|endoftext|>x<|startoftext|> a <|endoftext|> b", "a\x1cb\u0085 c d e​f", "日本語 ½ ² Ⅷ १२३ 🙂👍🏽",
       "foo_bar__baz 12345 'll'LL", "a" * 3000, "\r\n\t x", "x" + " y z" * 2000, "don't 'S it''s", "lead  tail  ", "word.Word,word;", "Ǆ ẞ K ﻿", "a \n\n b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None), (None, "no id here", "en", "s1"), (5, ODD[5], "en", "s2"), (5, ODD[5], "en", "s2"), (101, "the same text", "en", None), (102, "the same text", "de", "s9")]
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def test_bpe_equals_the_library(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.bpe_encode(odd, path, decode=True, rows=4)
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert pairs(got) == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])
    again = {(r.id, r.decoded) for r in bpe.bpe_decode(got, path).collect()}
    assert again == {(i, d) for i, _, d in want}
    assert bpe.bpe_encode(empty, path).count() == 0


def test_bpe_random_words_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.Codec(path, kept=5), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aabcdeéñ ingtion'sT.,!1 \n") for _ in range(rng.randrange(60)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_stale_entries_and_leftmost_first():
    own = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("aaaaaaa", "banana", "mississippi", "x"):
        ids = [own.inner[b] for b in word.encode()[:-1]] + [own.last[word.encode()[-1]]]
        slow = list(ids)
        while True:
            ranked = [(own.merges[a << 17 | b] >> 17, i) for i, (a, b) in enumerate(zip(slow, slow[1:], strict=False)) if a << 17 | b in own.merges]
            if not ranked:
                break
            _, i = min(ranked)
            slow[i : i + 2] = [own.merges[slow[i] << 17 | slow[i + 1]] & 0x1FFFF]
        assert own.merge(ids) == slow


def test_id_blocks_round_trip_and_checksum():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 5000, 70_000):
        ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.int32)
        block = idcoder.pack_block(np.array([3, 9]), np.array([n // 2, n - n // 2]), ids, 1000)
        docs, lengths, back = idcoder.unpack_block(block)
        assert docs.tolist() == [3, 9] and lengths.sum() == n and (back == ids).all()
    assert len(block) < 2 * n * 0.8  # well below two bytes an id
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        idcoder.unpack_block(bytes(broken))


def test_flags_learn_from_all_lanes():
    lanes, rng = idcoder.MAX_LANES, np.random.default_rng(2)
    model = idcoder.Model(lanes, 1000)
    for _ in range(3):
        model.predict()
        ids, before = rng.integers(0, 9, lanes).astype(np.int32), model.flags.copy()
        kind = np.where(model.two == ids, 0, np.where(model.one == ids, 1, 2))
        want = np.zeros_like(before)
        np.add.at(want, (model.context, kind), 2)
        model.learn(ids, kind, kind == 2)
        assert (model.flags - before == want).all() and want.sum() == 2 * lanes
    ids = np.minimum(rng.zipf(1.3, lanes * idcoder.STEPS), 999).astype(np.int32)
    assert (idcoder.unpack_block(idcoder.pack_block(np.array([1]), np.array([len(ids)]), ids, 1000))[2] == ids).all()


def test_tokens_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\tab's.é²1_-Á×÷ẞ\u00a0ñ") for _ in range(40)) for _ in range(300)] + ["".join(rng.choice("  \n\tab's.é²1_-Á×ñ") for _ in range(60)) for _ in range(600)]
    for own in (idcoder.Tokens(path, slots=16, kept_ids=200), idcoder.Tokens(path)):
        for at in range(0, len(texts), 7):
            for t, ids in zip(texts[at : at + 7], own.encode(pa.array(texts[at : at + 7])), strict=True):
                assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_id_files(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    idcoder.write_id_files(odd, path, f"{tmp_path}/ids", end_id=0, block_ids=500, rows=3)
    got = sorted((tuple(r) for r in idcoder.read_id_files(spark, f"{tmp_path}/ids").collect()), key=lambda r: r[1])
    want, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), ids))
        start += len(ids)
    assert got == want
    sums = idcoder.read_id_files(spark, f"{tmp_path}/ids", lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32")
    assert {(r.id, r.ids_crc32) for r in sums.collect()} == {(i, zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, _, _, x in want}
    idcoder.write_id_files(empty, path, f"{tmp_path}/none")
    assert idcoder.read_id_files(spark, f"{tmp_path}/none").count() == 0


def test_simhash_edits(spark, odd, empty):
    docs = odd.where("doc_id is not null")
    got = {r.id: r for r in edits.edited_likeness(docs, rows=3).collect()}
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect()}, reverse=True)
    texts = [t for i, t in rows for _ in range(3 if i == 5 else 1)]
    ids = [i for i, _ in rows for _ in range(3 if i == 5 else 1)]
    prints = simhash.fingerprints(pa.array(texts))
    for n, (i, t) in enumerate(zip(ids, texts, strict=True)):
        after = texts[(n + 1) % len(texts)]
        if i == 5 and ids[(n + 1) % len(ids)] == 5:
            continue
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        if i != 5:
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
            assert got[i].near_next == 1 - int(prints[n] ^ prints[(n + 1) % len(texts)]).bit_count() / 64
        assert got[i].fingerprint == f"{int(prints[n]):016x}" and got[i].n_chars == len(t)
    assert got[101].fingerprint == got[102].fingerprint and got[100].fingerprint == "0" * 16
    assert edits.edited_likeness(empty).count() == 0
    assert edits.edited_likeness(odd).count() == odd.count()
    alone = edits.edited_likeness(odd.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_simhash_by_hand():
    text = "alpha beta gamma delta epsilon of it"
    w = next(T.word_chunks(pa.array([text])))[2]
    terms = T.run_hashes(w.hashes(), 2)
    weight = [simhash.LONG if len(a) + len(b) + 1 > simhash.SHORT_BYTES else simhash.SHORT for a, b in zip(text.split(), text.split()[1:], strict=False)]
    want = sum(1 << b for b in range(64) if sum(v if int(t) >> b & 1 else -v for t, v in zip(terms, weight, strict=True)) > 0)
    assert int(simhash.fingerprints(pa.array([text]))[0]) == want


def test_block_tables_find_all_near_fingerprints(spark):
    rng = random.Random(1)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        prints += [p] + [p ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 2, 3, 4, 6)]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed + signed[:5] + [None]], "fingerprint long")
    for radius in (0, 2, 3):
        got = {tuple(r) for r in simhash.near_fingerprints(df, radius).collect()}
        want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in set(signed) for b in set(signed) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        assert got == want
    with pytest.raises(ValueError):
        simhash.near_fingerprints(df, 3, 3)


@pytest.mark.parametrize("side", [8192, 3])
def test_near_counts_equal_brute_force(spark, side):
    rng = random.Random(4)
    core = rng.getrandbits(64)
    prints = [core ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)] + [0, 1 << 63, (1 << 63) | 7, 2**64 - 1]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), d)) for p in [rng.getrandbits(64) for _ in range(20)] for d in (0, 0, 1, 2, 3, 4, 5)]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in [*signed, None]], "fingerprint long")
    for radius, blocks in ((0, None), (2, None), (3, None), (3, 5), (3, 4)):
        got = {r.fingerprint: r.n_near for r in simhash.near_counts(df, radius, blocks, side).collect()}
        want = {a: sum(a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius for b in set(signed)) for a in set(signed)}
        assert got == {a: n for a, n in want.items() if n}


def test_op5_counts_near_and_equal_documents_of_the_whole_table(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 11))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    texts += [t + " and another ending" for t in texts[:6]] + [t.replace(t.split()[n], "changed", 1) for n, t in enumerate(texts[:6])] + texts[3:9] + [texts[0]] * 40 + ["", None]
    make(spark, [(i * 7 % 1000, t, "en", "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_simhash(spark, str(tmp_path)).collect()}
    prints = simhash.fingerprints(pa.array([t or "" for t in texts], type=pa.string())).tolist()
    assert len(got) == len(texts)
    for i, p in enumerate(prints):
        row = got[i * 7 % 1000]
        assert row.fingerprint == f"{p:016x}"
        assert (row.n_near, row.n_equal) == (sum(0 < (p ^ q).bit_count() <= 3 for q in set(prints)), prints.count(p) - 1)
    assert any(r.n_near for r in got.values())


def test_license_automata():
    a = licenses.compile_template("start [[maybe [[deep]] this]] {2} stop")
    for text, ok in (("start stop", True), ("start maybe this stop", True), ("start maybe deep this x y stop", True), ("start x y z stop", False), ("start deep this stop", True), ("start maybe stop", True),
                     ("start maybe x y stop", False), ("stop", False), ("start", False)):
        assert a.run(text.encode().split())[0] is ok, text
    assert a.run(b"start other".split())[1] == 0.5


def test_license_scan(spark, odd, empty):
    rows = [(1, "Released under the MIT License.\nthe mit-license; MIT  License", "en", "a"), (2, "gnu General public LICENSE x GNU general public license", "en", "a"), (3, "CC BY-NC 4.0", "en", "a"),
            (4, "Licensed under the terms of the Apache License, Version 2.0", "en", "a"), (5, "Licensed under the Apache License, Version 1.1", "en", "a"), (6, "émit license mit licenseé", "en", "a"),
            (7, "This work is licensed under CC BY-NC 4.0.", "en", "a"), (8, licenses.TEMPLATES["bsd-text"].replace("[[", "").replace("]]", "").replace("{12}", "Some Body"), "en", "a")]
    got = {r.id: r for r in licenses.scan_licenses(make(spark, rows)).collect()}
    for i, text, _, _ in rows:
        low = text.translate({c: c + 32 for c in range(65, 91)}).encode()
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.encode().split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (got[i].first_word, got[i].last_word) == (min((p for p, _ in at), default=None), max((p for p, _ in at), default=None))
    assert got[1].labels == "mit,mit-notice" and got[4].labels == "apache,apache-2.0" and got[5].labels == "apache" and got[7].labels == "cc-by,cc-by-nc-4.0" and got[8].labels == "bsd-text"
    assert got[4].score == 1.0 and 0.5 <= got[5].score < 1 and got[3].score == 0.5
    assert licenses.scan_licenses(empty).count() == 0
    assert all(r.labels == "" and r.score < 1 for r in licenses.scan_licenses(odd).collect())


def test_phrases_and_templates_of_any_length(spark):
    """One word, five and seven words; none at all; words that any word may follow; the longest match at a place."""
    phrases = {"copyleft": "one", "a b c d e": "five", "a b c d e f g": "seven", "end": "last"}
    templates = {"single": "solo", "gap": "foo {2} bar", "tail": "head [[and tail]]", "short": "x y", "long": "x y z", "other": "x {1} z"}
    rows = [(1, "a copyleft", "en", "a"), (2, "A b c d e f g", "en", "a"), (3, "a b c d", "en", "a"), (4, "end", "en", "a"), (5, "the end", "en", "a"), (6, "solo", "en", "a"), (7, "foo q bar foo q q q bar", "en", "a"),
            (8, "head and tail", "en", "a"), (9, "x y", "en", "a"), (10, "x y z", "en", "a"), (11, "", "en", "a"), (12, "a b c d e x y z x y", "en", "a")]
    got = {r.id: r for r in licenses.scan_licenses(make(spark, rows), phrases, templates).collect()}
    assert {i: r.base_labels for i, r in got.items() if r.n_base} == {1: "one", 2: "five,seven", 4: "last", 5: "last", 12: "five"}
    assert (got[2].n_base, got[5].first_word) == (2, 1)
    assert {i: r.labels for i, r in got.items() if r.labels != r.base_labels} == {6: "single", 7: "gap", 8: "tail", 9: "short", 10: "long,other", 12: "five,long,other,short"}
    assert licenses.compile_template("head [[and tail]]").run(b"head and tail x".split()) == (True, 1.0, 3)
    none = licenses.scan_licenses(make(spark, rows), {}, {}).collect()
    assert all((r.n_base, r.labels, r.score) == (0, "", 0.0) for r in none)


def test_spdx_marks(spark):
    marks = {"MIT": "spdx-mit", "MIT-0": "spdx-mit-0", "GPL-2.0-or-later": "spdx-gpl-2.0-or-later", "GPL-2.0": "spdx-gpl-2.0", "Apache-2.0": "spdx-apache-2.0", "Nothing-1.0": ""}
    rows = [(i, f"# SPDX-License-Identifier: {x}\nimport os", "en", "a") for i, x in enumerate(marks)]
    got = {r.id: r.labels for r in licenses.scan_licenses(make(spark, rows)).collect()}
    assert [got[i] for i in range(len(marks))] == list(marks.values())


def test_license_texts_are_read_to_their_end(spark):
    """Against the published texts: whole ones are accepted, those with an altered, cut or added part aren't."""
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    adverts = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
    tail = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    isc = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    whole = {"mit-text": mit, "isc-text": isc, "bsd-2-text": head + tail, "bsd-text": head + "3. " + names + tail}
    altered = [t.replace(a, b) for t in whole.values() for a, b in ((" OF THIS SOFTWARE", " OF THAT SOFTWARE"), ("DEALINGS IN", "DEALINGS OUTSIDE"), ("BE LIABLE", "BE FULLY LIABLE"))]
    altered = [t for t in altered if t not in whole.values()] + [t[: t.index("IN NO EVENT")] for t in whole.values()] + [head, head + adverts + "4. " + names + tail, head + names.replace("endorse", "praise") + tail]
    rows = [(i, t, "en", "a") for i, t in enumerate([*whole.values(), *altered])]
    got = {r.id: r for r in licenses.scan_licenses(make(spark, rows)).collect()}
    for i, _ in enumerate(rows):
        assert (got[i].labels, got[i].score == 1.0) == ((list(whole)[i], True) if i < len(whole) else ("", False)), rows[i][1][-200:]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * rng.choice([0.01, 1, 300])], 1) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(40)]  # ties
    rows += [(2000, None, 0), (2050, [], 0), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2150, [float("nan")] * 6, 0), (2200, [float("inf")] * 6, 0), (2250, [1.0, 2.0], 0), (2251, [1.5, -2.0], 0), (None, rows[3][1], 0), (7, rows[3][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, dims int")
    got = sorted(tuple(r) for r in bitslice.top_k(df, F.col("vec_id") % 50 == 0).collect())
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in fine:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, u, strict=True)), j is None, j) for j, u in fine if len(u) == len(v) and j != i), key=lambda s: (s[0], s[1], s[2] or 0))
        want += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scored[:5])]
    assert got == sorted(want)
    assert bitslice.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hilbert.hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_hilbert_shards(spark, odd, empty):
    keys = odd.select(F.col("doc_id").alias("id"), hilbert.text_order(F.col("source")).alias("source"), F.length("text").alias("size"))
    got = hilbert.hilbert_shards(keys, ["source", "size"], ["id"], shards=7).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == odd.count() and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    none = empty.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    assert hilbert.hilbert_shards(none, ["size"], ["id"]).count() == 0


def test_sources_with_a_common_beginning_are_told_apart(spark, tmp_path):
    sources = [f"https://example.org/{c}" for c in "abcd"]
    rows = [(i, "x" * (i * 37 % 101), "en", sources[i % 4] if i % 9 else None) for i in range(400)]
    df = make(spark, rows)
    ranks = {r.source: r.rank_of for r in hilbert.with_value_rank(df, "source", ["doc_id"], "rank_of", spread=5).select("source", "rank_of").distinct().collect()}
    assert ranks == {s: None if s is None else sum(r[3] is not None and r[3] < s for r in rows) for s in {r[3] for r in rows}}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    of, by_shard = {i: s for i, _, _, s in rows}, collections.defaultdict(set)
    for r in queries.op4_hilbert_shards(spark, str(tmp_path)).collect():
        by_shard[r.shard].add(of[r.doc_id])
    assert len(by_shard) == 40 and sum(len(s) for s in by_shard.values()) < 100  # 181 where all of them are one class


def filled(sizes, cycle=3, most=3):
    """Targets by sharing again and again."""
    weights = {s: i % cycle + 1 for i, s in enumerate(sizes)}
    total, out, open_ = sum(sizes.values()), {}, dict(sizes)
    while open_:
        left, w = total - sum(out.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w >= most * open_[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        for s in over:
            out[s] = most * open_.pop(s)
    return out


def test_mix(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), "en", rng.choice(["b"] * 12 + ["a", "c", "é", "z", None])) for i in range(400)]
    docs = make(spark, [*rows, (7, "x y", "en", "a"), (7, "x y", "en", "a"), (None, "n n n", "en", "a"), (900, None, "en", "a"), (901, "", "en", "nothing")])
    got = mixing.mix(mixing.sized(docs)).collect()
    assert len(got) == docs.count()
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    sizes = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = filled(sizes)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(mixing.sized(docs.repartition(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed_documents(docs).collect()
    words = collections.Counter()
    for r in out:
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.id == "own" and r.block == 3
    assert words == collections.Counter({s: sum(r.taken for r in got if r.source == s) for s in names if sizes[s]})
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(mixing.sized(odd)).count() == odd.count()


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, ("good words here " if i % 2 else "## 1 22 333 4444 ## ") * 5, "en", "abc"[(i // 2) % 3]) for i in range(3000)]
    got = [r for r in mixing.mix(mixing.sized(make(spark, rows))).collect() if r.source == "a"]
    share = {odd_: sum(r.taken for r in got if r.id % 2 == odd_) / sum(r["size"] for r in got if r.id % 2 == odd_) for odd_ in (0, 1)}
    assert share[1] > 2 * share[0]


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.encode(F.col("k").cast("string"), "UTF-8")) % 5
    ranked = {r.id: r for r in quality.ranked_documents(docs, labels, held != 0).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [(ranked[i].score >= 0.3) == (q == 1) for i, q in truth.items() if i in ranked and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(ranked) == docs.count() and np.mean(right) > 0.9
    assert all(r.accepted == (r.score >= 0.3) and 0 <= r.quantile < 1 for r in ranked.values())
    model = quality.fit(*quality.training_rows(docs, labels))
    scores = [r.score for r in quality.with_scores(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality.ranked_documents(empty, labels).count() == 0
    nothing = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.ranked_documents(odd, nothing).collect()} == {0.5}
    kept = quality.accepted_documents(odd, labels)
    assert kept.columns == odd.columns and set(kept.select("score").distinct().toPandas().score) <= {0.5}


def test_pairwise_weights_order_documents():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(400, len(quality.FEATURES))))
    label = (x[:, 1] - x[:, 4] > 0).astype(int)
    model = quality.fit(x, label)
    assert ((model.scores(x) >= quality.CUT_SCORE) == (label == 1)).mean() > 0.97
    assert (quality.fit(x[:3], np.ones(3)).weights == 0).all()
