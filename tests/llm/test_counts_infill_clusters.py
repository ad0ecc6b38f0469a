"""Prefix counts against the library, fill-in-the-middle and clustering against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from llm_fixtures import make

from drivescope.llm import hadamard, infill, prefixes, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "\n\t ", "a", "▁a ▁", "   three spaces  twice   ", "<s>x<unk></s><0x41>", "日本語😀 é ñ ½", "a\x00b", "Σας ΟΔΥΣΣΕΥΣ", " " * 37 + "x", "a" * 3000, "the cat " * 3000, "12 345,6",
         "has <P> inside", "<S", "S><M", "x \n\n y", "tail \r\n", "é", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    rows += [(i + 100, t, "de", None) for i, t in enumerate(TEXTS)]
    rows += [(500, None, None, None), (None, "no id here", "en", "s"), (5, TEXTS[6], "en", "s"), (5, TEXTS[6], "en", "s")]
    return make(spark, rows).repartition(3)


def test_counts_of_random_prefixes():
    library, table, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), prefixes.PrefixTable(MODEL), random.Random(3)
    for alphabet in ("  abcdeinghtors", "▁ a", "   \n\tthe ", "日本語 ñé😀x ▁", "0123456789 .,;", "aaaab b  "):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert table.counts(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_tables_may_be_small(monkeypatch):
    monkeypatch.setattr(prefixes, "KEPT_CHARS", 30)
    monkeypatch.setattr(prefixes, "KEPT_PAIRS", 5)
    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), prefixes.PrefixTable(MODEL)
    for text in TEXTS * 2:
        assert table.counts(text)[-1] == len(library.encode(text))


def test_prefix_index_answers_budgets(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    index = prefixes.prefix_counts(docs.where("length(text) < 500 AND doc_id <> 5"), MODEL)
    asked = index.select("id", "counts", prefixes.chars_within(F.col("counts"), 5).alias("cut"), prefixes.tokens_within(F.col("counts"), 4).alias("four"), prefixes.tokens_within(F.col("counts"), 10**6).alias("all"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in asked.collect():
        text = texts[r.id]
        every = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert r.counts == every and r.four == every[min(4, len(text))] and r["all"] == every[-1]
        assert r.cut == max(i for i, c in enumerate(every) if c <= 5)


def test_count_tokens_of_odd_rows(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((tuple(r) for r in prefixes.count_tokens(docs, MODEL, budget=7).collect()), key=str)
    want = []
    for r in docs.collect():
        text = r.text or ""
        kept = max(i for i in range(min(len(text), 200) + 1) if len(library.encode(text[:i])) <= 7)
        want.append((r.doc_id, len(text.encode()), len(text), len(library.encode(text)), kept))
    assert got == sorted(want, key=str)
    assert prefixes.count_tokens(make(spark, []), MODEL, budget=7).collect() == []


def test_other_models_are_refused():
    with pytest.raises(Exception):
        prefixes.PrefixTable(public_tokenizers.path("byte_bpe_50k.json"))


def test_sparse_index_both_ways():
    text = "aé日😀b" * 3 + "ascii" + "ñ"
    index = infill.SparseIndex(np.frombuffer(text.encode(), dtype=np.uint8))
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:i].encode()) for i in chars])
    assert index.to_chars(cuts).tolist() == chars.tolist() and index.to_bytes(chars).tolist() == cuts.tolist()
    assert len(infill.SparseIndex(np.frombuffer(b"plain ascii", dtype=np.uint8)).bytes) == 0


def rearranged(doc_id, text, rate, share):
    """The definition, over code points."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "share"), [(50, 80), (100, 30), (0, 0)])
def test_infill_equals_definition_and_restores(spark, docs, rate, share):
    made = infill.fill_in_middle(docs, rate=rate, spm_share=share)
    got = [tuple(r) for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()]
    want = [(*rearranged(r.doc_id, r.text or "", rate, share), r.text or "") for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert infill.fill_in_middle(make(spark, [])).collect() == []


def plain_clusters(rows, k, rounds, limit=hadamard.LIMIT):
    """The contract in Python integers."""
    kept = [(i, [max(-limit, min(limit, int(np.floor(float(x) * 1024)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted((i, n, d, sum(e for e, m in found if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, found, strict=True))


VECTORS = "vec_id long, embedding array<double>, cluster int, id string, q string, coefficients string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "own", "q", "c") for i, v in rows], VECTORS)


def test_clusters_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(1100, [0.0] * 64), (1101, [-1.0] * 64), (1102, [1.0] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64)]
    for k, rounds in ((8, 3), (3, 0), (400, 1)):
        got, centroids = hadamard.cluster(vectors(spark, rows).repartition(5), k=k, rounds=rounds)
        assert sorted(map(tuple, got.collect())) == plain_clusters(rows, k, rounds)
        assert len(centroids) == min(k, 343)


def test_clusters_of_huge_components_ties_and_few_rows(spark):
    big = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [5000.5] * 64), (4, [0.0] * 64), (5, [100000.0] * 63 + [-3.0])]
    got, _ = hadamard.cluster(vectors(spark, big), k=2, rounds=2)
    assert sorted(map(tuple, got.collect())) == plain_clusters(big, 2, 2)
    tie = [(i, [float(i % 3)] * 64) for i in range(9)]
    got, _ = hadamard.cluster(vectors(spark, tie), k=8, rounds=4)
    assert sorted(map(tuple, got.collect())) == plain_clusters(tie, 8, 4)
    none, centroids = hadamard.cluster(vectors(spark, []), k=8)
    assert none.collect() == [] and len(centroids) == 0 and none.columns == got.columns
    twins, _ = hadamard.cluster(vectors(spark, [(1, [1.0] * 64), (1, [1.0] * 64), (None, [2.0] * 64), (None, [2.0] * 64)]), k=8, rounds=1)
    assert sorted((r.id is None, r.distance) for r in twins.collect()) == [(False, 0), (False, 0), (True, 0), (True, 0)]


def test_search_eliminates_but_stays_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-2000, 2000, (500, 64)), rng.integers(-2000, 2000, (20, 64))
    x[:50] = c[rng.integers(0, 20, 50)]
    c[11] = c[4]
    number, distance = hadamard.nearest(hadamard.transform(x), hadamard.transform(c))
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert (hadamard.inverse(hadamard.transform(x)) == x).all()


@pytest.mark.parametrize("name", ["op11_prefix_counts", "op12_infill", "op13_hadamard_clusters"])
def test_registered_queries(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf_dir)
    rows = {r[0]: r for r in got.collect()}
    if name == "op13_hadamard_clusters":
        want = plain_clusters([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], 8, 10)
        assert sorted(tuple(r) for r in rows.values()) == want
        return
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(documents) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for d in documents:
        r, text = rows[d.doc_id], d.text or ""
        if name == "op11_prefix_counts":
            n = len(library.encode(text))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
        else:
            _, n, form, p, m, output = rearranged(d.doc_id, text, 50, 80)
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
            assert (r.output_sha256, r.restored_sha256) == (hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
