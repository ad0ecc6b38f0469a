"""Near-duplicates, components, repeated passages and the pipeline against brute force."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from llm_fixtures import make
from pyspark.sql import functions as F

from drivescope.llm import components, minmax, queries, repeats

SF = "/root/testdata/sf0.001"


def words_of(text, lower=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower else raw)


def shingles(text, k):
    w = words_of(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(i, j) for i, a in sets for j, b in sets if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in range(len(rows)):
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return label, len(links)


def corpus(seed):
    """Copies of one text with few to many edits, a chain of slow change, a text and its halves, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = []
    for edits in [0, 1, 2, 2, 3, 4, 5, 6, 8, 10, 15, 30] * 3:
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain[5 * i] = word()
        texts.append("\n".join(chain))
    texts += [" ".join(base[:60]), " ".join(base) + " " + " ".join(word() for _ in range(9)), " ".join(base).upper(), "one two", "One  TWO", "two one", "", "  ", "x", "X"]
    texts += [" ".join(word() for _ in range(50)) for _ in range(10)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, k, percent):
    rows = [(3 * i + 1, t) for i, t in enumerate(corpus(seed))] + [(1000, None), (None, "a b c d e f g"), (2000, "a b c d e f g"), (2001, "a b c d e f g"), (2001, "a b c d e f g")]
    want, links = brute_components(rows, k, percent)
    assert links > 50
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    got = minmax.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got} == want | {None: None}
    sizes = {i: len(shingles(t, k)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.id] for r in got)
    kept = minmax.first_of_each(docs, k, percent)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, c in want.items() if i == c] + ["None"])


def test_prefix_join_finds_links_between_others_than_the_first(spark):
    """Two documents that are alike, in a bucket whose first member is like neither."""
    rows = [(i, t) for i, t in enumerate(corpus(7))]
    mixed = spark.createDataFrame([((i, 0), (i, 0)) for i, t in rows if shingles(t, 3)], "node struct<id long, crc long>, component struct<id long, crc long>")
    number = {}
    sets = spark.createDataFrame([((i, 0), len(s), sorted(number.setdefault(x, len(number)) for x in s)) for i, t in rows if (s := shingles(t, 3))], "node struct<id long, crc long>, n long, shingles array<long>")
    pairs = {tuple(sorted((r.node.id, r.hub.id))) for r in minmax._candidates(mixed, sets, 85).collect()}
    all_sets = {i: shingles(t, 3) for i, t in rows}
    links = {(i, j) for i, a in all_sets.items() for j, b in all_sets.items() if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b)}
    assert links and links <= pairs


def test_near_duplicates_of_nothing(spark):
    empty = make(spark, [])
    assert minmax.near_duplicates(empty, 3, 85).count() == 0 and minmax.first_of_each(empty).count() == 0
    assert minmax.band_count(85) < minmax.band_count(80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (102, 100), (200, 200), (300, 299)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows, m):
    where = {}
    docs = [words_of(t) for _, t in rows]
    for d, w in enumerate(docs):
        for i in range(len(w) - m + 1):
            where.setdefault(tuple(w[i : i + m]), []).append((d, i))
    gone = [set() for _ in docs]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + m))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g).decode()) for w, g in zip(docs, gone, strict=True)]


@pytest.mark.parametrize(("m", "letters", "seed"), [(5, 3, 1), (8, 8, 2), (12, 1, 3), (20, 40, 4)])
def test_repeats_equal_brute_force(spark, m, letters, seed):
    rng = random.Random(seed)
    word = lambda: "wxyzWXé"[rng.randrange(min(7, letters))] * rng.randrange(1, 2 + letters // 7)
    passages = [[word() for _ in range(rng.randrange(m, 3 * m))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            w += [word() for _ in range(rng.randrange(2 * m))] + p[rng.randrange(3) : len(p) - rng.randrange(3)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (51, rows[3][1]), (60, None), (61, ""), (62, " \n "), (None, rows[4][1]), (63, "la " * 500), (64, "ta ti " * 60)]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    got = sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(docs, m).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute_repeats(rows, m), strict=True))
    if m == 8:
        cut = repeats.documents_without_repeats(docs, m)
        assert cut.columns == docs.columns
        want = sorted((str(i), t if not removed else kept) for (i, t), (_, removed, kept) in zip(rows, brute_repeats(rows, m), strict=True) if t is not None)
        assert sorted((str(r.doc_id), r.text) for r in cut.where("text is not null").collect()) == want


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(make(spark, []), 35).count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r, strict=True)) + ")" for r in got.fetchall())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = p.quality(spark, docs, SF)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert first.columns == docs.columns and sum(q == 1 and i not in kept for i, q in truth.items()) == 0 and sum(q == 0 and i in kept for i, q in truth.items()) <= 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label, _ = brute_components(rows, p.NEAR_WORDS, p.NEAR_PERCENT)
    assert {r.doc_id for r in p.near_duplicates(spark, docs, SF).collect()} == {i for i, c in label.items() if i == c}
    cut = p.repeats(spark, docs, SF).collect()
    want = {i: kept_ for (i, _), (_, removed, kept_) in zip(rows, brute_repeats(rows, p.REPEAT_WORDS), strict=True) if removed}
    assert {r.doc_id: r.text for r in cut} == dict(rows) | want
    mixed = p.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns
    last = p.token_ids(spark, docs.limit(20), SF).collect()
    assert len(last) == 20 and all(len(r.ids) == r.n_tokens for r in last)
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "mixture", "token_ids"] and p.run(spark, SF).count() > 0
    assert docs.where(F.col("doc_id") < 0).transform(lambda d: p.repeats(spark, d, SF)).count() == 0
