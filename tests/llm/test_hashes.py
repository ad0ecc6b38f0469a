"""Hashes of words and runs: texts whose polynomials modulo 2^64 agree, and operators on them."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from llm_fixtures import make

from drivescope.llm import idcoder, minmax, repeats
from drivescope.llm import text as T


def twins(n, a="a", b="b"):
    """The word of n letters that counts ones of its places, and the same with the letters exchanged."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[o] for o in ones), "".join((b, a)[o] for o in ones)


LEFT, RIGHT = twins(1024)


def hashes(text):
    (_, _, w), = T.word_chunks(pa.array([text]), chunk_bytes=1 << 30)
    return w, w.hashes()


def test_words_runs_and_spans_differ():
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(4000)} | {LEFT, RIGHT, LEFT + "a", "é" * 40, "é" * 31})
    w, h = hashes(" ".join(words))
    assert len(set(h.tolist())) == len(words)
    assert (hashes(" ".join(x.upper() for x in words if x.isascii()))[0].hashes(lower=True) == hashes(" ".join(x for x in words if x.isascii()))[1]).all()
    for k in (1, 2, 3, 5, 8, 35):
        left, right = (hashes(" ".join(twins(k if k > 1 else 2, "x", "y")[i][:k]))[1] for i in (0, 1))
        assert T.run_hashes(left, k)[0] != T.run_hashes(right, k)[0]
        runs = T.run_hashes(h, k)
        assert len(runs) == len(h) - k + 1 and len(set(runs.tolist())) == len(runs)
        moved = T.run_hashes(np.r_[h[:7], h], k)
        assert (moved[7:] == runs).all()
    left, right = (hashes(" ".join(t))[1] for t in twins(1024, "x", "y"))
    spans = [T.span_hashes(x, np.array([0]), np.array([1024]))[0] for x in (left, right)]
    assert spans[0] != spans[1]
    starts, ends = np.array([0, 3, 3, 10, 10, 0, 5]), np.array([5, 3, 9, 11, 50, len(h), 5])
    both = np.r_[h[:100], h]
    assert (T.span_hashes(h, starts, ends) == T.span_hashes(both, starts + 100, ends + 100)).all()
    assert len(set(T.span_hashes(h, starts, ends).tolist())) == 6  # the two empty spans are equal


def test_twin_words_in_the_operators(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = idcoder.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (f"x {LEFT} {RIGHT}", RIGHT):
        assert np.frombuffer(own.encode(pa.array([text]))[0], dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    around = [f"w{i}" for i in range(40)]
    docs = make(spark, [(i, " ".join([*around[:k], word, *around[k:34]]), "en", "s") for i, (k, word) in enumerate([(17, LEFT), (17, RIGHT), (3, LEFT), (3, RIGHT)])])
    kept = repeats.without_repeats(docs, min_words=35).collect()
    assert len(kept) == 4 and all(r.n_removed == 0 and r.n_words == 35 for r in kept)
    one = make(spark, [(1, LEFT, "en", "s"), (2, RIGHT, "en", "s"), (3, f"{LEFT} {RIGHT} {LEFT}", "en", "s"), (4, f"{RIGHT} {LEFT} {RIGHT}", "en", "s"), (5, LEFT, "en", "s")])
    found = {r.id: r.component_id for r in minmax.near_duplicates(one, k=3, percent=85).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    long = make(spark, [(1, " ".join(twins(1024, "x", "y")[0]), "en", "s"), (2, " ".join(twins(1024, "x", "y")[1]), "en", "s")])
    assert repeats.without_repeats(long, min_words=1000).where("n_removed > 0").count() == 0
