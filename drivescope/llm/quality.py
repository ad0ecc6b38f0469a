"""Quality classifier: Bradley-Terry ranking of documents by features of their whole texts.

A pair says that one document (label 1) is preferred to another (label 0). The chance of that is the logistic function of the
difference of their scores, scores are linear in features, so the weights minimise the logistic loss of feature differences.
The scores of all documents are then cut at a quantile: the share of documents below the cut is counted over all of them in
bins of the score, whose borders include the cut.

The fit uses at most ``MAX_LABELLED`` labelled rows of each label, those with the smallest hash of their id, and
``PAIRS_EACH`` partners for each; only that bounded sample comes to the driver. Everything else covers all documents.

Defined results: null and empty texts have the features of a text without words and get a score like any other; without
labels of both kinds the weights are zero and every score is 0.5; labels of unknown documents are ignored, null labels too;
repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivescope.llm import text as T
from drivescope.llm.frames import each_batch, id_and_text
from drivescope.operators.staging import materialize

MAX_LABELLED, PAIRS_EACH = 6000, 16
CUT_SCORE = 0.3


def _table(characters: str | list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) if isinstance(c, str) else c for c in characters]] = True
    return table


_UPPER, _DIGIT = _table([*range(65, 91)]), _table([*range(48, 58)])
_STOPS, _LINE = _table(".,;:?'\"()-"), _table("\n")
_HIGH = _table([*range(128, 256)])
_OTHER = ~(_UPPER | _DIGIT | _STOPS | _HIGH | T.SPACE_BYTES | _table([*range(97, 123)]))
FEATURES = ["words", "upper", "digits", "stops", "signs", "lines", "length", "long_words", "distinct", "echo_1", "echo_2", "runs", "sign_words", "upper_words"]


def features(texts: pa.Array) -> np.ndarray:
    """Texts x features, each of a bounded range whatever the text's length."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b, w in T.word_chunks(texts):
        counts = w.counts()
        words, filled = np.maximum(counts, 1), np.maximum(1, np.diff(np.r_[0, np.cumsum(T.WORD_BYTES[w.data])][w.offsets]))
        by_byte = {n: np.r_[0, np.cumsum(t[w.data])] for n, t in (("upper", _UPPER), ("digits", _DIGIT), ("stops", _STOPS), ("signs", _OTHER), ("lines", _LINE))}
        f = {n: np.diff(s[w.offsets]) / (words if n == "lines" else filled) for n, s in by_byte.items()}
        h, lengths = w.hashes(lower=True), w.ends - w.starts
        per_doc = lambda x, w=w: np.diff(np.r_[0, np.cumsum(x)][w.first])
        inside = {k: T.run_mask(w.first, k) for k in (2, 3, 4)}

        def repeats(x: np.ndarray, mask: np.ndarray, k: int, w=w) -> np.ndarray:
            """Share of a document's runs of k words that it has had before."""
            doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: len(x)][mask]
            order = np.lexsort((x[mask], doc))
            d, v = doc[order], x[mask][order]
            again = np.bincount(d[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])], minlength=len(w.first) - 1) if len(d) else np.zeros(len(w.first) - 1)
            return again / np.maximum(1, np.diff(w.first) - k + 1)

        def echo(k: int, h=h, w=w) -> np.ndarray:
            same = np.zeros(len(h), dtype=bool)
            if len(h) > k:
                same[: len(h) - k] = (h[k:] == h[: len(h) - k]) & inside[k + 1]
            return per_doc(same) / words

        sign_at, upper_at = (by_byte[n][w.ends] - by_byte[n][w.starts] for n in ("signs", "upper"))
        f |= {
            "words": np.log1p(counts) / 10, "length": per_doc(lengths) / words / 10, "long_words": per_doc(lengths > 14) / words,
            "distinct": 1 - repeats(h, np.ones(len(h), dtype=bool), 1), "echo_1": echo(1), "echo_2": echo(2), "runs": repeats(T.run_hashes(h, 4), inside[4], 4),
            "sign_words": per_doc(sign_at > 0) / words, "upper_words": per_doc(2 * upper_at > lengths) / words,
        }
        out[a:b] = np.stack([f[n] for n in FEATURES], axis=1)
    return out


@dataclass
class Ranking:
    """Score of a text: ``features @ weights``; ``level`` where a document is rather of label 1, ``slope`` of the reported score."""

    weights: np.ndarray
    level: float = 0.0
    slope: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _widened(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ``CUT_SCORE`` at the level."""
        z = self.slope * (self.raw(x) - self.level) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return np.where(self.weights.any(), 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.5)


def _widened(x: np.ndarray) -> np.ndarray:
    """Features and their roots: a small share of signs already tells."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-4, steps: int = 40) -> Ranking:
    """Bradley-Terry weights by Newton steps on the pairs' logistic loss; partners come from a fixed random order."""
    z = _widened(x)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(z.shape[1]))
    scale = np.maximum(z.std(axis=0), 1e-6)
    rng, n = np.random.default_rng(5), pairs_each * max(len(good), len(bad))
    i, j = (np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n] for side in (good, bad))
    d = (z[i] - z[j]) / scale
    weights = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -60, 60)))
        gradient = -(d.T @ p) / n + ridge * weights
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    out = Ranking(weights / scale)
    s = out.raw(x)
    order = np.argsort(s)
    wrong = np.cumsum(label[order] == 1) / len(good) + 1 - np.cumsum(label[order] == 0) / len(bad)  # cut behind each row
    best = np.flatnonzero(wrong == wrong.min())
    lower, upper = s[order][best[0]], s[order][min(best[-1] + 1, len(s) - 1)]
    out.level, out.slope = float((lower + upper) / 2), float(4 / max(s.std(), 1e-9))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, where: Column | None = None, label_col: str = "quality", limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample: at most ``limit`` rows a label, by hash of the id."""
    rows = labels.select(F.col("doc_id").alias("k"), F.col(f"`{label_col}`").cast("int").alias("label")).where("k is not null and label in (0, 1)")
    rows = rows if where is None else rows.where(where)
    chosen = None
    for value in (0, 1):
        some = rows.where(F.col("label") == value).orderBy(F.xxhash64("k"), "k").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = F.broadcast(chosen)  # at most 2 * limit rows of two numbers

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(features(batch.column("text"))), type=pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    d = id_and_text(docs)
    found = d.join(chosen, d["id"] == chosen["k"]).select("id", "text", "label")
    got = found.mapInArrow(each_batch(one), "x array<double>, label int").collect()
    x = np.array([r.x for r in got]) if got else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, dtype=int)
    return x[order], np.array([r.label for r in got], dtype=int)[order]


def with_scores(docs: DataFrame, ranking: Ranking, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` for every document; with ``keep`` all columns of ``docs`` and ``score``."""
    d = docs if keep else id_and_text(docs, id_col, text_col)
    kept, at = (docs.columns if keep else ["id"]), (text_col if keep else "text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(at))
        return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(ranking.scores(features(texts)))], [*kept, "score"])

    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept)
    return d.mapInArrow(each_batch(one), f"{kinds}, score double")


def ranked_documents(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> DataFrame:
    """``id, score, quantile, accepted``: the share of documents in lower bins, and whether the score reaches the cut's quantile."""
    scored = materialize(with_scores(docs, fit(*training_rows(docs, labels, where))), "scores")
    width = CUT_SCORE / 600
    place = F.floor(F.col("score") / width + 1e-9).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # at most 2001 rows
    lower = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = bins.select("bin", (F.coalesce(F.sum("n").over(lower), F.lit(0)) / F.sum("n").over(whole)).alias("quantile"),
                       (F.sum(F.when(F.col("bin") < 600, F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)).alias("cut"))
    return (scored.withColumn("bin", place).join(F.broadcast(bins), "bin")
            .select("id", "score", "quantile", (F.col("quantile") >= F.col("cut")).alias("accepted")))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the cut; those below its quantile are rejected."""
    scored = with_scores(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, fit(*training_rows(docs, labels)), keep=True)
    kept = scored.where(F.col("score") >= CUT_SCORE).drop("score")
    return kept.withColumnRenamed("__score", "score")
