"""Toxicity: non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import by_size, texts
from lexloom.llm.decontamination import Lookup
from lexloom.llm.words import ids_of, slices, words


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of each text, and their bounds."""
    hashes, bounds = words(column)
    text = ids_of(bounds)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[first], np.searchsorted(t[first], np.arange(len(bounds)))


@dataclass
class Model:
    """weights by word hash (sorted), and a bias. A text's score is the bias and the weights of its distinct words."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Minus infinity for a text without words."""
        h, bounds = distinct_words(column)
        out = np.where(np.diff(bounds) > 0, self.bias, -np.inf)
        if len(self.keys):
            at, place = Lookup(self.keys).find(h)
            np.add.at(out, np.searchsorted(bounds, at, "right") - 1, self.weights[place])
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_docs: int = 5, steps: int = 300, rate: float = 0.05, shrink: float = 0.06) -> Model:
    """Minimise the non-negative risk prior * R+(P) + max(0, R-(U) - prior * R-(P)) of the logistic loss, by Adam with soft thresholding.

    Where the estimate of the negatives' risk falls below 0, which only
    overfitting can cause, the step goes the other way on that part.  Texts are
    arrays of distinct word hashes; words of fewer than min_docs texts are left out.
    The L1 penalty is shrink divided by the number of positives, so that few examples give few words.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    every = np.concatenate([*positive, *unlabelled])
    keys, counts = np.unique(every, return_counts=True)
    keys = keys[counts >= min_docs]
    rows = np.repeat(np.arange(len(positive) + len(unlabelled)), [len(x) for x in [*positive, *unlabelled]])
    place = np.minimum(np.searchsorted(keys, every), max(0, len(keys) - 1))
    known = keys[place] == every if len(keys) else np.zeros(len(every), bool)
    rows, place = rows[known], place[known]
    n, p = len(positive) + len(unlabelled), len(positive)
    w, b = np.zeros(len(keys)), -1.0
    m1, m2, c1, c2 = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[place], n) + b
        zp, zu = z[:p], z[p:]
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        g = np.zeros(n)
        on_u, on_p = _sigmoid(zu) / len(zu), -prior * _sigmoid(zp) / p
        if negative >= 0:
            g[:p], g[p:] = -prior * _sigmoid(-zp) / p + on_p, on_u
        else:
            g[:p], g[p:] = -on_p, -on_u
        gw, gb = np.bincount(place, g[rows], len(keys)), g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw**2
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb**2
        k1, k2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(m2 / k2) + 1e-8)
        w = w - scale * m1 / k1
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * shrink / p, 1), 0)
        b -= rate * (c1 / k1) / (np.sqrt(c2 / k2) + 1e-8)
    kept = w != 0
    return Model(keys[kept], w[kept], float(b))


def _features(rows: DataFrame) -> list[tuple[int, np.ndarray]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                h, bounds = distinct_words(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "words"])

    table = rows.mapInArrow(cut, "doc_id long, words array<long>").toArrow()
    ids, lists = table["doc_id"].to_numpy(), table["words"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    got = [(int(i), values[a:b]) for i, a, b in zip(ids, offsets[:-1], offsets[1:])]
    return sorted(got, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the fit doesn't depend on the order of tasks


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 3000, max_unlabelled: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on confirmed toxic documents and unlabelled ones, both drawn by a hash of the id and bounded: max_positive and max_unlabelled.

    The unlabelled sample is of all documents, whatever their label.  The class
    prior is the share of toxic among the labelled ids, if it isn't given.
    Without a toxic document the model rejects nothing.
    """
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.col(f"`{label_col}`").cast("int") == 1).alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = texts(docs, id_col, text_col)
    ids = rows.select("doc_id").distinct()
    by_hash = F.xxhash64("doc_id")
    positives = marked.where("toxic").select("doc_id").join(ids, "doc_id", "left_semi").orderBy(by_hash, "doc_id").limit(max_positive)
    others = ids.orderBy(by_hash, "doc_id").limit(max_unlabelled)
    p = _features(rows.join(by_size(positives, max_positive), "doc_id", "left_semi"))
    u = _features(rows.join(by_size(others, max_unlabelled), "doc_id", "left_semi"))
    return fit([x for _, x in p], [x for _, x in u], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, score double, toxic boolean) for every row of docs, repeated rows and null ids too.

    score is the estimated probability, toxic says that it is above threshold.  A
    null, empty or wordless text has score 0 and isn't toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                p = np.round(_sigmoid(sent.value.scores(batch.column(1))), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p > threshold)], ["doc_id", "score", "toxic"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, score double, toxic boolean")
