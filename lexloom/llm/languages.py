"""Language ID as mixture inference: each document's language shares by expectation-maximisation over its words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import by_size
from lexloom.llm.words import raw, slices

GRAM_BITS = 16
#: Bytes of text whose trigrams are held at once.
CHUNK = 1 << 20
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def grams(column: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words' bounds by text; and by parts of chunk bytes, so that no text is too long, trigram codes and the words that they belong to.

    A word is a run of letters (bytes a-z and from 0x80 after lower-casing); it is
    read as if a space stood before and after it, and has a code at every byte and at its end.
    """
    offsets, data = raw(pc.utf8_lower(column))
    n = len(data)
    text = np.zeros(n + 2, np.uint8)  # two zeros before
    text[2:] = np.where(_SEPARATOR[data], 0, data)
    letter = text[2:] != 0
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = letter & (begins[:n] | (text[1 : n + 1] == 0))
    last = letter.copy()
    last[:-1] &= begins[1:n] | ~letter[1:]
    starts = np.flatnonzero(first)

    def codes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, n, chunk):
            high = min(n, low + chunk)
            at = np.flatnonzero(letter[low:high]) + low
            word = np.searchsorted(starts, at, "right") - 1
            begun = at - starts[word]
            here = text[at + 2].astype(np.int64)
            back1 = np.where(begun >= 1, text[at + 1], 0).astype(np.int64)
            back2 = np.where(begun >= 2, text[at], 0).astype(np.int64)
            ends = last[at]
            code = np.concatenate([back2 << 16 | back1 << 8 | here, back1[ends] << 16 | here[ends] << 8])
            yield (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - GRAM_BITS), np.concatenate([word, word[ends]])

    return np.searchsorted(starts, offsets), codes()


@dataclass
class Model:
    """log_p[code, language]: log-probabilities of trigram codes."""

    names: list[str]
    log_p: np.ndarray


def train(docs: DataFrame, max_docs: int = 1000, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Trigram models of the languages named in lang_col, each from at most max_docs documents, drawn by a hash of the id. Rows with a null text, language or id aren't used."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = rows.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= max_docs).select("doc_id", "lang").distinct()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << GRAM_BITS, np.int64)
        for whole in table.select(["text"]).to_batches():
            for batch in slices(whole, 0):
                for codes, _ in grams(batch.column(0))[1]:
                    total += np.bincount(codes, minlength=1 << GRAM_BITS)
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    found = rows.join(by_size(drawn), ["doc_id", "lang"], "left_semi").groupBy("lang").applyInArrow(count, "lang string, counts binary").collect()
    found = sorted((r[0], np.frombuffer(r[1], np.int64)) for r in found)
    log_p = np.zeros((1 << GRAM_BITS, len(found)), np.float32)
    for i, (_, counts) in enumerate(found):
        log_p[:, i] = np.log((counts + smoothing) / (counts.sum() + smoothing * len(counts)))
    return Model([name for name, _ in found], log_p)


def word_likelihoods(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its likelihood in each language divided by the largest, the log of that, and words' bounds by text."""
    bounds, parts = grams(column)
    logs = np.zeros((bounds[-1], len(model.names)))
    for codes, word in parts:
        if not len(word):
            continue
        low, high = int(word.min()), int(word.max()) + 1
        for i in range(len(model.names)):
            logs[low:high, i] += np.bincount(word - low, model.log_p[:, i][codes], high - low)
    top = logs.max(axis=1) if logs.size else np.zeros(len(logs))
    logs -= top[:, None]
    return np.exp(logs, out=logs), top, bounds


def expectation_maximisation(like: np.ndarray, bounds: np.ndarray, allowed: np.ndarray, tolerance: float = 1e-4, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages that maximise each text's likelihood, and the log-likelihood there. Texts must have words. Texts that have settled leave the iteration."""
    n, k = allowed.shape
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    log_like = np.zeros(n)
    live = np.arange(n)
    for turn in range(rounds):
        sizes = np.diff(bounds)
        text = np.repeat(np.arange(len(live)), sizes)
        joint = like * shares[live][text]
        total = np.maximum(joint.sum(axis=1), 1e-300)
        starts = bounds[:-1]
        log_like[live] = np.add.reduceat(np.log(total), starts)
        new = np.add.reduceat(joint / total[:, None], starts, axis=0) / sizes[:, None]
        moved = np.abs(new - shares[live]).max(axis=1) > tolerance
        shares[live] = new
        if turn + 1 == rounds or not moved.any():
            break
        if moved.mean() < 0.7:
            keep = np.repeat(moved, sizes)
            like, live = like[keep], live[moved]
            bounds = np.concatenate([[0], np.cumsum(sizes[moved])])
    return shares, log_like


def infer(like: np.ndarray, bounds: np.ndarray, penalty: float, width: int = 6) -> np.ndarray:
    """Shares by text (0 for languages left out). Texts must have words.

    All languages are fitted first; then every set of the width languages of
    largest share, and the set with the least
    penalty * (size - 1) * log(words) - 2 * log-likelihood is taken, the smaller one of equals.  Sets of a
    size aren't fitted where the likelihood of all languages shows that none can win.
    """
    sizes = np.diff(bounds)
    n, k = len(sizes), like.shape[1]
    full, top = expectation_maximisation(like, bounds, np.ones((n, k)))
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), bounds[:-1], axis=0)
    best = np.zeros((n, k))
    best[np.arange(n), single.argmax(axis=1)] = 1
    cost = -2 * single.max(axis=1)
    order = np.lexsort((-single, -np.round(full, 9)), axis=1)[:, :width]
    unit = penalty * np.log(np.maximum(sizes, 2))
    for m in range(2, order.shape[1] + 1):
        for chosen in combinations(range(order.shape[1]), m):
            open_ = np.flatnonzero(unit * (m - 1) - 2 * top < cost)
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[open_][:, chosen], 1, 1)
            keep = np.zeros(n, bool)
            keep[open_] = True
            shares, log_like = expectation_maximisation(like[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[open_])]), allowed)
            value = unit[open_] * (m - 1) - 2 * log_like
            better = value < cost[open_] - 1e-9
            best[open_[better]], cost[open_[better]] = shares[better], value[better]
    return best


def mixtures(docs: DataFrame, model: Model, penalty: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, n_words long, languages array<string>, shares array<double>) for every row of docs, repeated rows and null ids too.

    languages are in falling order of their share of the words, equal ones by
    name; shares have 4 decimals.  A null or empty text, or one without letters, has none.
    A long text is read in chunks of bytes, whose words' sums are carried over; only the
    likelihoods of its words are held whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                like, _, bounds = word_likelihoods(sent.value, batch.column(1))
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes) if names else np.zeros(0, np.int64)
                shares = np.zeros((len(sizes), len(names)))
                if len(some):
                    shares[some] = infer(like, np.concatenate([[0], np.cumsum(sizes[some])]), penalty)
                shares = np.round(shares, 4)
                found, parts = [], []
                for row in shares:
                    at = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    found.append([names[i] for i in at])
                    parts.append([float(row[i]) for i in at])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(found, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "n_words", "languages", "shares"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, n_words long, languages array<string>, shares array<double>")
