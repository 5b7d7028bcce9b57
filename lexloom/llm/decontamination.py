"""Benchmark decontamination: a prefix-filtered set join of items with item-sized windows of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import by_size, scratch, texts
from lexloom.llm.words import shingles, slices, words

#: Distinct benchmark shingles that go to the tasks as one sorted array of 8 bytes each; above it documents' shingles are joined by a shuffle.
LOOKUP_KEYS = 4_000_000


class Lookup:
    """Membership of many 64-bit hashes in a sorted set: a bit table first, then a binary search for what passes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bits = max(16, int(len(keys)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.keys & np.uint64((1 << self.bits) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are in the set, and their places in keys."""
        at = np.flatnonzero(self.table[hashes & np.uint64((1 << self.bits) - 1)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[place] == hashes[at]
        return at[same], place[same]


def _item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, item, n_words, gram, h): every distinct shingle of each item; gram is n, or the item's number of words if that is less; item tells texts of one id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, bounds = words(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (item, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                w = hashes[bounds[i] : bounds[i + 1]]
                if not len(w):
                    continue
                g = min(n, len(w))
                h = np.unique(shingles(w, np.array([0, len(w)]), g)[0])
                for column, x in zip(out, (item, row, len(w), g, h.view(np.int64))):
                    column.append(np.broadcast_to(x, len(h)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["item_id", "item", "n_words", "gram", "h"])

    return items.mapInArrow(cut, "item_id long, item long, n_words long, gram long, h long")


def _best_window(positions: np.ndarray, codes: np.ndarray, span: int) -> tuple[int, int]:
    """The most distinct codes at positions within span of each other, and where the first such window begins."""
    best, start, i = 0, 0, 0
    held: dict[int, int] = {}
    for j in range(len(positions)):
        held[codes[j]] = held.get(codes[j], 0) + 1
        while positions[j] - positions[i] > span:
            if held[codes[i]] == 1:
                del held[codes[i]]
            else:
                held[codes[i]] -= 1
            i += 1
        if len(held) > best:
            best, start = len(held), i
    return best, int(positions[start])


def _pairs(hits: DataFrame, prefix: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, item, low, high): texts and items that meet in a prefix shingle within the bounds, and between which places a window that counts can be.

    Length: the text must have as many shingles as the item needs.  Place: around the hit, within the item's length and the
    text's ends, there must be room for as many.
    """
    room = F.least("pos", "span") + F.least(F.col("total") - 1 - F.col("pos"), F.col("span")) + 1
    near = hits.join(by_size(prefix), ["h", "gram"]).where((F.col("total") >= F.col("need")) & (room >= F.col("need")))
    return near.groupBy("doc_id", "row", "item_id", "item").agg(F.min(F.col("pos") - F.col("span")).alias("low"), F.max(F.col("pos") + F.col("span")).alias("high"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", lookup_keys: int = LOOKUP_KEYS) -> DataFrame:
    """(doc_id long, item_id long, containment double, start_word long) of every document and item where a window of as many words as the item has holds at least threshold of the item's distinct n-word shingles.

    containment is that share in the best window; start_word is where the
    earliest best window's first shared shingle begins.  An item of fewer than n words has one
    shingle, of all its words; one without words, or with a null id or text,
    matches nothing.  Documents with a null id or text, or without words, match
    nothing.  Rows that repeat an id, of documents or items, are compared text by text and give one row for each pair of ids, the best
    (of equal ones the earliest start).  Ties of rarity go by hash.

    A window that reaches the threshold shares one of the item's m - ceil(threshold
    * m) + 1 rarest shingles, so only those are joined.  Rarity is the number of
    documents that have a shingle, counted over all of them.  What the bounds of length and place leave
    is verified with all hits that are within an item's length of a prefix hit.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    row = F.xxhash64("text")
    sets = scratch(_item_shingles(texts(items, item_id_col, item_text_col).withColumn("item", row), n).dropDuplicates(["item_id", "item", "h"]))
    rows = texts(docs, id_col, text_col).withColumn("row", row)
    grams = sorted(r[0] for r in sets.select("gram").distinct().collect())  # at most n numbers
    keys = sets.select("h", "gram").distinct()
    few = keys.limit(lookup_keys + 1).count() <= lookup_keys
    lookup = None
    if few:
        found = np.array([r[0] for r in keys.select("h").toLocalIterator()], np.int64).view(np.uint64)
        lookup = docs.sparkSession.sparkContext.broadcast(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(lookup.value) if lookup is not None and len(lookup.value) else None
        for whole in batches:
            for batch in slices(whole, 1):
                hashes, bounds = words(batch.column(1))
                lengths = np.diff(bounds)
                ids, keyed = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for g in grams:
                    if lookup is not None and table is None:
                        continue
                    h, b = shingles(hashes, bounds, g)
                    at = table.find(h)[0] if table is not None else np.arange(len(h))
                    text = np.searchsorted(b, at, "right") - 1
                    whole_gram = lengths[text] >= g
                    at, text = at[whole_gram], text[whole_gram]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], keyed[text], at - b[text], np.diff(b)[text], np.full(len(at), g), h[at].view(np.int64))], ["doc_id", "row", "pos", "total", "gram", "h"])

    hits = rows.mapInArrow(cut, "doc_id long, row long, pos long, total long, gram long, h long")
    if not few:
        hits = hits.join(keys, ["h", "gram"], "left_semi")
    hits = scratch(hits.select("doc_id", "row", "pos", "total", "gram", "h"))
    rarity = hits.groupBy("h", "gram").agg(F.countDistinct("doc_id").alias("docs"))
    whole_item = Window.partitionBy("item_id", "item")
    ranked = (
        sets.join(rarity, ["h", "gram"], "left").withColumn("size", F.count("*").over(whole_item))
        .withColumn("rank", F.row_number().over(whole_item.orderBy(F.coalesce("docs", F.lit(0)), "h")))
        .withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - 1e-9))
    )
    ranked = scratch(ranked.select("item_id", "item", (F.col("n_words") - F.col("gram")).alias("span"), "gram", "h", "size", "rank", "need"))
    pairs = _pairs(hits, ranked.where("rank <= size - need + 1").select("item_id", "item", "span", "gram", "h", "need"))
    shared = (
        hits.select("doc_id", "row", "pos", "gram", "h").join(by_size(ranked), ["h", "gram"]).join(by_size(pairs), ["doc_id", "row", "item_id", "item"]).where("pos between low and high")
        .groupBy("doc_id", "row", "item_id", "item").agg(F.first("span").alias("span"), F.first("size").alias("size"), F.first("need").alias("need"), F.countDistinct("h").alias("distinct"), F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("at"))
        .where("distinct >= need")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                pos = np.array([x["pos"] for x in r["at"]])
                best, start = _best_window(pos, [x["h"] for x in r["at"]], r["span"])
                if best >= r["need"]:
                    out.append((r["doc_id"], r["item_id"], best / r["size"], start))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "containment", "start_word"])

    verified = shared.select("doc_id", "item_id", "span", "size", "need", "at").mapInArrow(verify, "doc_id long, item_id long, containment double, start_word long")
    best = verified.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("containment")).alias("less"), "start_word")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.less")).alias("containment"), "best.start_word")
