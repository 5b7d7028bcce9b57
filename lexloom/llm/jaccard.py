"""N-gram Jaccard join: a grouped prefix join of documents' shingle sets, and the groups it leads to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import by_size, parts, release, scratch, texts
from lexloom.llm.words import ids_of, mix, shingles, slices, tidy, words

#: Runs of values by owner, cut by bucket: owners and counts describe whose values follow each other in h.
_RUNS = "bucket int, owners binary, sizes binary, counts binary, h binary, df binary"
#: Bytes of a shingle, besides its bucket, by which documents that share none are ruled out: shingles that agree in them by chance keep a document in, never out.
COUNTED = 5
#: Groups that meet in one cell; larger clusters are cut into blocks, and every two blocks are a cell.
BLOCK = 1024
_SCHEMA = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("owners", "sizes", "counts", "h", "df"))])


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their bounds."""
    h, bounds = shingles(*words(column), n)
    text = ids_of(bounds)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.searchsorted(text[first], np.arange(len(bounds)))


def _cut(bucket: np.ndarray, owner: np.ndarray, size: np.ndarray, h: np.ndarray, width: int, df: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of _RUNS. owner must be grouped; width is the number of low bytes of h that are kept (the bucket tells the others)."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner, size, h = bucket[order], owner[order], size[order], h[order]
    df = df[order] if df is not None else None
    low = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :width]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    rows: list[list] = [[] for _ in _SCHEMA]
    for a, b in zip(edges, np.r_[edges[1:], len(bucket)]):
        starts = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]]) + a
        for column, x in zip(rows, (int(bucket[a]), owner[starts].tobytes(), size[starts].astype(np.int32).tobytes(), np.diff(np.r_[starts, b]).astype(np.uint32).tobytes(), low[a:b].tobytes(), df[a:b].tobytes() if df is not None else b"")):
            column.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _SCHEMA.types)], schema=_SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By bucket: (bucket, owner, size, h, df), an entry for each value. Holds what one partition has."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            for column, x in zip(held.setdefault(bucket, [[], [], [], [], []]), parts):
                column.append(x)
    for bucket in list(held):
        owners, sizes, counts, h, df = (b"".join(x) for x in held.pop(bucket))
        n = np.frombuffer(counts, np.uint32)
        full = np.zeros((int(n.sum()), 8), np.uint8)
        full[:, :width] = np.frombuffer(h, np.uint8).reshape(-1, width)
        del h
        yield bucket, np.repeat(np.frombuffer(owners, np.int64), n), np.repeat(np.frombuffer(sizes, np.int32), n), full.view(np.uint64)[:, 0], np.frombuffer(df, np.uint16)
    tidy()


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(48)) * np.uint64(n) >> np.uint64(16)).astype(np.int32)


def _spread(runs: DataFrame, n: int) -> DataFrame:
    return runs.repartition(n, "bucket")


def _frequent(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct (h, owner), and how many owners each of those values has."""
    order = np.lexsort((owner, h))
    o, x = owner[order], h[order]
    own = np.ones(len(x), bool)
    own[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
    order, x = order[own], x[own]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    number = np.diff(np.r_[starts, len(x)])
    return order, np.repeat(number, number)


def _alive(rows: DataFrame, n: int, threshold: float, cuts: int) -> DataFrame:
    """Ids of documents of whose shingles at least threshold occur in another document too; no other document can be in a pair."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                h, bounds = sets_of(batch.column(1), n)
                yield from _cut(_bucket(h, cuts), np.repeat(batch.column(0).to_numpy(), np.diff(bounds)), np.zeros(len(h), np.int32), h, COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, _, h, _ in _runs(batches, COUNTED):
            order, df = _frequent(owner, h)
            ids, at = np.unique(owner[order], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, df > 1, len(ids)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(ids)).astype(np.int64))], ["doc_id", "shared", "total"])

    counted = _spread(rows.mapInArrow(cut, _RUNS), cuts).mapInArrow(count, "doc_id long, shared long, total long")
    enough = counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.sum("total").alias("total")).where(F.col("shared") >= F.ceil(F.col("total") * F.lit(threshold) - 1e-9)).select("doc_id")
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")  # their counts are of several texts
    return scratch(enough.union(repeated).distinct())


def _prefixes(sets: DataFrame, threshold: float, cuts: int) -> DataFrame:
    """(node, size, lone, g1, g2, prefix): what of each node's prefix other nodes have too, in order of rarity; lone shingles of its own come before. g1 and g2 stand for the prefix and size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                size = part.column(1).to_numpy()
                h = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)
                yield from _cut(_bucket(h, cuts), np.repeat(part.column(0).to_numpy(), size), np.repeat(size, size), h, 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, size, h, _ in _runs(batches, 8):
            order, df = _frequent(owner, h)
            order, df = order[df > 1], df[df > 1]
            back = np.argsort(owner[order], kind="stable")
            order, df = order[back], np.minimum(df[back], 65535).astype(np.uint16)
            yield from _cut((mix(owner[order].view(np.uint64)) % np.uint64(cuts)).astype(np.int32), owner[order], size[order], h[order], 8, df)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, size, h, df in _runs(batches, 8):
            order = np.lexsort((h, df, owner))
            owner, size, h = owner[order], size[order], h[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            number = np.diff(np.r_[starts, len(owner)])
            size = size[starts].astype(np.int64)
            least = np.ceil(size * threshold - 1e-9).astype(np.int64)
            take = size - least + 1 - (size - number)  # of the shared ones; those of its own alone are rarer
            kept = np.flatnonzero(take > 0)
            if not len(kept):
                continue
            take = take[kept]
            at = np.repeat(starts[kept], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            prefix, bounds = h[at], np.r_[0, np.cumsum(take)]
            lone = (size - number)[kept]
            with np.errstate(over="ignore"):
                g1 = np.add.reduceat(mix(prefix), bounds[:-1]) + mix(size[kept].view(np.uint64))
                g2 = np.add.reduceat(mix(prefix ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1])
            ids = owner[starts[kept]]
            g1 = np.where(lone > 0, ids.view(np.uint64), g1)  # a lone shingle makes the prefix the node's own
            g2 = np.where(lone > 0, np.uint64(0), g2 | np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size[kept]), pa.array(lone), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(prefix.view(np.int64)))], ["node", "size", "lone", "g1", "g2", "prefix"])

    ranked = _spread(sets.select("node", "size", "h").mapInArrow(cut, _RUNS), cuts).mapInArrow(count, _RUNS)
    return scratch(_spread(ranked, cuts).mapInArrow(choose, "node long, size long, lone long, g1 long, g2 long, prefix array<long>"))


def _candidates(groups: DataFrame, threshold: float, cuts: int) -> DataFrame:
    """(a, b, cell): pairs of groups with a shingle in common in the prefixes that can reach the threshold by their sizes and its places.

    Shingles meet by the least group that has them, so that those of one
    cluster are together and a pair that shares many of them is found once, and not
    once for each.  A cluster of more than BLOCK groups is cut into blocks by hash; two blocks make a cell,
    so no task holds more than two of them.
    """
    index = groups.select("g", "size", "lone", F.posexplode("prefix").alias("place", "h")).select("h", "g", "size", (F.col("place") + F.col("lone")).alias("place"))
    met = scratch(index.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("least")).where("n > 1"))
    wide = met.groupBy("least").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    located = index.join(by_size(met.join(by_size(wide), "least", "left").select("h", "least", F.coalesce("blocks", F.lit(1)).alias("blocks"))), "h")
    block = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int").alias("block")
    cells = located.select("h", "g", "size", "place", "least", block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("least", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    rows = cells.select(cell, "h", "size", "g", "place", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "cell"):
            cell, h, size, g, place, side = (table[c].to_numpy() for c in ("cell", "h", "size", "g", "place", "side"))
            indexed = size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1  # of the smaller set fewer have to be looked at
            left = np.flatnonzero(place < indexed)
            found, held = [], 0

            def distinct() -> np.ndarray:
                every = np.concatenate(found)
                every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
                return every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)]]

            def result(x: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["a", "b", "cell"])

            step = 1
            while len(left):
                left = left[left + step < len(h)]
                right = left + step
                near = (h[right] == h[left]) & (cell[right] == cell[left]) & (size[left] >= threshold * size[right] - 1e-9)
                left, right = left[near], right[near]
                most = np.minimum(size[left] - place[left], size[right] - place[right])
                good = (most >= threshold / (1 + threshold) * (size[left] + size[right]) - 1e-9) & ((side[left] == 0) | (side[left] != side[right]))
                if good.any():
                    a, b = g[left[good]], g[right[good]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b), cell[left[good]]], 1))
                    held += len(a)
                    if held > 2_000_000:
                        found = [distinct()]
                        held = len(found[0])
                        if held > 1_000_000:
                            yield result(found[0])
                            found, held = [], 0
                step += 1
            if found:
                yield result(distinct())

    sorted_rows = rows.repartition(cuts, "cell").sortWithinPartitions("cell", "h", "size", "g")
    return sorted_rows.mapInArrow(pair, "a long, b long, cell long").groupBy("a", "b").agg(F.min("cell").alias("cell"))


def _whole(batches: Iterator[pa.RecordBatch], column: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches of sorted rows put together so that no value of the column is cut: about as many rows each, or one value's."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            values = batch.column(column).to_numpy()
            last = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
            if last or held[:-1] and held[-2].column(column)[-1].as_py() != values[0]:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
                n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")


class _Forest:
    """Union-find over the pairs of a task: which of them join what isn't connected yet."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x] = top
            x = above
        return top

    def joins(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(p) > len(q):
        p, q = q, p
    place = np.searchsorted(q, p)
    place[place == len(q)] = 0
    return int((q[place] == p).sum())


def _similar(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, pairs_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, least, members), ids (node, doc_id) and what the verified pairs of nodes give.

    That is every pair as (x, y, value = Jaccard) if pairs_only; else for each node parts of the number of documents
    in similar nodes, as (x, null, number), and enough of the pairs to connect all that are, as (x, y, null).
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    cuts = parts(rows)
    alive = _alive(rows, n, threshold, cuts)
    release(spark)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                h, bounds = sets_of(batch.column(1), n)
                some = np.flatnonzero(np.diff(bounds))
                if not len(some):
                    continue
                with np.errstate(over="ignore"):
                    f1 = np.add.reduceat(mix(h), bounds[some])
                    f2 = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(np.diff(bounds)[some].astype(np.int32)), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())], ["doc_id", "f1", "f2", "size", "h"])

    same = ["f1", "f2", "size"]
    whole = scratch(rows.join(by_size(alive), "doc_id", "left_semi").mapInArrow(collect, "doc_id long, f1 long, f2 long, size int, h binary"))
    owners = whole.select("doc_id", *same).distinct()
    nodes = scratch(owners.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).withColumn("node", F.monotonically_increasing_id()))
    ids = owners.join(by_size(nodes), same).select("node", "doc_id", "least")
    sets = whole.join(by_size(nodes.withColumnRenamed("least", "doc_id")), ["doc_id", *same]).dropDuplicates(["node"]).select("node", "size", "members", "h")
    prefixes = _prefixes(sets, threshold, cuts)
    release(spark)
    alike = Window.partitionBy("g1", "g2", "size")
    members = prefixes.withColumn("g", F.min("node").over(alike)).withColumn("blocks", F.ceil(F.count("*").over(alike) / BLOCK).cast("int"))
    members = scratch(members.select("g", "node", "size", "lone", F.when(F.col("g") == F.col("node"), F.col("prefix")).alias("prefix"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")))
    met = _candidates(members.where("g = node"), threshold, cuts)
    own = members.select("g", "node", "block")
    left, right = own.toDF("a", "x", "i"), own.toDF("b", "y", "j")
    between = met.join(left, "a").join(right, "b").select(F.xxhash64("cell", "i", "j").alias("cell"), "x", "y")
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.xxhash64("a", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "x", "y")
    pairs = scratch(between.union(within))
    release(spark)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, forest, links = None, {}, _Forest(), {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(links.keys(), pa.int64()), pa.nulls(len(links), pa.int64()), pa.array(links.values(), pa.float64())], ["x", "y", "value"])

        for batch in batches:
            out: list[tuple[int, int, float | None]] = []
            for k, x, y, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, held = k, {}
                if y is None:
                    held[x] = np.frombuffer(content, np.uint64), number
                    continue
                (p, mine), (q, yours) = held[x], held[y]
                common = _common(p, q)
                j = common / (len(p) + len(q) - common)
                if j < threshold - 1e-12:
                    continue
                if pairs_only:
                    out.append((x, y, j))
                else:
                    links[x] = links.get(x, 0) + yours
                    links[y] = links.get(y, 0) + mine
                    if forest.joins(x, y):
                        out.append((x, y, None))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["x", "y", "value"])
            if len(links) > 200_000:
                yield counted()
                forest, links = _Forest(), {}
        yield counted()

    # pairs are verified where their cell is, so that a set travels once for all its pairs there
    wanted = pairs.select("cell", F.col("x").alias("node")).union(pairs.select("cell", "y")).distinct()
    content = sets.select("node", "members", F.col("h").alias("content")).join(by_size(wanted), "node").select("cell", F.col("node").alias("x"), F.lit(None).cast("long").alias("y"), "members", "content")
    both = content.union(pairs.select("cell", "x", "y", F.lit(None).cast("long"), F.lit(None).cast("binary")))
    found = scratch(both.repartition(cuts, "cell").sortWithinPartitions("cell", F.col("y").asc_nulls_first()).mapInArrow(verify, "x long, y long, value double"))
    return nodes, ids, found


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.45, id_col: str = "doc_id", text_col: str = "text", expand: bool = False) -> DataFrame:
    """(doc_id long, other_id long, jaccard double): pairs of documents whose sets of n-word shingles have at least this Jaccard similarity.

    Documents with equal sets are listed once: each of them with the one of
    least id, as (its id, least id, 1.0).  Between different sets a pair is listed for the least ids
    of the two, the larger id first; the other documents of the sets are in the same pairs.
    So the result says everything and yet a text with a million copies takes
    a million rows.  expand=True lists every pair of documents instead.

    A text of fewer than n words has one shingle, of all of them; one without
    words, and rows with a null id or text, are in no pair.  Rows that repeat an
    id are texts of their own, but an id is in no pair with itself.

    Documents of whose shingles too few occur elsewhere are left out first.
    For the others shingles are ordered by rarity; nodes with the same prefix and
    size are one group, groups meet in the shingles of their prefixes, sizes and places
    rule pairs out, and the members of the pairs left are verified with whole sets.
    """
    _check(threshold)
    nodes, ids, similar = _similar(docs, n, threshold, id_col, text_col, True)
    similar = similar.where("y is not null").select("x", "y", F.col("value").alias("jaccard"))
    if expand:
        p = similar.join(ids.select(F.col("node").alias("x"), F.col("doc_id").alias("p")), "x").join(ids.select(F.col("node").alias("y"), F.col("doc_id").alias("q")), "y").select("p", "q", "jaccard")
        twins = ids.select("node", F.col("doc_id").alias("p")).join(ids.select("node", F.col("doc_id").alias("q")), "node").where("p > q").select("p", "q", F.lit(1.0).alias("jaccard"))
    else:
        of = nodes.select("node", "least")
        p = similar.join(of.toDF("x", "p"), "x").join(of.toDF("y", "q"), "y").select("p", "q", "jaccard")
        twins = ids.where("doc_id <> least").select(F.col("doc_id").alias("p"), F.col("least").alias("q"), F.lit(1.0).alias("jaccard"))
    every = p.union(twins).where("p <> q").select(F.greatest("p", "q").alias("doc_id"), F.least("p", "q").alias("other_id"), "jaccard")
    return every.groupBy("doc_id", "other_id").agg(F.max("jaccard").alias("jaccard"))


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.45, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, class_id long, n_links long): one row for every document that is similar to another.

    class_id is the least id of all documents that it is connected with by
    pairs of the threshold, n_links the number of documents that it is in a pair with, those with an equal
    set among them: every pair that jaccard_join with expand=True lists is verified
    and counted, none is written.  A document without a pair has no row.

    A text of fewer than n words has one shingle, of all of them; one without
    words, and rows with a null id or text, are in no pair.  Rows that repeat id and set count once; rows that
    repeat an id with other sets are documents of their own that share a row: their links are
    added up, those between them too, and the class is the least of theirs.
    """
    _check(threshold)
    nodes, ids, found = _similar(docs, n, threshold, id_col, text_col, False)
    links = found.where("y is null").groupBy(F.col("x").alias("node")).agg(F.sum("value").cast("long").alias("links"))
    of = nodes.select("node", "least")
    edges = found.where("y is not null").join(by_size(of.toDF("x", "p")), "x").join(by_size(of.toDF("y", "q")), "y").select("p", "q")
    heads = components(edges, "p", "q").toDF("least", "head")
    known = nodes.join(by_size(links), "node", "left").join(by_size(heads), "least", "left").select("node", F.coalesce("head", "least").alias("class_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    return ids.select("node", "doc_id").join(by_size(known), "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def components(pairs: DataFrame, a: str = "doc_id", b: str = "other_id", rounds: int = 60) -> DataFrame:
    """(doc_id long, kept_id long): for every id in pairs the least id that it is connected with, itself left out.

    Large-star and small-star steps by turns: each links every id to the least of its
    neighbours, so that stars are left after a number of rounds that grows with the logarithm of the longest chain.
    """
    edges = scratch(pairs.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, scratch(small)
        changed = edges.exceptAll(before).limit(1).count() or before.exceptAll(edges).limit(1).count()
        if not changed:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("kept_id"))
    raise RuntimeError(f"groups aren't settled after {rounds} rounds")
