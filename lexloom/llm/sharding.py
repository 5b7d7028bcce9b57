"""Sharding: Karmarkar-Karp differencing of indivisible groups: the heaviest together, the others in tasks that even out what those left."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import by_size, scratch


def difference(weights: np.ndarray, k: int, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each weight and the sums of the k slots.

    Each weight is a partial partition with one slot in use.  The two of largest
    spread are combined in opposite orders, the largest slot of one with the
    smallest of the other, until one is left.  Ties go to the earlier one.  base is a
    partial partition with all slots in use, whose numbers the slots then have (its sums don't count in the result);
    without it slots are numbered by falling sum.  A partial partition holds its slots in use
    only, so that all take memory in proportion to the weights.
    """
    n = len(weights)
    up = np.arange(n + (k if base is not None else 0))  # slots by union-find: of each weight, then of base
    nodes: list[tuple[np.ndarray, np.ndarray] | None] = [(weights[i : i + 1].astype(np.int64), up[i : i + 1].copy()) for i in range(n)]
    if base is not None:
        order = np.argsort(-base, kind="stable")
        nodes.append((base[order].astype(np.int64), n + order))

    def spread(s: np.ndarray) -> int:
        return int(s[0] - (s[-1] if len(s) == k else 0))

    heap = [(-spread(s), i) for i, (s, _) in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (s, a), (t, b) = nodes[i], nodes[j]
        nodes[i] = nodes[j] = None
        both = max(0, len(s) + len(t) - k)  # slots that are in use in either
        if both:
            up[b[len(b) - both :][::-1]] = a[len(a) - both :]
            met = s[len(s) - both :] + t[len(t) - both :][::-1]
            s, a = np.concatenate([s[: len(s) - both], met, t[: len(t) - both]]), np.concatenate([a, b[: len(b) - both]])
        else:
            s, a = np.concatenate([s, t]), np.concatenate([a, b])
        order = np.argsort(-s, kind="stable")
        nodes.append((s[order], a[order]))
        heapq.heappush(heap, (-spread(nodes[-1][0]), len(nodes) - 1))
    while (up[up] != up).any():
        up = up[up]
    number = np.zeros(len(up), np.int64)
    if base is not None:
        number[up[n:]] = np.arange(k)
    elif n:
        number[up[nodes[-1][1]]] = np.arange(len(nodes[-1][1]))
    slot = number[up[:n]]
    return slot, np.bincount(slot, weights, k).astype(np.int64) if n < 1 << 20 and float(weights.sum()) < 2**52 else _sums(slot, weights, k)


def _sums(slot: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(k, np.int64)
    np.add.at(out, slot, weights.astype(np.int64))
    return out


_PLACED = "key long, slot int, weight long"


def _place(n_shards: int, base: Callable[[int], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Differencing of the groups of one partition. base gives the sums to even out, by the partition's own weight. After the groups come rows without a key: the weight of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], schema=pa.schema([("key", pa.int64()), ("weight", pa.int64())]))
        if not table.num_rows:
            return
        keys, weights = table["key"].to_numpy(), table["weight"].to_numpy()
        order = np.lexsort((keys, -weights))
        keys, weights = keys[order], weights[order]
        slot, sums = difference(weights, n_shards, base(int(weights.sum())) if base is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(slot.astype(np.int32)), pa.array(weights)], ["key", "slot", "weight"])
        yield pa.RecordBatch.from_arrays([pa.nulls(n_shards, pa.int64()), pa.array(np.arange(n_shards, dtype=np.int32)), pa.array(sums)], ["key", "slot", "weight"])

    return run


def _by_slot(placed: DataFrame, n_shards: int) -> np.ndarray:
    sums = np.zeros(n_shards, np.int64)
    for slot, weight in placed.where("key is null").groupBy("slot").agg(F.sum("weight")).collect():  # n_shards rows
        sums[slot] = weight
    return sums


def shard(docs: DataFrame, n_shards: int = 64, id_col: str = "doc_id", text_col: str = "text", groups_per_task: int = 20_000) -> DataFrame:
    """(doc_id long, n_bytes long, shard int) for every row of docs.

    All copies of a text are one indivisible group, so that none is split over
    shards; a group weighs the UTF-8 bytes of its rows.  A null text weighs 0 and
    belongs with the empty ones.  Rows that repeat stay together; rows without an
    id are placed as well.  With fewer groups than shards some shards are empty.

    The groups_per_task heaviest groups are differenced together, then those between, by classes of weight and about as many a task,
    and last the groups_per_task lightest.  Each of those tasks starts from a partial partition that holds its
    share of what the heavier ones left uneven, the last one from all that is still uneven, so the
    lighter groups even out the heavier ones as if they were differenced
    after them.  Up to groups_per_task groups this is plain differencing.  No task holds much more than groups_per_task
    groups and n_shards sums.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    if groups_per_task < 1:
        raise ValueError("groups_per_task must be at least 1")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("key"))
    groups = scratch(rows.groupBy("key").agg(F.sum("n_bytes").alias("weight")))
    n_groups = groups.count()
    falling, rising = [F.desc("weight"), F.asc("key")], [F.asc("weight"), F.desc("key")]

    def placed(some: DataFrame, base: Callable[[int], np.ndarray] | None = None) -> DataFrame:
        return scratch(some.select("key", "weight").mapInArrow(_place(n_shards, base), _PLACED))

    found = [placed(groups.orderBy(*falling).limit(groups_per_task).coalesce(1))]
    rest = n_groups - groups_per_task
    if rest > 0:
        sums = _by_slot(found[0], n_shards)
        last = min(rest, groups_per_task)
        lightest = groups.orderBy(*rising).limit(last).coalesce(1)
        if rest > last:
            heavy = found[0].where("key is not null").orderBy(*rising).select("weight", "key").first()
            light = lightest.orderBy(*falling).select("weight", "key").first()
            after = lambda x: (F.col("weight") < x[0]) | (F.col("weight") == x[0]) & (F.col("key") > x[1])
            before = lambda x: (F.col("weight") > x[0]) | (F.col("weight") == x[0]) & (F.col("key") < x[1])
            between = groups.where(after(heavy) & before(light))
            step = max(2.0, groups_per_task / (4 * n_shards))  # so that in a task no group weighs more than its mean slot
            kind = F.floor(F.log(heavy[0] / F.greatest("weight", F.lit(1))) / math.log(step)).cast("int")
            classed = between.withColumn("kind", kind)
            for c, n, whole in sorted(map(tuple, classed.groupBy("kind").agg(F.count("*"), F.sum("weight")).collect())):  # as many as powers of step in a long
                uneven = sums - sums.min()
                share = lambda own, uneven=uneven, whole=max(1, whole): np.floor(uneven * (own / whole)).astype(np.int64)
                found.append(placed(classed.where(F.col("kind") == c).repartition(-(-n // groups_per_task), "key"), share))
                sums = sums + _by_slot(found[-1], n_shards)
        found.append(placed(lightest, lambda own: sums - sums.min()))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    of = every.where("key is not null").select("key", F.col("slot").alias("shard"))
    return rows.join(by_size(of, n_groups), "key").select("doc_id", "n_bytes", "shard")
