"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import by_size

RUN = "length long, first_rank long, ranks long, first_bin long, per_bin long, at long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Lengths fall; each item goes to the open bin with the least room that holds
    it, else to a new one.  Bins of equal room are one class and are filled
    together, so the work depends on the number of lengths, not of items.  A run
    (length, first_rank, ranks, first_bin, per_bin, at) says that the item of
    rank first_rank + i goes to bin first_bin + i // per_bin, at the position
    at + (i % per_bin) * length.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # that some bins have, rising
    bins: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, number)
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, number = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            else:
                room, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            per = room // length
            full = min(number, left // per)
            at = capacity - room
            if full:
                runs.append((length, rank, full * per, first, per, at))
                put(room - per * length, first, full)
                rank += full * per
                left -= full * per
            if full < number:
                if left and left < per:
                    runs.append((length, rank, left, first + full, left, at))
                    put(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                put(room, first + full, number - full)
    return runs


def pack(docs: DataFrame, capacity: int = 32_768, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, spread: int = 64) -> DataFrame:
    """(doc_id long, piece long, length long, bin long, at long): where every document's tokens go, in sequences of capacity.

    Tokens are UTF-8 bytes and an end mark, so an empty or null text has length 1;
    length_col names a column of token counts to use in their place (null or less
    than 1 counts as 1).  A longer document than capacity is cut into pieces of
    capacity and a rest.  Every row of docs is packed, repeated rows and rows
    with a null id too, each in its own place; an empty table packs nothing.

    Only the histogram of lengths, at most capacity counts, reaches the driver.
    A piece finds its run of the plan by its rank among the pieces of its
    length; ranks are counted in spread parts of each length, so that a
    frequent length isn't one task's work.
    """
    length = F.octet_length(F.col(f"`{text_col}`").cast("string")) + 1 if length_col is None else F.col(f"`{length_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.greatest(F.lit(1), F.coalesce(length.cast("long"), F.lit(1))).alias("n"))
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece")).select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("length"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)))
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("number"))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("number")).collect()}
    runs = plan(counts, capacity)
    spark = docs.sparkSession
    table = spark.createDataFrame(pd.DataFrame(np.array(runs, np.int64).reshape(-1, 6), columns=[c.split()[0] for c in RUN.split(", ")]), RUN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "part", F.coalesce(F.sum("number").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("nth", within).join(starts, ["length", "part"]).select("doc_id", "piece", "length", (F.col("start") + F.col("nth") - 1).alias("rank"))
    i = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(by_size(table, len(runs), 2_000_000), "length").where((i >= 0) & (i < F.col("ranks")))
        .select("doc_id", "piece", "length", (F.col("first_bin") + F.floor(i / F.col("per_bin"))).cast("long").alias("bin"), (F.col("at") + (i % F.col("per_bin")) * F.col("length")).cast("long").alias("at"))
    )
