"""Exact dedup: Grace hash partitioning with spill files and an open-addressing table."""

from __future__ import annotations

import atexit
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import by_size, remove, scratch, shared_dir, texts
from lexloom.llm.words import raw, slices

_SCHEMA = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("salted", pa.bool_())])
#: Bytes that a row counts for besides its text, where texts are divided.
ROW = 64


class ContentTable:
    """Open addressing with linear probing. A slot is taken by one content; equal hashes are told apart by the whole text. Of the copies only ids are held, 8 bytes each."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.salted: list[bool] = []
        self.ids: list[array] = []

    def _slot(self, h: int, text: str) -> int:
        mask = len(self.slots) - 1
        i = (h ^ (h >> 32)) & mask
        while (at := self.slots[i]) >= 0 and not (self.hashes[at] == h and self.contents[at] == text):
            i = (i + 1) & mask
        return i

    def add(self, h: int, doc_id: int, text: str, salted: bool = False) -> None:
        i = self._slot(h, text)
        if (at := self.slots[i]) >= 0:
            self.ids[at].append(doc_id)
            return
        self.slots[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(text)
        self.salted.append(salted)
        self.ids.append(array("q", [doc_id]))
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for at, h in enumerate(self.hashes):
                i = (h ^ (h >> 32)) & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = at

    def copies(self) -> Iterator[tuple[int, str, bool, np.ndarray]]:
        """(hash, text, salted, rising ids) of each content that has copies here or may have some elsewhere."""
        for h, text, salted, ids in zip(self.hashes, self.contents, self.salted, self.ids):
            if salted or len(ids) > 1:
                yield h, text, salted, np.sort(np.frombuffer(ids, np.int64))


class Grace:
    """Splits a stream of rows of _SCHEMA by the bits of h, level by level, until a bucket's text is within memory.

    A hash that fills the memory by itself isn't split: its rows go to a table, which holds each content once, and only
    the others to files.
    """

    def __init__(self, folder: str, memory: int, fan_out: int) -> None:
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.memory, self.bits = memory, max(1, fan_out.bit_length() - 1)
        self.spills = 0

    def copies(self, batches: Iterable[pa.RecordBatch], depth: int = 0) -> Iterator[tuple[int, str, bool, np.ndarray]]:
        batches, held, size = iter(batches), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > self.memory:
                break
        else:
            yield from self._table(held)
            return

        def rest() -> Iterator[pa.RecordBatch]:
            while held:
                yield held.pop(0)
            yield from batches

        values, sizes = self._bytes(held)
        hot = values[sizes * 2 >= size]
        if depth * self.bits >= 64:  # nothing is left to split by
            yield from self._table(rest())
            return
        table = ContentTable()
        paths = self._split(rest(), depth, hot, table)
        yield from table.copies()
        del table
        for path in paths:
            yield from self.copies(self._read(path), depth + 1)
            self.fs.delete_file(path)

    def _bytes(self, batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of these rows, and how many bytes each has."""
        h = np.concatenate([b.column(0).to_numpy() for b in batches])
        n = np.concatenate([np.diff(raw(b.column(2))[0]) for b in batches]) + 25
        values, at = np.unique(h, return_inverse=True)
        return values, np.bincount(at, n)

    @staticmethod
    def _fill(table: ContentTable, batch: pa.RecordBatch) -> None:
        for piece in slices(batch, 2):
            for row in zip(*(c.to_pylist() for c in piece.columns)):
                table.add(*row)

    def _table(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, bool, np.ndarray]]:
        table = ContentTable()
        for batch in batches:
            self._fill(table, batch)
        return table.copies()

    def _split(self, batches: Iterable[pa.RecordBatch], depth: int, hot: np.ndarray, table: ContentTable) -> list[str]:
        writers: dict[int, tuple] = {}
        paths = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            stays = np.isin(h, hot)
            if stays.any():
                self._fill(table, batch.filter(pa.array(stays)))
            bucket = (h.view(np.uint64) >> np.uint64(depth * self.bits)) & np.uint64((1 << self.bits) - 1)
            for b in np.unique(bucket[~stays]):
                if b not in writers:
                    if not writers:
                        self.spills += 1
                        self.fs.create_dir(self.folder, recursive=True)
                    path = f"{self.folder}/{uuid.uuid4().hex}.arrow"
                    stream = self.fs.open_output_stream(path)
                    writers[b] = (pa.ipc.new_stream(stream, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")), stream)
                    paths.append(path)
                writers[b][0].write_batch(batch.take(pa.array(np.flatnonzero((bucket == b) & ~stays))))
        for writer, stream in writers.values():
            writer.close()
            stream.close()
        return paths

    def _read(self, path: str) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(path) as stream:
            yield from pa.ipc.open_stream(stream)

    def close(self) -> None:
        if self.spills:
            self.fs.delete_dir(self.folder)


def _resolve(rows: DataFrame, folder: str, memory_bytes: int, fan_out: int) -> DataFrame:
    """(h, doc_id, kept_id, text) from rows of _SCHEMA that are partitioned: copies within a partition, as exact_copies has them. Of a salted content there is also a row with its text and, as both ids, the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = Grace(f"{folder}/{uuid.uuid4().hex}", memory_bytes, fan_out)  # another one for each attempt
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        held: list[tuple] = []
        size = 0
        try:
            for h, text, salted, ids in grace.copies(pa.RecordBatch.from_arrays(b.columns, schema=_SCHEMA) for b in batches if b.num_rows):
                if salted:
                    held.append((np.array([h]), ids[:1], ids[:1], [text]))
                    size += 1 + len(text)
                for i in range(1, len(ids), 100_000):
                    part = ids[i : i + 100_000]
                    held.append((np.broadcast_to(h, len(part)), part, np.broadcast_to(ids[0], len(part)), [None] * len(part)))
                    size += len(part)
                    if size >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if k < 3 else sum(c, []), t) for k, (c, t) in enumerate(zip(zip(*held), types))], ["h", "doc_id", "kept_id", "text"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if k < 3 else sum(c, []), t) for k, (c, t) in enumerate(zip(zip(*held), types))], ["h", "doc_id", "kept_id", "text"])
        finally:
            grace.close()

    return rows.mapInArrow(run, "h long, doc_id long, kept_id long, text string")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20, fan_out: int = 16) -> DataFrame:
    """(doc_id long, kept_id long): one row for every row whose text another row has too, but for the row that is kept.

    Of equal texts the row with the least id is kept; of rows that repeat an id
    as well, one (the others give doc_id = kept_id).  Texts are equal if all
    their bytes are; empty texts are equal to each other.  Rows with a null id
    or text take no part.  An empty table has no copies.

    Only hashes are shuffled for the first cut: a text whose 64-bit hash is its
    own has no copy.  The others are partitioned by hash, and each task splits its
    part further, by more bits of the hash, into spill files in the shared
    folder, until a bucket has at most memory_bytes and fits a table that
    compares whole texts.  A hash whose rows have more bytes than that is first salted by id:
    each salt leaves one row of each content, and those are compared in the same way.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).select(F.xxhash64("text").alias("h"), "doc_id", "text")
    sized = rows.groupBy("h").agg(F.count("*").alias("n"), F.ceil(F.sum(F.octet_length("text") + ROW) / memory_bytes).cast("int").alias("salts"))
    shared = scratch(sized.where("n > 1").select("h", "salts"))
    folder = f"{shared_dir(spark)}/grace-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)  # what lost executors leave
    there = rows.join(by_size(shared), "h").repartition("h", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    found = _resolve(there.select("h", "doc_id", "text", (F.col("salts") > 1).alias("salted")), folder, memory_bytes, fan_out)
    if shared.where("salts > 1").isEmpty():
        return found.select("doc_id", "kept_id")
    found = scratch(found)
    heads = found.where("text is not null").select("h", "doc_id", "text", F.lit(False).alias("salted"))
    last = scratch(_resolve(heads.repartition("h"), folder, memory_bytes, fan_out)).select("h", F.col("doc_id").alias("head"), F.col("kept_id").alias("least"))
    copies = found.where("text is null").join(by_size(last), (found["h"] == last["h"]) & (F.col("kept_id") == F.col("head")), "left")
    return copies.select("doc_id", F.coalesce("least", "kept_id").alias("kept_id")).union(last.select("head", "least"))


def one_of_each(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row only of those that repeat both an id in ids.doc_id and its text. Which one stays, where other columns differ, is their least value in order."""
    of = F.col(f"`{id_col}`").cast("long")
    again = by_size(ids.select(F.col("doc_id").alias("__again")))
    twice = docs.join(again, of == again["__again"], "left_semi").where(F.col(f"`{text_col}`").isNotNull())
    others = docs.join(again, (of == again["__again"]) & F.col(f"`{text_col}`").isNotNull(), "left_anti")
    key = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or [F.lit(1)])))
    free = "__nth" + "_" * max(map(len, docs.columns))  # longer than any name there is
    return others.unionByName(twice.withColumn(free, nth).where(F.col(free) == 1).drop(free))
