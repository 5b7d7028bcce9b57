"""Exact and near dedup, the first in order kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
_MASK = (1 << 64) - 1


def validate(num_hashes: int, num_bands: int, threshold: float) -> None:
    if num_bands <= 0 or num_hashes % num_bands or not 0 <= threshold <= 1:
        raise ValueError("num_bands must be above 0 and divide num_hashes, and the threshold be from 0 to 1")


def _few(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, which is counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def exact(df: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """df with duplicate_exact: true for all rows of a text but the first in order.

    A null text counts as an empty one. Values of order_col must be unique and not null; a column duplicate_exact is replaced.
    Digests and order are shuffled, and first those of a task with themselves, so a frequent text is no one task's work; the texts stay
    where they are unless a million rows are duplicates.
    """
    rows = df.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__d"), F.col(order_col).alias("__o"))
    first = rows.groupBy("__d").agg(F.count("*").alias("__n"), F.min("__o").alias("__first")).where("__n > 1").select("__d", "__first")
    again = scratch(rows.join(_few(scratch(first)), "__d").where(F.col("__o") > F.col("__first")).select("__o"))
    free = "__again" + "_" * max(map(len, df.columns))  # longer than any name there is
    marked = df.drop("duplicate_exact").join(_few(again.select(F.col("__o").alias(free))), F.col(order_col) == F.col(free), "left")
    return marked.withColumn("duplicate_exact", F.col(free).isNotNull()).drop(free)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


def coefficients(n: int) -> list[tuple[int, int]]:
    """Pairs (a, b) of the hash family, from a seeded xorshift generator."""
    state = 0x2545F4914F6CDD1D ^ 0x9E3779B97F4A7C15
    out = []

    def draw() -> int:
        nonlocal state
        state ^= state << 13 & _MASK
        state ^= state >> 7
        state ^= state << 17 & _MASK
        return state

    for _ in range(n):
        a = draw() % (PRIME - 1) + 1
        out.append((a, draw() % PRIME))
    return out


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """FNV-1a of the distinct windows of size characters; vectorised over windows by byte."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) <= size:
        return np.array([fnv1a(text.encode())], np.uint64)
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.append(starts, len(data))
    begin, end = edges[: len(starts) - size + 1], edges[size:]
    h = np.full(len(begin), 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int((end - begin).max())):
            at = begin + i
            live = at < end
            h[live] = (h[live] ^ data[at[live]]) * np.uint64(0x100000001B3)
    return np.unique(h)


def _mulmod(a: int, x: np.ndarray, b: int) -> np.ndarray:
    """(a * x + b) mod 2^61 - 1 in 64-bit parts."""
    p = np.uint64(PRIME)
    low, high = x & np.uint64(0x7FFFFFFF), x >> np.uint64(31)  # 31 and 30 bits
    a_low, a_high = np.uint64(a & 0x7FFFFFFF), np.uint64(a >> 31)
    middle = a_low * high + a_high * low  # below 2^62
    total = a_low * low + ((middle & np.uint64(0x3FFFFFFF)) << np.uint64(31))  # below 2^63
    total = (total & p) + (total >> np.uint64(61)) + ((a_high * high) << np.uint64(1)) + (middle >> np.uint64(30)) + np.uint64(b)
    total = (total & p) + (total >> np.uint64(61))
    return np.where(total >= p, total - p, total)


#: Windows of a text that are hashed at once.
WINDOWS = 1 << 16


def signature(text: str, num_hashes: int, shingle_size: int, family: list[tuple[int, int]] | None = None) -> np.ndarray:
    """The least values of num_hashes functions over a text's shingles; family is what coefficients gives for num_hashes."""
    if not text:
        return np.zeros(num_hashes, np.int64)
    family = family or coefficients(num_hashes)
    least = np.full(num_hashes, PRIME, np.uint64)
    for i in range(0, max(1, len(text) - shingle_size + 1), WINDOWS):
        x = _shingle_hashes(text[i : i + WINDOWS + shingle_size - 1], shingle_size) % np.uint64(PRIME)
        least = np.minimum(least, np.array([_mulmod(a, x, b).min() for a, b in family], np.uint64))
    return least.astype(np.int64)


def signatures(texts: pa.Array, num_hashes: int, shingle_size: int) -> pa.ListArray:
    """signature of each text, one text at a time; a null counts as an empty one."""
    family = coefficients(num_hashes)
    out = np.empty((len(texts), num_hashes), np.int64)
    for i, text in enumerate(texts):
        out[i] = signature(text.as_py() or "", num_hashes, shingle_size, family)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * num_hashes, pa.int32()), pa.array(out.ravel()))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        pass


def scratch(df: DataFrame, kind: str = "parquet") -> DataFrame:
    """Write a table to the folder that all executors share, spark.checkpoint.dir, and read it again. It is removed when the driver ends."""
    spark: SparkSession = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
    path = f"{where.rstrip('/')}/near-{uuid.uuid4().hex}"
    df.write.format(kind).save(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).format(kind).load(path)


def near(df: DataFrame, threshold: float = 0.85, num_hashes: int = 128, num_bands: int = 16, shingle_size: int = 25, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """(order_col, duplicate_of): rows that are near a kept row before them, with such a row.

    Rows share one of num_bands bands of their MinHash signatures and at least
    threshold of its places.  A row is dropped only for a kept one, as a
    sequential pass would do it: rounds keep rows without an earlier open
    neighbour and drop their neighbours, until no pair is open.  Values of order_col must be unique and not null; a null text counts as an empty one.

    Rows of one signature are one row in the rounds, the first: the others are dropped for it, or
    for what it is dropped for.
    """
    validate(num_hashes, num_bands, threshold)
    per = num_hashes // num_bands

    @F.arrow_udf("array<long>")
    def sign(texts: pa.Array) -> pa.Array:
        return signatures(texts, num_hashes, shingle_size)

    whole = scratch(df.select(F.col(order_col).alias("ord"), sign(F.col(text_col)).alias("sig")))
    rows = scratch(whole.groupBy("sig").agg(F.min("ord").alias("ord")))
    bands = rows.select("ord", F.posexplode(F.array(*(F.xxhash64(F.slice("sig", 1 + b * per, per)) for b in range(num_bands)))).alias("band", "key"))
    met = bands.toDF("a", "band", "key").join(bands.toDF("b", "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    equal = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    sigs = rows.select("ord", "sig")
    open_ = scratch(met.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").where(equal >= F.lit(threshold) * num_hashes - 1e-9).select("a", "b"))
    gone: list[DataFrame] = []
    while not open_.isEmpty():
        later = open_.select(F.col("b").alias("a")).distinct()
        roots = open_.join(later, "a", "left_anti")  # edges from rows that nothing open is before
        gone.append(scratch(roots.groupBy("b").agg(F.min("a").alias("duplicate_of"))))
        ids = gone[-1].select("b")
        open_ = scratch(open_.join(ids, "b", "left_anti").join(ids.withColumnRenamed("b", "a"), "a", "left_anti"))
    dropped = reduce(DataFrame.union, gone) if gone else open_.select("b", F.col("a").alias("duplicate_of"))
    first = rows.select("sig", F.col("ord").alias("first")).join(dropped.withColumnRenamed("b", "first"), "first", "left")
    every = whole.join(first, "sig").select("ord", F.coalesce("duplicate_of", F.when(F.col("ord") != F.col("first"), F.col("first"))).alias("duplicate_of"))
    return every.where("duplicate_of is not null").select(F.col("ord").alias(order_col), "duplicate_of")
