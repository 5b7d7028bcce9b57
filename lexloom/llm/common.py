"""What the operators share: input columns, scratch tables, joins by checked size."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one 64-bit key that may be broadcast; above it a shuffle join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext._jsc.sc()
        found = context.getCheckpointDir()
        where = found.get() if found.isDefined() else ""
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def scratch(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what no table refers to any more, so that the shuffle files of finished steps leave the disks before the next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession) -> int:
    """How many parts a step that makes its own partitions cuts its rows into."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(rows: DataFrame, each: int = 16 << 20, text_col: str = "text") -> int:
    """How many parts such a step needs for these texts: each of them stands for no more than so many bytes of text, whatever the settings."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(buckets(rows.sparkSession), -(-total // each))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of the rows that have both an id and a text; every other column is left behind, so none can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and text is not null")


def by_size(keys: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys with a broadcast hint if they are few (counted, unless rows is given); else as they are, for a shuffle join."""
    n = keys.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(keys) if n <= limit else keys


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids.doc_id. Rows with a null id stay."""
    gone = by_size(ids.select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == gone["__gone"], "left_anti")
