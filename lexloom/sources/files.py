"""Readers of JSON Lines, text, HTML and WARC files as rows in a fixed order, and writers of results."""

from __future__ import annotations

import glob
import gzip
import io
import json
import os
import re
import warnings
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.functions.text import WS
from lexloom.sources import storage

ROW = "ord struct<file_rank:int,rec_no:long>, id string, source_path string, text string, meta string, error string"


def discover(patterns: Sequence[str], spark: SparkSession | None = None) -> list[str]:
    """Files that the patterns name, sorted, each once. A folder stands for what is in it; ** goes into subfolders; what matches nothing is left out, with a warning. Patterns with a scheme (hdfs://, s3a://, ...) need the session."""
    found: set[str] = set()
    for p in patterns:
        if "://" in p:
            names = set(storage.find(spark or SparkSession.active(), p))
        else:
            q = os.path.join(p, "**") if os.path.isdir(p) else p
            names = {x for x in ([q] if os.path.isfile(q) else glob.glob(q, recursive=True)) if os.path.isfile(x)}
        if not names:
            warnings.warn(f"no file matches {p}", stacklevel=2)
        found |= names
    return sorted(found)


def unreadable(files: Sequence[str]) -> dict[str, str]:
    """Local files that can't be opened, and why."""
    out: dict[str, str] = {}
    for f in files:
        if "://" not in f:
            try:
                with open(f, "rb"):
                    pass
            except OSError as e:
                out[f] = str(e)
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table as read, over as many parts as there are cores if it comes in fewer: a file of one row group is one task otherwise. What comes in more stays as it is, so this moves little."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _path() -> Column:
    return F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def _ranked(spark: SparkSession, df: DataFrame, files: Sequence[str]) -> DataFrame:
    names = spark.createDataFrame([(f if "://" in f else os.path.abspath(f), f, i) for i, f in enumerate(files)], "full string, source_path string, file_rank int")
    return df.join(F.broadcast(names) if len(files) <= 100_000 else names, "full")


def _row(id_: Column, meta: Column | None = None, error: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [F.struct(F.col("file_rank").cast("int").alias("file_rank"), F.col("rec_no").cast("long").alias("rec_no")).alias("ord"), id_.alias("id"), "source_path", "text", (F.lit("{}") if meta is None else meta).alias("meta"), (null if error is None else error).alias("error")]


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Numbered lines of all files; of a file with invalid UTF-8 those before it, and one row with an error.

    Lines are numbered where they are read: a first pass counts those of each block of a file, sums over the blocks before give
    each block its first number. Only a row a block is shuffled, so a file of any size is read by many tasks.
    """
    raw = spark.read.text(list(files), lineSep="\n").select(_path().alias("full"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    blocks = raw.groupBy("full", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.min(F.when(~F.is_valid_utf8("value"), F.col("__at"))).alias("__bad"))
    before = Window.partitionBy("full").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
    blocks = blocks.withColumn("__bad", F.min(F.col("__start") + F.col("__bad")).over(Window.partitionBy("full"))).select("full", "__block", "__start", "__bad")
    numbered = raw.join(blocks, ["full", "__block"]).withColumn("rec_no", F.col("__start") + F.col("__at")).where("__bad is null or rec_no <= __bad")
    return _ranked(spark, numbered.withColumn("error", F.when(F.col("rec_no") == F.col("__bad"), F.lit("invalid UTF-8"))), files)


def _blank(c: Column) -> Column:
    return F.length(F.btrim(c, F.lit(WS))) == 0


def read_text(spark: SparkSession, files: Sequence[str], whole: bool = False) -> DataFrame:
    """One row for each line that isn't blank, or for each file."""
    if whole:
        raw = spark.read.text(list(files), wholetext=True).select(_path().alias("full"), "value", F.lit(0).alias("rec_no"))
        rows = _ranked(spark, raw, files).withColumn("error", F.when(~F.is_valid_utf8("value"), F.lit("invalid UTF-8")))
        return rows.where(~_blank(F.col("value")) | F.col("error").isNotNull()).withColumn("text", F.when(F.col("error").isNull(), F.col("value"))).select(_row(F.col("source_path"), error=F.col("error")))
    rows = _lines(spark, files).withColumn("text", F.when(F.col("error").isNull(), F.rtrim(F.col("value"), F.lit("\r\n"))))
    return rows.where(F.col("error").isNotNull() | ~_blank(F.col("text"))).select(_row(F.concat_ws(":", "source_path", "rec_no"), error=F.col("error")))


def read_html(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return read_text(spark, files, whole=True)


def read_jsonl(spark: SparkSession, files: Sequence[str], text_field: str = "text", meta_fields: Sequence[str] = ()) -> DataFrame:
    """One row for each object whose text field is a string; other lines are skipped. meta keeps the named fields that are there."""
    at = lambda f: F.try_variant_get("__v", "$['" + f.replace("'", "\\'") + "']", "variant")
    rows = _lines(spark, files).withColumn("__v", F.try_parse_json(F.when(F.col("error").isNull(), F.col("value"))))
    fields = [F.when(at(f).isNotNull(), F.concat(F.lit(json.dumps(f) + ":"), F.to_json(at(f)))) for f in meta_fields]
    meta = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")) if fields else F.lit("{}")
    rows = rows.withColumn("text", F.when(F.schema_of_variant(at(text_field)) == "STRING", F.try_variant_get("__v", "$['" + text_field.replace("'", "\\'") + "']", "string")))
    return rows.where("text is not null or error is not null").select(_row(F.concat_ws(":", "source_path", "rec_no"), meta, F.col("error")))


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; ValueError where the file breaks off."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while True:
            line = stream.readline()
            if not line:
                raise ValueError("end of file in headers")
            if not line.strip():
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        size = int(headers["Content-Length"]) if re.fullmatch(r"\d+", headers.get("Content-Length", "")) else 0
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("end of file in a record")
        yield headers, block


def http_body(block: bytes) -> bytes:
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(mark)
        if found:
            return body
    return block


def _open(path: str):
    if "://" in path:
        system, place = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
        return io.BufferedReader(system.open_input_file(place))
    return open(path, "rb")


class _Warc(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, f)) for i, f in enumerate(self.files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rank, path = partition.value
        n = 0
        try:
            with _open(path) as raw, gzip.open(raw, "rb") if path.lower().endswith(".gz") else raw as stream:
                for headers, block in warc_records(stream):
                    if headers.get("WARC-Type") != "response":
                        continue
                    n += 1
                    url, text = headers.get("WARC-Target-URI"), http_body(block).decode("utf-8", "replace")
                    if text.strip():
                        yield (rank, n), url or f"{path}:{n}", path, text, json.dumps({"url": url} if url else {}), None
        except (OSError, EOFError, ValueError) as e:
            yield (rank, n + 1), f"{path}:{n + 1}", path, None, "{}", str(e)


class WarcSource(DataSource):
    """format("warc"): responses of WARC files, gzipped or not, one partition for each file. Option files: a JSON list of paths."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Warc(json.loads(self.options["files"]))


def read_warc(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", json.dumps(list(files))).load()


def read(spark: SparkSession, kind: str, files: Sequence[str], text_mode: str = "newline_delimited", text_field: str = "text", meta_fields: Sequence[str] = ()) -> DataFrame:
    """Rows of ROW, whichever kind of file they are from."""
    if not files:
        return spark.createDataFrame([], ROW)
    kinds = {"jsonl": lambda: read_jsonl(spark, files, text_field, meta_fields), "text": lambda: read_text(spark, files, text_mode == "one_file_per_document"), "html": lambda: read_html(spark, files), "warc": lambda: read_warc(spark, files)}
    if kind not in kinds:
        raise ValueError(f"unknown input format {kind!r}")
    given, failed = files, unreadable(files)
    files = [f for f in given if f not in failed]
    if not failed:
        return kinds[kind]()
    errors = spark.createDataFrame([((given.index(f), 0), f, f, None, "{}", why) for f, why in failed.items()], ROW)
    return kinds[kind]().union(errors) if files else errors


def write(df: DataFrame, kind: str, path: str, append: bool = False, shard_max_rows: int | None = None, staged: str | None = None) -> None:
    """JSON Lines (nulls included, meta as an object) or Parquet files in the folder path, with at most shard_max_rows rows each.

    Results that an earlier call left there are replaced unless append; a folder with anything else in it is refused.
    staged: a name; the files go to a folder of this name in path and are moved by storage.publish.
    """
    spark = df.sparkSession
    if kind not in ("jsonl", "parquet"):
        raise ValueError(f"unknown output format {kind!r}")
    storage.claim(spark, path)
    if not append:
        storage.clear(spark, path)
    out = df
    if kind == "jsonl":
        if "meta" in df.columns:
            out = out.withColumn("meta", F.parse_json("meta"))
        out = out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    writer = out.write.mode("append")
    if shard_max_rows:
        writer = writer.option("maxRecordsPerFile", shard_max_rows)
    where = f"{path}/{staged}" if staged else path
    writer.text(where) if kind == "jsonl" else writer.parquet(where)
