"""Files and folders of any Hadoop file system: paths without a scheme are those of the session's default one, which is the local disk unless set otherwise."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Marks a folder of results as the library's own.
MARK = "_lexloom"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file, whole or not at all, in place of one that is there; folders above it are made."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent()) if p.getParent() is not None else None
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(part, p)


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a pattern with a scheme names; a folder, and ** at the end of a pattern, stand for all files below. Local ones come without the scheme."""
    fs, p = _at(spark, pattern.removesuffix("/**"))
    out: list[str] = []
    for status in fs.globStatus(p) or []:
        if status.isFile():
            out.append(status.getPath().toString())
        else:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                out.append(files.next().getPath().toString())
    return [x[5:] if x.startswith("file:/") else x for x in out]


def claim(spark: SparkSession, path: str) -> None:
    """Make a folder of results and mark it; FileExistsError if there is something in it that isn't ours."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        inside = [s.getPath().getName() for s in fs.listStatus(p)]
        if fs.getFileStatus(p).isFile() or inside and MARK not in inside:
            raise FileExistsError(f"{path} exists and isn't a folder of this library's results")
    fs.mkdirs(p)
    write_text(spark, f"{path}/{MARK}", "")


def clear(spark: SparkSession, path: str) -> None:
    """Remove the results in a claimed folder."""
    fs, p = _at(spark, path)
    for s in fs.listStatus(p):
        if s.getPath().getName() != MARK:
            fs.delete(s.getPath(), True)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Move the files of a staged folder into a claimed one. May be done again where it broke off."""
    fs, p = _at(spark, staged)
    if not fs.exists(p):
        return
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if not name.startswith(("_", ".")):
            fs.rename(s.getPath(), _at(spark, f"{path}/{name}")[1])
    fs.delete(p, True)
