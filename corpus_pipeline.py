"""A corpus pipeline: toxic documents go, then exact copies, near copies and contaminated documents; what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, exact, jaccard, packing, toxicity
from lexloom.llm.common import scratch, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on these documents and the labels, rejects. Rows that repeat an id go if one of them is rejected; rows with a null id or text stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scratch(toxicity.score(docs, model).where("toxic and doc_id is not null").select("doc_id")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one of least id stays; of rows that repeat id and text, one. Rows with a null id or text stay."""
    copies = scratch(exact.exact_copies(docs))
    once = without(docs, copies.where("doc_id <> kept_id"))
    again = copies.where("doc_id = kept_id").select("doc_id").distinct()
    return exact.one_of_each(once, again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, connected by pairs that reach the threshold, the document of least id stays."""
    return without(docs, scratch(jaccard.jaccard_classes(docs).where("doc_id <> class_id").select("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return without(docs, scratch(decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of fixed length."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

#: The classifier's fit and best-fit packing are iterative; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
