"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, exact, html, jaccard, languages, packing, passages, sharding, tokens, toxicity
from lexloom.llm.words import WORD_RE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op2_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.mixtures(docs, languages.train(docs))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_language_mixtures, op3_sharding, op4_decontamination, op5_toxicity, op6_jaccard_join, op7_packing, op8_exact_dedup, op9_repeated_passages, op10_html_extraction)}

_WORDS = f"regexp_extract_all(lower(text), '{WORD_RE}')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT item_id, w, len(w) AS n_words, least(5, len(w)) AS gram FROM i WHERE len(w) > 0),
        s AS (SELECT DISTINCT item_id, n_words, gram, array_to_string(w[p:p + gram - 1], ' ') AS h FROM (SELECT *, unnest(range(1, n_words - gram + 2)) AS p FROM g)),
        m AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS size FROM s),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        q AS (SELECT doc_id, w, gram, unnest(range(1, len(w) - gram + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT gram FROM g)),
        x AS (SELECT doc_id, gram, p - 1 AS pos, array_to_string(w[p:p + gram - 1], ' ') AS h FROM q),
        hit AS (SELECT item_id, doc_id, pos, h, n_words - gram AS span, size FROM x JOIN m USING (gram, h)),
        best AS (
            SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.h) AS n, any_value(a.size) AS size
            FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + a.span GROUP BY ALL)
        SELECT doc_id, item_id, max(n) / max(size) AS containment, arg_min(pos, (-n, pos)) AS start_word
        FROM best GROUP BY ALL HAVING max(n) >= ceil(max(size) * 0.6 - 1e-9)""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT doc_id, w, least(5, len(w)) AS gram FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + gram - 1], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - gram + 2)) AS p FROM g)),
        z AS (SELECT doc_id, count(*) AS size, md5(string_agg(h, '|' ORDER BY h)) AS f FROM s GROUP BY doc_id),
        l AS (SELECT *, min(doc_id) OVER (PARTITION BY f, size) AS least FROM z),
        r AS (SELECT s.doc_id, h, size FROM s JOIN l USING (doc_id) WHERE least = doc_id),
        c AS (SELECT a.doc_id, b.doc_id AS other_id, count(*) AS k, any_value(a.size) + any_value(b.size) AS total FROM r a JOIN r b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT doc_id, other_id FROM c WHERE k / (total - k) >= 0.45 - 1e-12),
        n AS (SELECT least, count(*) AS members FROM l GROUP BY least),
        k AS (SELECT e.doc_id AS least, sum(members) AS links FROM e JOIN n ON n.least = e.other_id GROUP BY 1),
        reach AS (SELECT least AS doc_id, least AS other_id FROM n UNION SELECT reach.doc_id, e.other_id FROM reach JOIN e ON e.doc_id = reach.other_id),
        t AS (SELECT doc_id AS least, min(other_id) AS class_id FROM reach GROUP BY 1)
        SELECT doc_id, class_id, (members - 1 + coalesce(links, 0))::BIGINT AS n_links
        FROM l JOIN n USING (least) JOIN t USING (least) LEFT JOIN k USING (least) WHERE members - 1 + coalesce(links, 0) > 0""",
    "op8_exact_dedup": """
        SELECT doc_id, kept_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
        WHERE nth > 1""",
}
