"""One query for each of the library's operators, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.operators import dedup, html, plugins, scoring
from lexloom.plans import cleaning
from lexloom.plans.config import load
from lexloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYWORDS, PATTERNS = ["license", "stupid"], [r"\bth\w*e\b"]
THRESHOLDS = {"max_mixed_ratio": 0.5, "max_duplicate_line_ratio": 0.2, "max_symbol_ratio": 0.1, "max_ad_keyword_ratio": 0.05, "max_seo_spam_score": 0.2, "min_naturalness_score": 0.7, "reject_on_residual_html": True, "reject_on_residual_url": True}
RULES = [{"name": "long_or_dense", "when": {"any": [{"field": "avg_sentence_length", "op": "gt", "value": 90}, {"all": [{"field": "symbol_digit_ratio", "op": "gte", "value": 0.05}, {"not": {"field": "detected_language", "op": "in", "value": ["ja"]}}]}]}}]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, spread over the cores where it has fewer parts than there are cores."""
    df = _table(spark, sf_dir, name).select(*columns)
    return files.spread(df)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_WS = "".join(rf"\x{{{ord(c):X}}}" for c in fn.WS)
_TRIM = f"regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_L, _D = r"(?:\p{L}\p{M}*)+", r"(?:\p{N}\p{M}*)+"
_W = rf"list_filter(list_transform(regexp_extract_all(t, '(?:{_L}(?:[''’.:·]{_L})*|{_D}(?:[''’.,;]{_D})*|_+)+'), lambda x: lower(x)), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"
_RATIO = "CASE WHEN {n} > 0 THEN ({a})::DOUBLE / {n} ELSE 0.0 END"
_HAN, _LATIN = r"\p{Han}\p{Hiragana}\p{Katakana}ー", r"\p{Latin}"


def _kept(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


_CHARS = ", ".join(_RATIO.format(a=_kept(c), n="length(t)") + f" AS char_{k}" for k, c in fn.CHAR_CLASSES.items()) + ", " + _RATIO.format(a=f"length(regexp_replace(t, '[{''.join(fn.CHAR_CLASSES.values())}]', '', 'g'))", n="length(t)") + " AS char_other"
_LINES = f"list_filter(regexp_split_to_array(t, '\\r?\\n'), lambda x: regexp_matches(x, '[^{_WS}]'))"
_DUP = _RATIO.format(a=f"len({_LINES}) - len(list_distinct({_LINES}))", n=f"len({_LINES})")
_SYMBOL = _RATIO.format(a=r"length(regexp_replace(t, '[^!-/0-9:-@\[-`{-~]', '', 'g'))", n=f"length(regexp_replace(t, '[{_WS}]', '', 'g'))")
_CLOSE, _BLANK, _GOES_ON = "\"'()\\[\\]{}«»‘’‚‛“”„‟‹›", " \\t\\v\\f\\x{A0}", ",\\-:;–—、"


def _sentences() -> str:
    """Sentence ends by the rules of UAX 29: full stops that end none become chr(2), then chr(1) goes after the others and after line ends."""
    then = f"[{_CLOSE}]*[{_BLANK}]*"
    x = "t"
    for pattern, to in (
        (r"\.(\p{Nd})", r"\2"), (r"([\p{Lu}\p{Ll}])\.(\p{Lu})", None), (r"([\p{Lu}\p{Ll}])\.(\p{Lu})", None),
        (rf"\.({then}[{_GOES_ON}.?!\x02])", r"\2"), (rf"\.({then}[{_GOES_ON}.?!\x02])", r"\2"), (rf"\.({then}[^\p{{L}}.?!。！？\r\n\x02]*\p{{Ll}})", r"\2"),
    ):
        pattern = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', {'chr(2) || ' + chr(39) + chr(92) + '1' + chr(39) if to else chr(39) + chr(92) + '1' + chr(39) + ' || chr(2) || ' + chr(39) + chr(92) + '2' + chr(39)}, 'g')"
    ends = rf"((?:[.?!。！？]{then})+)([^{_CLOSE}{_BLANK}{_GOES_ON}.?!。！？\r\n\x02])".replace("'", "''")
    x = rf"regexp_replace({x}, '{ends}', '\1' || chr(1) || '\2', 'g')"
    x = rf"regexp_replace({x}, '(\r\n|[\r\n\x{{85}}\x{{2028}}\x{{2029}}])', '\1' || chr(1), 'g')"
    return rf"list_transform(list_filter(string_split({x}, chr(1)), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: length(regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')))"


_SENTENCES = _sentences()
_LANG = f"CASE WHEN {_kept(_HAN)} = 0 AND {_kept(_LATIN)} = 0 THEN NULL WHEN {_kept(_HAN)} >= {_kept(_LATIN)} THEN 'ja' ELSE 'en' END"
_OTHER = "coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x))), 0)"
_MIXED = _RATIO.format(a=f"CASE {_LANG} WHEN 'ja' THEN {_OTHER.format(p=f'[{_LATIN}][^{_HAN}]*')} WHEN 'en' THEN {_OTHER.format(p=f'[{_HAN}][^{_LATIN}]*')} ELSE 0 END", n="length(t)")
_HITS = r"len(regexp_extract_all(t, '(?i)license')) + len(regexp_extract_all(t, '(?i)stupid')) + len(regexp_extract_all(t, '(?i)\bth\w*e\b'))"


def _scored(table: str = "documents", key: str = "doc_id") -> str:
    """All metrics in SQL."""
    return f"""
        a AS (SELECT {key}, coalesce({_TRIM}, '') AS t FROM {table}),
        b AS (SELECT *, {_W} AS w, {_SENTENCES} AS s FROM a),
        f AS (SELECT {key}, max(n) AS most FROM (SELECT {key}, x, count(*) AS n FROM (SELECT {key}, unnest(w) AS x FROM b) GROUP BY ALL) GROUP BY {key}),
        c AS (
            SELECT b.{key}, {_LANG} AS detected_language, {_MIXED} AS language_mixed_ratio, {_CHARS}, {_DUP} AS duplicate_line_ratio, {_SYMBOL} AS symbol_digit_ratio,
                CASE WHEN len(s) > 0 THEN list_sum(s)::DOUBLE / len(s) ELSE 0.0 END AS avg_sentence_length, CASE WHEN len(s) > 0 THEN list_var_pop(s) ELSE 0.0 END AS sentence_length_variance,
                regexp_matches(t, '{fn.TAG}') AS has_residual_html, regexp_matches(t, 'https?://[^{_WS}]+') AS has_residual_url,
                least(1.0, {_RATIO.format(a=_HITS, n='len(w)')}) AS ad_keyword_ratio, CASE WHEN len(w) < 4 THEN 0.0 ELSE most::DOUBLE / len(w) END AS seo_spam_score, w
            FROM b LEFT JOIN f USING ({key})),
        d AS (
            SELECT * EXCLUDE (w), CASE WHEN len(w) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
                1 - CASE WHEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) > 12 THEN least(1.0, (list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) - 12) / 12) ELSE 0.0 END
                - len(list_filter(w, lambda x: length(x) >= 3 AND replace(x, x[1], '') = ''))::DOUBLE / len(w) - 0.5 * seo_spam_score)) END AS naturalness_score
            FROM c)"""


def _scores(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return scoring.score(_spread(spark, sf_dir, table, "doc_id", "text"), ad_keywords=KEYWORDS, ad_patterns=PATTERNS)


def _one(name: str, *columns: str) -> None:
    """A query of some metrics for every document; doubles have 9 decimals, and ties go up on both sides."""
    rounded = lambda c: c in scoring.NUMERIC

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scores(spark, sf_dir).select("doc_id", *(F.round(F.col(c) + 1e-12, 9).alias(c) if rounded(c) else F.col(c) for c in columns))

    run.__name__ = name
    query(f"WITH {_scored()} SELECT doc_id, {', '.join(f'round({c} + 1e-12, 9) AS {c}' if rounded(c) else c for c in columns)} FROM d")(run)


_one("char_ratios", *(f"char_{c}" for c in (*fn.CHAR_CLASSES, "other")))
_one("duplicate_line_ratio", "duplicate_line_ratio")
_one("symbol_digit_ratio", "symbol_digit_ratio")
_one("sentence_stats", "avg_sentence_length", "sentence_length_variance")
_one("residual_flags", "has_residual_html", "has_residual_url")
_one("language", "detected_language", "language_mixed_ratio")
_one("ad_keyword_ratio", "ad_keyword_ratio")
_one("seo_spam_score", "seo_spam_score")
_one("naturalness_score", "naturalness_score")


@query(f"SELECT conv_id, turn, {_TRIM} AS text FROM conversations")
def passthrough_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.trimmed(F.col("text")).alias("text"))


@query(f"SELECT page_id, regexp_matches(html, '{fn.TAG}') AS has_html, array_to_string(regexp_extract_all(html, '{fn.TAG}')[1:5], '|') AS html_samples, regexp_matches(url, 'https?://[^{_WS}]+') AS has_urls, array_to_string(regexp_extract_all(url, 'https?://[^{_WS}]+')[1:5], '|') AS url_samples FROM pages")
def residual_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, u = F.col("html"), F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", fn.has_residual_html(h).alias("has_html"), F.array_join(fn.residual_samples(h, fn.TAG), "|").alias("html_samples"), fn.has_residual_url(u).alias("has_urls"), F.array_join(fn.residual_samples(u, fn.URL), "|").alias("url_samples"))


_LADDER = """CASE WHEN lower(detected_language) NOT IN ('en') OR detected_language IS NULL THEN 'language_not_allowed' WHEN language_mixed_ratio > 0.5 THEN 'mixed_language_ratio_exceeded'
    WHEN duplicate_line_ratio > 0.2 THEN 'duplicate_line_ratio_exceeded' WHEN symbol_digit_ratio > 0.1 THEN 'symbol_ratio_exceeded' WHEN ad_keyword_ratio > 0.05 THEN 'ad_keyword_ratio_exceeded'
    WHEN seo_spam_score > 0.2 THEN 'seo_spam_score_exceeded' WHEN naturalness_score < 0.7 THEN 'naturalness_score_too_low' WHEN has_residual_html THEN 'residual_html_detected' WHEN has_residual_url THEN 'residual_url_detected'
    WHEN avg_sentence_length > 90 OR (symbol_digit_ratio >= 0.05 AND NOT coalesce(lower(detected_language) IN ('ja'), false)) THEN 'custom_rule:long_or_dense' END"""


@query(f"WITH {_scored()} SELECT doc_id, {_LADDER} AS reason FROM d")
def filter_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", scoring.reason(THRESHOLDS, ["en"], RULES).alias("reason"))


@query(f"WITH {_scored()} SELECT reason, count(*) AS n FROM (SELECT {_LADDER} AS reason FROM d) WHERE reason IS NOT NULL GROUP BY reason")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_ladder(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_scored()} SELECT doc_id, (avg_sentence_length > 90 OR (symbol_digit_ratio >= 0.05 AND NOT coalesce(detected_language = 'ja', false))) AS matched FROM d")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", scoring.rule(RULES[0]["when"]).alias("matched"))


@query(f"WITH {_scored()} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(var_pop({m}), 4) AS variance, round(min({m}), 6) AS minimum, round(max({m}), 6) AS maximum FROM d" for m in scoring.NUMERIC))
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.statistics(_scores(spark, sf_dir)).select("metric", *(F.round(c, 4 if c == "variance" else 6).alias(c) for c in ("mean", "variance", "minimum", "maximum")))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate_exact FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "duplicate_exact")


@query()
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup.exact(_spread(spark, sf_dir, "documents", "doc_id", "text")).where("not duplicate_exact")
    return dedup.near(docs.select("doc_id", "text"), 0.6, 64, 16, 8)


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.extract(F.col("html")).alias("text"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.extract(F.col("html"), markdown=True, keep_links=True).alias("text"))


def shout(text: str, meta: dict, config: dict) -> dict:
    """A plugin: the share of upper-case ASCII letters, and a rejection above config["most"]."""
    share = sum("A" <= c <= "Z" for c in text) / len(text) if text else 0.0
    return {"score": share, "accept": share <= config["most"], "reason": "upper case"}


@query("""
    SELECT doc_id, round(s + 1e-12, 9) AS score, CASE WHEN s > 0.3 THEN 'plugin:shout:upper case' END AS reason
    FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END AS s FROM documents)""")
def plugin_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = plugins.chain(F.col("text"), F.lit("{}"), [{"name": "shout", "path": "lexloom.queries:shout", "config": {"most": 0.3}, "timeout_ms": 5000}])
    return _table(spark, sf_dir, "documents").select("doc_id", done.alias("p")).select("doc_id", F.round(F.col("p.scores")["shout"] + 1e-12, 9).alias("score"), F.col("p.reason").alias("reason"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON Lines, written and read again with two fields as metadata."""
    rows = _table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    lines = files.read(spark, "jsonl", files.discover(sorted(dedup.scratch(rows, "text").inputFiles()), spark), meta_fields=["conv_id", "turn"])
    return lines.select(*(F.get_json_object("meta", f"$.{x}").cast("long").alias(x) for x in ("conv_id", "turn")), "text")


_JOB = """
[input]
format = "text"
paths = ["documents"]
[output]
format = "parquet"
path = "cleaned"
[scoring.text_quality]
max_duplicate_line_ratio = 0.2
max_symbol_ratio = 0.1
[scoring.content_quality]
max_seo_spam_score = 0.2
[filters.thresholds]
reject_on_residual_html = true
[dedup]
exact = true
"""


@query(f"""WITH {_scored()},
    e AS (SELECT doc_id, t, CASE WHEN duplicate_line_ratio > 0.2 THEN 'duplicate_line_ratio_exceeded' WHEN symbol_digit_ratio > 0.1 THEN 'symbol_ratio_exceeded' WHEN seo_spam_score > 0.2 THEN 'seo_spam_score_exceeded' WHEN has_residual_html THEN 'residual_html_detected' END AS why FROM d JOIN a USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY t, why IS NULL ORDER BY doc_id) AS nth FROM e)
    SELECT doc_id, CASE WHEN why IS NOT NULL OR nth > 1 THEN 'rejected' ELSE 'accepted' END AS outcome, coalesce(why, CASE WHEN nth > 1 THEN 'duplicate_exact' END) AS reason FROM r""")
def cleaning_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.struct(F.lit(0).alias("file_rank"), F.col("doc_id").alias("rec_no")).alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("source_path"), "text", F.lit("{}").alias("meta"), F.lit(None).cast("string").alias("error"))
    return cleaning.decide(rows, load(_JOB)).select(F.col("ord.rec_no").alias("doc_id"), "outcome", "reason")
