"""All metrics of a table of texts, and the filters and rules that decide on them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import metrics
from lexloom.functions import text as fn

NUMERIC = metrics.NUMBERS
FLAGS = ("has_residual_html", "has_residual_url")
FIELDS = (*NUMERIC, *FLAGS, "detected_language")


def score(df: DataFrame, text_col: str = "text", allow: Iterable[str] = (), ad_keywords: Iterable[str] = (), ad_patterns: Iterable[str] = ()) -> DataFrame:
    """df with a column for each of FIELDS, of the trimmed text; columns of these names are replaced. A null or empty text has 0 everywhere and no language. One Arrow function makes all of them in one pass over the text; it counts as not deterministic, as Spark would else copy it into a filter on them, for a second pass in workers of its own."""
    allow, ad_keywords, ad_patterns = tuple(allow), tuple(ad_keywords), tuple(ad_patterns)
    if bad := [c for c in allow if c.lower() not in fn.LANGUAGES]:
        raise ValueError(f"unsupported language: {', '.join(bad)}")
    metrics.compile_patterns(ad_keywords, ad_patterns)

    @F.arrow_udf(metrics.SCHEMA)
    def run(text: pa.Array) -> pa.Array:
        return metrics.scores(text, allow, metrics.compile_patterns(ad_keywords, ad_patterns))

    run = run.asNondeterministic()
    free = "__scores" + "_" * max(map(len, df.columns))  # longer than any name there is
    found = df.withColumn(free, run(fn.trimmed(F.col(f"`{text_col}`"))))
    return found.withColumns({x: F.col(f"{free}.{x}") for x in FIELDS}).drop(free)


_COMPARE = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def validate_rule(name: str, node: Mapping[str, Any]) -> None:
    """Raise ValueError for an unknown field or operator."""
    for key in ("all", "any"):
        if key in node:
            for x in node[key]:
                validate_rule(name, x)
            return
    if "not" in node:
        return validate_rule(name, node["not"])
    field, op = node.get("field"), node.get("op")
    if field not in FIELDS and not (isinstance(field, str) and field.startswith("plugin:") and len(field) > 7):
        raise ValueError(f"rule {name!r}: unknown field {field!r}")
    if op not in (*_COMPARE, "in", "not_in"):
        raise ValueError(f"rule {name!r}: unknown operator {op!r}")
    if "value" not in node:
        raise ValueError(f"rule {name!r}: a comparison needs a value")


def rule(node: Mapping[str, Any], plugin_scores: str | None = None) -> Column:
    """A rule tree as a condition that is never null: every comparison that can't be made is false before it is negated."""
    if "all" in node:
        return reduce(lambda a, b: a & b, (rule(x, plugin_scores) for x in node["all"]), F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, (rule(x, plugin_scores) for x in node["any"]), F.lit(False))
    if "not" in node:
        return ~rule(node["not"], plugin_scores)
    field, op, value = node["field"], node["op"], node["value"]
    false = F.lit(False)
    if field == "detected_language":
        found = F.lower(F.col(field))
        if isinstance(value, (list, tuple)) and op in ("in", "not_in"):
            inside = F.coalesce(found.isin([str(v).lower() for v in value]), false) if value else false
            return inside if op == "in" else ~inside
        if isinstance(value, str) and op in ("eq", "ne"):
            same = F.coalesce(found == value.lower(), false)
            return same if op == "eq" else ~same
        return false
    if field in FLAGS:
        return _COMPARE[op](F.col(field), F.lit(value)) if isinstance(value, bool) and op in ("eq", "ne") else false
    if isinstance(value, bool) or not isinstance(value, (int, float)) or op not in _COMPARE:
        return false
    if field.startswith("plugin:"):
        if plugin_scores is None:
            return false
        return F.coalesce(_COMPARE[op](F.element_at(F.col(plugin_scores), field[7:]), F.lit(float(value))), false)
    return F.coalesce(_COMPARE[op](F.col(field), F.lit(float(value))), false)


def reason(thresholds: Mapping[str, Any] | None = None, allow: Iterable[str] = (), rules: Iterable[Mapping[str, Any]] = (), plugin_scores: str | None = None) -> Column:
    """The first check that a scored row fails, null if none.

    thresholds: max_mixed_ratio, max_duplicate_line_ratio, max_symbol_ratio,
    max_ad_keyword_ratio, max_seo_spam_score, min_naturalness_score,
    reject_on_residual_html, reject_on_residual_url; those left out aren't checked.
    """
    t = {k: v for k, v in (thresholds or {}).items() if v is not None}
    codes = [c.lower() for c in allow]
    checks: list[tuple[Column, str]] = []
    if codes:
        checks.append((~F.coalesce(F.lower("detected_language").isin(codes), F.lit(False)), "language_not_allowed"))
    for key, column, name in (
        ("max_mixed_ratio", "language_mixed_ratio", "mixed_language_ratio_exceeded"), ("max_duplicate_line_ratio", "duplicate_line_ratio", "duplicate_line_ratio_exceeded"), ("max_symbol_ratio", "symbol_digit_ratio", "symbol_ratio_exceeded"),
        ("max_ad_keyword_ratio", "ad_keyword_ratio", "ad_keyword_ratio_exceeded"), ("max_seo_spam_score", "seo_spam_score", "seo_spam_score_exceeded"),
    ):
        if key in t:
            checks.append((F.col(column) > F.lit(float(t[key])), name))
    if "min_naturalness_score" in t:
        checks.append((F.col("naturalness_score") < F.lit(float(t["min_naturalness_score"])), "naturalness_score_too_low"))
    if t.get("reject_on_residual_html"):
        checks.append((F.col("has_residual_html"), "residual_html_detected"))
    if t.get("reject_on_residual_url"):
        checks.append((F.col("has_residual_url"), "residual_url_detected"))
    for r in rules:
        validate_rule(r["name"], r["when"])
        checks.append((rule(r["when"], plugin_scores), f"custom_rule:{r['name']}"))
    out = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def statistics(df: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """(metric, mean, variance, minimum, maximum) of NUMERIC over rows that aren't errors; zeros without rows. One pass."""
    zero = F.lit(0.0)
    rows = df.where(F.col(outcome_col) != "error") if outcome_col in df.columns else df
    one = rows.agg(*(f(m).alias(f"{k}_{m}") for m in NUMERIC for k, f in (("mean", F.avg), ("variance", F.var_pop), ("minimum", F.min), ("maximum", F.max))))
    each = [F.struct(F.lit(m).alias("metric"), *(F.coalesce(F.col(f"{k}_{m}"), zero).alias(k) for k in ("mean", "variance", "minimum", "maximum"))) for m in NUMERIC]
    return one.select(F.inline(F.array(*each)))
