"""Configuration from TOML with defaults and checks."""

from __future__ import annotations

import copy
import hashlib
import json
import tomllib
from typing import Any

from lexloom.functions import metrics
from lexloom.functions.text import LANGUAGES
from lexloom.operators import dedup, plugins, scoring

DEFAULTS: dict[str, Any] = {
    "input": {"text_mode": "newline_delimited", "text_field": "text", "meta_fields": []},
    "output": {"write_rejected": False, "rejected_path": None, "shard_max_rows": None},
    "extract": {"validate_residual": True, "strip_boilerplate": True, "markdown": False, "markdown_keep_headings": True, "markdown_keep_lists": True, "markdown_keep_links": False},
    "scoring": {"language": {"allow": [], "max_mixed_ratio": None}, "text_quality": {"max_duplicate_line_ratio": None, "max_symbol_ratio": None, "kenlm_model_path": None, "perplexity_enabled": False}, "content_quality": {"ad_keywords": [], "ad_patterns": [], "max_ad_keyword_ratio": None, "max_seo_spam_score": None, "min_naturalness_score": None}},
    "filters": {"thresholds": {"reject_on_residual_html": False, "reject_on_residual_url": False}, "rules": []},
    "dedup": {"exact": False, "minhash_lsh": False, "similarity_threshold": 0.85, "num_hashes": 128, "num_bands": 16, "shingle_size": 25},
    "runtime": {"threads": 0, "batch_size": 1000, "log_level": "info", "checkpoint_dir": None},
    "stats": {"output_path": None, "format": "json"},
    "plugins": [],
}
_CHOICES = {("input", "format"): ("text", "jsonl", "warc", "html"), ("input", "text_mode"): ("newline_delimited", "one_file_per_document"), ("output", "format"): ("jsonl", "parquet"), ("stats", "format"): ("json", "text"), ("runtime", "log_level"): ("trace", "debug", "info", "warn", "error")}


def _merge(base: dict, given: dict) -> dict:
    for k, v in given.items():
        base[k] = _merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base


def validate(config: dict) -> dict:
    for table, key in (("input", "format"), ("input", "paths"), ("output", "format"), ("output", "path")):
        if not config.get(table, {}).get(key):
            raise ValueError(f"{table}.{key} is missing")
    for (table, key), allowed in _CHOICES.items():
        if config[table][key] not in allowed:
            raise ValueError(f"{table}.{key} must be one of {', '.join(allowed)}")
    if bad := [c for c in config["scoring"]["language"]["allow"] if c.lower() not in LANGUAGES]:
        raise ValueError(f"unsupported language: {', '.join(bad)}")
    if config["scoring"]["text_quality"]["perplexity_enabled"]:
        raise ValueError("perplexity is unsupported: there is no language model")
    metrics.compile_patterns((), config["scoring"]["content_quality"]["ad_patterns"])
    for r in config["filters"]["rules"]:
        scoring.validate_rule(r["name"], r["when"])
    d = config["dedup"]
    if d["minhash_lsh"]:
        dedup.validate(d["num_hashes"], d["num_bands"], d["similarity_threshold"])
    if config["runtime"]["batch_size"] < 1:
        raise ValueError("runtime.batch_size must be at least 1")
    plugins.validate(config["plugins"])
    return config


def load(text: str, overrides: dict | None = None) -> dict:
    """A checked configuration from TOML text; overrides is a tree of the same shape."""
    return validate(_merge(_merge(copy.deepcopy(DEFAULTS), tomllib.loads(text)), overrides or {}))


def fingerprint(config: dict) -> str:
    """Of all that decides on a row, so not of paths or outputs."""
    part = {k: config[k] for k in ("extract", "scoring", "filters", "dedup", "plugins")} | {"input": {k: v for k, v in config["input"].items() if k != "paths"}}
    return hashlib.sha256(json.dumps(part, sort_keys=True, default=str).encode()).hexdigest()
