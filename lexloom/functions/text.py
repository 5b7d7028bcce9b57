"""Texts as Column expressions in the JVM: trimming, residual markup and URLs. A null text counts as an empty one. What needs words, sentences or classes of characters is in metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 25 code points of Unicode white space.
WS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TAG, URL = "</?[a-zA-Z][^>]*>", f"https?://[^{WS}]+"
LANGUAGES = ("ja", "en")
CHAR_CLASSES = {"hiragana": "぀-ゟ", "katakana": "゠-ヿ", "kanji": "一-鿿", "alnum": "0-9A-Za-z"}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, by Unicode."""
    return F.btrim(_text(text), F.lit(WS))


def has_residual_html(text: Column) -> Column:
    return _text(text).rlike(TAG)


def has_residual_url(text: Column) -> Column:
    return _text(text).rlike(URL)


def residual_samples(text: Column, pattern: str, most: int = 5) -> Column:
    """The first matches of TAG or URL, in order."""
    return F.slice(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0)), 1, most)
