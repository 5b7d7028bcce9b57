"""All quality metrics of a batch of texts in one pass: character classes by table look-up over the whole batch, words and sentences by Unicode's segmentation rules (UAX 29)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lexloom.functions.text import CHAR_CLASSES, LANGUAGES, WS

_HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
_LATIN = r"\p{IsLatin}"
_SYMBOL = r"!-/0-9:-@\[-`{-~"
#: Bits of the table by code point.
_BITS = {**{k: 1 << i for i, k in enumerate(CHAR_CLASSES)}, "space": 16, "symbol": 32, "ja": 64, "en": 128, "other_words": 256}
NUMBERS = ("language_mixed_ratio", *(f"char_{c}" for c in (*CHAR_CLASSES, "other")), "duplicate_line_ratio", "symbol_digit_ratio", "avg_sentence_length", "sentence_length_variance", "ad_keyword_ratio", "seo_spam_score", "naturalness_score")
SCHEMA = ", ".join([f"{x} double" for x in NUMBERS] + ["has_residual_html boolean", "has_residual_url boolean", "detected_language string"])

_EXTEND = r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*+"
_LETTER, _DIGIT = rf"(?:[\p{{WB=ALetter}}\p{{WB=Hebrew_Letter}}]{_EXTEND})", rf"(?:\p{{WB=Numeric}}{_EXTEND})"
_KANA, _JOINER = rf"(?:\p{{WB=Katakana}}{_EXTEND})", rf"(?:\p{{WB=ExtendNumLet}}{_EXTEND})"
_MIDDLE = r"\p{WB=MidNumLet}\p{WB=Single_Quote}"
#: Letters go on over ' . and : if a letter follows, digits over ' . and , if a digit follows; both and _ go on with each other. Katakana by run, other letters one by one.
_WORD = regex.compile(
    rf"(?:{_LETTER}++(?:[\p{{WB=MidLetter}}{_MIDDLE}]{_EXTEND}{_LETTER}++)*+(?:['\p{{WB=Single_Quote}}](?<=\p{{WB=Hebrew_Letter}}'))?|{_DIGIT}++(?:[\p{{WB=MidNum}}{_MIDDLE}]{_EXTEND}{_DIGIT}++)*+|{_JOINER}++|(?<=\p{{WB=ExtendNumLet}}){_KANA}++|{_KANA}++(?=\p{{WB=ExtendNumLet}}))++|{_KANA}++|[\p{{L}}\p{{N}}]{_EXTEND}"
)
#: Latin letters, digits and what may join them: where a text has nothing else that words are made of, a simpler pattern finds its words,
#: and only those with something between letters or digits are cut again.
_JOINS = ".,:;'’‘·"
_PLAIN = rf"0-9_[\p{{IsLatin}}&&\p{{WB=ALetter}}]{_JOINS}"
_MADE_OF = r"\w\p{M}\p{WB=ALetter}\p{WB=Hebrew_Letter}\p{WB=Numeric}\p{WB=Katakana}\p{WB=ExtendNumLet}\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}\p{WB=MidLetter}\p{WB=MidNum}\p{WB=MidNumLet}\p{WB=Single_Quote}"
_SIMPLE = re.compile(rf"\w+(?:[{_JOINS}]\w+)*")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_CLOSE, _SPACES, _END = r"(?:\p{SB=Close}[\p{SB=Extend}\p{SB=Format}]*+)*+", r"(?:\p{SB=Sp}[\p{SB=Extend}\p{SB=Format}]*+)*+", r"(?:\r\n|[\r\n\p{SB=Sep}])"
_SKIP = r"[\p{SB=Extend}\p{SB=Format}]*+"
#: Where a sentence ends: after the match. An end mark that a number, a lower-case letter further on, a comma or another end mark follows doesn't end it.
_SENTENCE_END = regex.compile(
    rf"{_END}|\p{{SB=STerm}}{_SKIP}{_CLOSE}{_SPACES}(?:{_END}|(?![\p{{SB=SContinue}}\p{{SB=STerm}}\p{{SB=ATerm}}]))"
    rf"|\p{{SB=ATerm}}{_SKIP}(?!\p{{SB=Numeric}})(?!(?<=[\p{{SB=Upper}}\p{{SB=Lower}}]{_SKIP[:-1]}\p{{SB=ATerm}}{_SKIP[:-1]})\p{{SB=Upper}}){_CLOSE}{_SPACES}"
    rf"(?:{_END}|(?![\p{{SB=SContinue}}\p{{SB=STerm}}\p{{SB=ATerm}}])(?![^\p{{SB=OLetter}}\p{{SB=Upper}}\p{{SB=Lower}}\r\n\p{{SB=Sep}}\p{{SB=STerm}}\p{{SB=ATerm}}]*+\p{{SB=Lower}}))"
)
_TAG_START, _URL = regex.compile("</?[a-zA-Z]"), regex.compile(f"https?://[^{WS}]")


@lru_cache(1)
def _table() -> np.ndarray:
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint16)
    for name, chars in (*CHAR_CLASSES.items(), ("space", WS), ("symbol", _SYMBOL), ("ja", _HAN), ("en", _LATIN)):
        for m in regex.finditer(f"[{chars}]+", every):
            out[points[m.start() : m.end()]] |= _BITS[name]
    for m in regex.finditer(f"[[{_MADE_OF}]--[{_PLAIN}]]+", every, regex.V1):
        out[points[m.start() : m.end()]] |= _BITS["other_words"]
    return out


def words(text: str, plain: bool = False) -> list[str]:
    """Lower-case words that hold a letter or digit. plain: the text has no character of the bit other_words."""
    if not plain or "İ" in text:  # whose lower case has a mark
        text = text.lower()
        return [w for w in _WORD.findall(text) if _ALNUM.search(w)]
    found = []
    for w in _SIMPLE.findall(text.lower()):
        if w.isalnum():
            found.append(w)
        else:
            found += [x for x in _WORD.findall(w) if _ALNUM.search(x)]
    return found


def sentence_lengths(text: str) -> list[int]:
    """Characters of the sentences that hold a letter or digit, without white space at their ends."""
    out, i = [], 0
    for end in (*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)):
        part = text[i:end]
        if _ALNUM.search(part):
            out.append(len(part.strip(WS)))
        i = end
    return out


def compile_patterns(keywords: Iterable[str] = (), patterns: Iterable[str] = ()) -> list[regex.Pattern]:
    """Case-insensitive patterns; ValueError for one that is none."""
    out = [regex.compile(regex.escape(k), regex.I) for k in keywords]
    for p in patterns:
        try:
            out.append(regex.compile(p, regex.I))
        except regex.error as e:
            raise ValueError(f"bad ad pattern {p!r}: {e}") from e
    return out


def _by_word(text: str, plain: bool, patterns: Sequence[regex.Pattern]) -> tuple[float, float, float]:
    """ad_keyword_ratio, seo_spam_score and naturalness_score."""
    found = words(text, plain)
    n = len(found)
    if not n:
        return 0.0, 0.0, 0.0
    counts = Counter(found)
    ads = min(1.0, sum(len(p.findall(text)) for p in patterns) / n) if patterns else 0.0
    seo = max(counts.values()) / n if n >= 4 else 0.0
    mean = sum(map(len, found)) / n
    same = sum(k for w, k in counts.items() if len(w) >= 3 and w == w[0] * len(w)) / n
    return ads, seo, max(0.0, min(1.0, 1 - (min(1.0, (mean - 12) / 12) if mean > 12 else 0.0) - same - 0.5 * seo))


#: Bytes of text that are measured at once; a longer text is measured alone.
CHUNK = 1 << 20


def scores(column: pa.Array, allow: Sequence[str] = (), patterns: Sequence[regex.Pattern] = ()) -> pa.Array:
    """measure over any number of texts, some of them at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, i = [], 0
    while i < len(column) or not out:
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, "right")) - 1)
        out.append(measure(column.slice(i, j - i), allow, patterns))
        i = j
    return pa.concat_arrays(out)


def measure(column: pa.Array, allow: Sequence[str] = (), patterns: Sequence[regex.Pattern] = ()) -> pa.StructArray:
    """A struct of SCHEMA for each text; a null counts as an empty text.

    allow: the languages to tell apart, of LANGUAGES; patterns: those of compile_patterns.
    The language is the one whose script most letters are of, the first of equals; language_mixed_ratio is the share of
    characters in runs of the other's script.
    """
    codes = [c.lower() for c in allow] or list(LANGUAGES)
    texts = [t or "" for t in column.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    size = np.maximum(np.diff(bounds), 1)
    flags = _table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def count(on: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(on)])
        return total[bounds[1:]] - total[bounds[:-1]]

    has = lambda name: (flags & _BITS[name]) != 0
    out: dict[str, np.ndarray] = {f"char_{c}": count(has(c)) / size for c in CHAR_CLASSES}
    out["char_other"] = count((flags & 15) == 0) / size
    out["symbol_digit_ratio"] = count(has("symbol")) / np.maximum(count(~has("space")), 1)
    ja, en = (count(has(c)) if c in codes else np.zeros(len(texts), np.int64) for c in ("ja", "en"))
    kind = np.where((ja == 0) & (en == 0), 0, np.where(ja >= en, 1, 2))
    scripts = np.flatnonzero(flags & (_BITS["ja"] | _BITS["en"]))
    runs = np.zeros(len(texts))
    if len(scripts):
        edges = np.concatenate([[-1], scripts])
        last = edges[np.searchsorted(scripts, np.arange(len(flags)), "right")] if (kind == 1).any() or (ja > 0).any() else None
        if last is not None:
            begun = last >= np.repeat(bounds[:-1], np.diff(bounds))
            other = np.where(np.repeat(kind, np.diff(bounds)) == 1, (flags[last] & _BITS["en"]) != 0, (flags[last] & _BITS["ja"]) != 0)
            runs = np.where(kind > 0, count(begun & other), 0)
    out["language_mixed_ratio"] = runs / size
    plain = count(has("other_words")) == 0
    rows = np.zeros((len(texts), 6))
    html, url = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if not t:
            continue
        lines = [x[:-1] if x.endswith("\r") else x for x in t.split("\n")]
        lines = [x for x in lines if x.strip(WS)] if len(lines) > 1 else lines
        repeated = (len(lines) - len(set(lines))) / len(lines) if lines else 0.0
        lengths = sentence_lengths(t)
        n, total = len(lengths), sum(lengths)
        rows[i, :3] = repeated, total / n if n else 0.0, (n * sum(x * x for x in lengths) - total * total) / (n * n) if n else 0.0
        rows[i, 3:] = _by_word(t, plain[i], patterns)
        m = _TAG_START.search(t)
        html[i] = m is not None and t.find(">", m.end()) >= 0
        url[i] = _URL.search(t) is not None
    out |= dict(zip(("duplicate_line_ratio", "avg_sentence_length", "sentence_length_variance", "ad_keyword_ratio", "seo_spam_score", "naturalness_score"), rows.T))
    names = np.array([None, "ja", "en"], object)[kind]
    arrays = [pa.array(np.ascontiguousarray(out[x], np.float64)) for x in NUMBERS] + [pa.array(html), pa.array(url), pa.array(names, pa.string())]
    return pa.StructArray.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])
