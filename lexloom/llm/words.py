"""Vectorised words and shingles: numpy over the bytes of Arrow string arrays.

A word is a maximal run of ASCII letters and digits and of code points from
U+00C0 on, after lower-casing, without U+2000-206F (general punctuation) and
U+3000-303F (CJK punctuation).  ``WORD_RE`` is the same rule as an RE2 pattern
for SQL.  Words and shingles are represented by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[0-9a-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
#: The same for Python's re.
WORD_PY = "[0-9a-zÀ-῿⁰-⿿぀-\U0010ffff]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.zeros(256, bool)
_BYTE[ord("0") : ord("9") + 1] = _BYTE[ord("a") : ord("z") + 1] = True
_BYTE[0x80:] = True
_RAND = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text that are hashed at once; bounds the memory of a task.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        _POW[:] = [_powers(_BASE, size), _powers(_INV, size)]
    return _POW[0], _POW[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and bounds: text i has words bounds[i] to bounds[i + 1]."""
    offsets, data = raw(pc.utf8_lower(column))
    n = len(data)
    is_word = _BYTE[data]
    high = np.flatnonzero((data == 0xE2) | (data == 0xE3) | (data == 0xC2))
    high = high[high + 1 < n]
    if len(high):
        lead, second = data[high], data[high + 1]
        two = high[lead == 0xC2]
        is_word[two] = is_word[two + 1] = False
        three = high[((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((lead == 0xE3) & (second == 0x80))]
        three = three[three + 2 < n]
        is_word[three] = is_word[three + 1] = is_word[three + 2] = False
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    before[offsets] = False  # a text begins without a word before it
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:n] = is_word
    after[offsets] = False
    ends = np.flatnonzero(is_word & ~after[1:]) + 1
    bounds = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _tables(b - a + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_RAND[data[a:b]] * power[: b - a], out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words, and their bounds by text. A text of 1 to n - 1 words has one shingle, of all its words."""
    lengths = np.diff(bounds)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(out_bounds[-1]) - out_bounds[text] + bounds[text]
    left = bounds[text + 1] - at
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            w = padded[at + j]
            if j:
                w = np.where(left > j, w, _U(0))
            out = (out + w) * _U(0xD6E8FEB86659FD93)
            out ^= out >> _U(32)
    return mix(out), out_bounds


def ids_of(bounds: np.ndarray) -> np.ndarray:
    """The text's number for every element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def tidy() -> None:
    """Give freed memory back, as a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most limit bytes in the column, or one row."""
    if not batch.num_rows:
        return
    offsets, _ = raw(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    tidy()
