"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import raw, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a run of letters, of numbers or of other characters ends: a pre-token of the byte-level and of the word vocabularies ends there,
#: whatever comes before and after. Not before a mark, with which a normalisation may join, nor after an apostrophe, which may begin a pre-token with letters.
_SAFE = re.compile(r"(?<=[\p{L}--[Σς]])(?=[^\p{L}\p{M}])|(?<=\p{N})(?=[^\p{N}\p{M}])|(?<=[^\s\p{L}\p{N}\p{M}'])(?=[\p{L}\p{N}\s])", re.V1)
#: For sentencepiece, which has no pre-tokens: one space between two word characters, without the space.
_SPACE = re.compile(r"(?<=\w) (?=\w)")
_SAME = re.compile(r"\p{L}\p{L}|\p{N}\p{N}|[^\s\p{L}\p{N}'][^\s\p{L}\p{N}']")


@lru_cache(4)
def encoder(path: str, kind: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens. kind: tiktoken, tokenizers or sentencepiece."""
    if kind == "tiktoken":
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        e = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
    if kind == "tokenizers":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]
    if kind == "sentencepiece":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary: {kind}")


@lru_cache(4)
def seams(path: str) -> np.ndarray:
    """[a, b]: whether some token of a rank file has byte b after byte a. Where none has, no merge joins the two."""
    import base64

    out = np.zeros((256, 256), bool)
    with open(path, "rb") as f:
        for line in f:
            token = np.frombuffer(base64.b64decode(line.split()[0]), np.uint8)
            out[token[:-1], token[1:]] = True
    return out


def _unjoined(text: str, low: int, high: int, joined: np.ndarray) -> int | None:
    """The first place in text[low:high] between two characters of one kind that no token joins."""
    data = np.frombuffer(text[low:high].encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    free = np.flatnonzero(~joined[data[lead[1:] - 1], data[lead[1:]]]) + 1
    return next((low + int(i) for i in free if _SAME.fullmatch(text, low + int(i) - 1, low + int(i) + 1)), None)


def pieces(text: str, limit: int, spaces: bool = False, joined: np.ndarray | None = None) -> list[str]:
    """Cut a text at the first safe boundary after every limit characters; the pieces' counts add up to the text's.

    spaces: for an encoder that puts a space before a text itself; cuts are at spaces, which the pieces go without.
    joined, from seams: where no boundary comes for another limit characters, a cut between characters that no token joins.
    Where there is none either, the piece is longer.
    """
    out, i = [], 0
    while len(text) - i > limit:
        if spaces:
            m = _SPACE.search(text, i + limit)
            cut, after = (m.start(), m.end()) if m else (None, None)
        else:
            m = _SAFE.search(text, i + limit, min(len(text), i + 2 * limit))
            cut = m.start() if m else None
            if cut is None and joined is not None:
                cut = _unjoined(text, i + limit - 1, min(len(text), i + 2 * limit), joined)
            if cut is None and (m := _SAFE.search(text, i + 2 * limit)):
                cut = m.start()
            after = cut
        if cut is None or cut >= len(text):
            break
        out.append(text[i:cut])
        i = after
    return [*out, text[i:]]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, kind: str = "tiktoken", batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """(doc_id long, n_tokens long) of every row of docs, repeated rows and null ids too.

    An empty or null text has 0 tokens.  Texts go to the encoder in batches of
    about batch_bytes; a text of more than piece_chars is encoded in pieces, cut
    only where no token can span the cut: at the end of a run of letters, of numbers or of other characters, or, with a rank file,
    between characters that no token joins; for sentencepiece at spaces.  A run without such a place is encoded whole.  Needs no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, kind)
        joined = seams(vocabulary) if kind == "tiktoken" else None
        for whole in batches:
            for batch in slices(whole, 1, batch_bytes):
                total = np.zeros(batch.num_rows, np.int64)
                texts: list[str] = []
                owner: list[int] = []
                held = 0

                def flush() -> None:
                    if texts:
                        np.add.at(total, owner, encode(texts))
                        texts.clear()
                        owner.clear()

                offsets, _ = raw(batch.column(1))
                for k, size in enumerate(np.diff(offsets)):
                    text = batch.column(1)[k].as_py()
                    for piece in pieces(text, piece_chars, kind == "sentencepiece", joined) if size > piece_chars else (text,) if size else ():
                        texts.append(piece)
                        owner.append(k)
                        held += len(piece)
                        if held >= batch_bytes:
                            flush()
                            held = 0
                flush()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")
