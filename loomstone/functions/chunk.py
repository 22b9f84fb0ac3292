"""Chunks of text: paragraphs as they are, long ones by sentences, long sentences by windows of characters."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import DEFAULT, Segmenter

MAX_TOKENS, OVERLAP = 256, 32
WORD, OTHER = re.compile(r"[A-Za-z0-9_]+"), re.compile(r"[^A-Za-z0-9_\s]")
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"(?<=[。！？!?.\n])")
_IN_WORD = re.compile(r"[A-Za-z0-9_]{2}")


class Piece(NamedTuple):
    """A text with its size. whole: a chunk by itself, never put together with others."""

    text: str
    size: int
    whole: bool = False


def size(text: str) -> int:
    """Words of ASCII, and other characters."""
    return len(WORD.findall(text)) + len(OTHER.findall(text))


def windows(text: str, width: int, overlap: int) -> list[str]:
    """Spans of at most width characters that overlap, each but the last cut at its last blank, if its second half has one."""
    blanks, spans, at = [m.start() for m in re.finditer(" ", text)], [], 0
    while at + width < len(text):
        k = bisect_left(blanks, at + width) - 1
        end = blanks[k] if k >= 0 and blanks[k] >= at + width // 2 else at + width
        spans.append(slice(at, end))
        at = max(end - overlap, at) if end - overlap > at else end
    return [text[s] for s in (*spans, slice(at, None)) if at < len(text) or s.stop is not None]


def measured(text: str, limit: int, overlap: int) -> Iterator[Piece]:
    """Paragraphs that fit, sentences of those that don't, windows of sentences that don't either; each measured once."""
    for paragraph in filter(None, map(str.strip, PARAGRAPH.split(text))):
        n = size(paragraph)
        if n <= limit:
            yield Piece(paragraph, n, True)
            continue
        for sentence in filter(None, map(str.strip, SENTENCE_END.split(paragraph))):
            n = size(sentence)
            yield from [Piece(sentence, n)] if n <= limit else [Piece(w, limit, True) for w in windows(sentence, limit, overlap)]
        # Sentences of two paragraphs are never put together.
        yield Piece("", 0, True)


def added(held: Piece, more: Piece) -> Piece:
    """Two texts with nothing between: a word at the seam counts once."""
    seam = bool(_IN_WORD.fullmatch(held.text[-1:] + more.text[:1]))
    return Piece(held.text + more.text, held.size + more.size - seam)


def put_together(pieces: Iterator[Piece], limit: int, overlap: int) -> list[Piece]:
    """As few runs of the pieces as fit, each after the first beginning with the end of the one before."""

    def step(done: list[Piece], more: Piece) -> list[Piece]:
        both = added(done[-1], more)
        if not done[-1].text or both.size <= limit:
            return [*done[:-1], both]
        tail = done[-1].text[-overlap:]
        return [*done, added(Piece(tail, size(tail)), more)]

    return reduce(step, pieces, [Piece("", 0)])


def chunks(text: str | None, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    out: list[Piece] = []
    for whole, run in groupby(measured((text or "").strip(), limit, overlap), key=lambda p: p.whole):
        out += run if whole else put_together(run, limit, overlap)
    return [c for c in (p.text.strip() for p in out) if c]


def chunk_udf(limit: int = MAX_TOKENS, overlap: int = OVERLAP):
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, limit, overlap))

    return cut


def chunk_table(files: DataFrame, text: str = "text", key: str = "file_id", source_type: str = "doc_chunk", limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, source_type, chunk_index, chunk_text, token_count)."""
    from .text import estimate_tokens

    rows = files.select(key, F.posexplode(chunk_udf(limit, overlap)(F.col(text))).alias("chunk_index", "chunk_text"))
    return rows.select(key, F.lit(source_type).alias("source_type"), "chunk_index", "chunk_text", estimate_tokens(F.col("chunk_text")).alias("token_count"))


def segmented(text: str | None, segmenter: Segmenter = DEFAULT) -> str:
    """Words of a text, joined by blanks."""
    return " ".join(w.strip() for w in segmenter.cut(text or "") if w.strip())


def segment(text: Column, segmenter: Segmenter = DEFAULT) -> Column:
    """`segmented`, of a column."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segmented(t, segmenter))

    return cut(text)
