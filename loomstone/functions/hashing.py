"""XXH3 content hashes and point ids, and vectors from text, as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(b))


def _signed(keys: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64).view(np.int64))


def content_hash(content: Column) -> Column:
    """Hexadecimal XXH3 of bytes; null for null."""
    return F.pandas_udf(_hex, "string")(content)


def point_id(file_id: Column, source_type: Column, index: Column) -> Column:
    """XXH3 of the logical key; its 64 bits as a signed number."""
    from .text import logical_key

    return F.pandas_udf(_signed, "bigint")(logical_key(file_id, source_type, index))


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words, of unit length: for tests, and where no model is installed."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                row[h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed(text: Column, provider: EmbeddingProvider | None = None) -> Column:
    """A vector of each text; the provider is set up once in a worker."""
    own = provider or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(own.embed(texts.tolist())))

    return run(text)
