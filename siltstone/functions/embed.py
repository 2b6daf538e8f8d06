"""Pluggable models. The defaults are deterministic stand-ins which need no download."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import query_tokens, short_summary, summary_input, without_thoughts

#: Takes texts, gives one vector each.
Embedder = Callable[[list[str]], np.ndarray]
#: Takes prompts, gives one answer each.
Summarizer = Callable[[list[str]], list[str]]
DIM = 64


def hashing_embedder(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed token counts in dim buckets, at unit length."""
    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts, strict=True):
        for token in query_tokens(t or ""):
            h = zlib.crc32(token.encode())
            row[h % dim] += 1 if h & 0x10000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedding(text: Column, embedder: Embedder = hashing_embedder) -> Column:
    """Vectors in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(embedder([t or "" for t in b]).astype(np.float32)))

    return run(text)


def summary(code: Column, summarizer: Summarizer | None = None) -> Column:
    """Short code is its own summary; longer code is a model's task, or has no summary without one."""
    if summarizer is None:
        return short_summary(code)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            asked = b.notna()
            out = pd.Series([None] * len(b), dtype=object)
            if asked.any():
                out[asked.values] = summarizer(list(b[asked]))
            yield out

    short = short_summary(code)
    return F.coalesce(short, without_thoughts(run(F.when(short.isNull(), summary_input(code)))))
