"""Pluggable models: embedders and rerankers as batch functions behind mapInPandas or Columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """dim numbers for each text; made once in each Python worker (EM1)."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashed character trigrams, L2-normalised: deterministic and without files, for tests and defaults."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[k : k + 3].lower().encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed_rows(rows: DataFrame, make: Callable[[], Embedder], dim: int) -> DataFrame:
    """key, text, vector of rows (key, text); the model is made once per worker and its width checked (EM1, EM3)."""
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        if model.dim != dim:
            raise ValueError(f"the model gives {model.dim} numbers, {dim} are expected")
        for pdf in batches:
            pdf["vector"] = list(model(pdf["text"].fillna("").tolist())) if len(pdf) else []
            yield pdf[["key", "text", "vector"]]

    return rows.select("key", "text").mapInPandas(run, f"key {kind}, text string, vector array<double>")
