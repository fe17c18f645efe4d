"""Embeddings: a pluggable vectorised model; a hashing embedder without a model for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words: equal texts are equal, shared words bring texts near."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 16) -> DataFrame:
    """(id, embedding) of (id, text), in batches of the model's size."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        vs = [encode(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
        return pd.Series([v.tolist() for part in vs for v in part])

    return texts.select("id", run("text").alias("embedding"))


def embed_missing(texts: DataFrame, have: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Only ids without an embedding are computed."""
    return embed(texts.join(have.select("id").distinct(), "id", "left_anti"), encode)
