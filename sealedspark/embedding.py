"""Embeddings by a pluggable model, with the hashed bag of words where there is none or it fails.

An embedder is a callable from a list of texts to a list of vectors. Generation is a hook of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
CANARY = "the quick brown fox"


def hash_embedder(dim: int) -> Embedder:
    """Counts of a text's words by md5 modulo `dim`."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                v[int.from_bytes(hashlib.md5(w.encode()).digest(), "big") % dim] += 1.0
            out.append(v)
        return out

    return run


def fit(vec: list[float], dim: int, normalize: bool) -> list[float]:
    """`vec` padded or cut to `dim`, of length 1 unless it is all but zero."""
    v = [float(x) for x in vec[:dim]] + [0.0] * (dim - len(vec))
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if normalize and n > 1e-12 else v


def embed_texts(texts: list[str], dim: int, embedder: Embedder | None = None, normalize: bool = True) -> list[list[float]]:
    """One vector of `dim` a text; the hashed one where the embedder raises or returns nothing."""
    own: list = [None] * len(texts)
    if embedder:
        try:
            own = list(embedder(texts))
        except Exception:  # a model that is down is no reason to stop
            pass
    spare = hash_embedder(dim)
    return [fit(v if v is not None and len(v) else spare([t])[0], dim, normalize) for t, v in zip(texts, own, strict=True)]


def embed(docs: DataFrame, dim: int, embedder: Embedder | None = None, normalize: bool = True) -> DataFrame:
    """`docs` (text, ...) with a column vec; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embed_texts([t or "" for t in texts], dim, embedder, normalize))

    return docs.withColumn("vec", run("text"))


def available(embedder: Embedder | None) -> bool:
    """Whether an embedder answers."""
    try:
        return bool(embedder and len(embedder([CANARY])[0]))
    except Exception:
        return False


def mode(embedder: Embedder | None, dim: int = 64) -> str:
    """`live` if the embedder's vector of a canary text differs from the hashed one, else `hash`."""
    if not available(embedder):
        return "hash"
    live, spare = (embed_texts([CANARY], dim, e)[0] for e in (embedder, None))
    return "live" if max(abs(a - b) for a, b in zip(live, spare, strict=True)) > 1e-9 else "hash"


def complete(generator: Callable[[str], str], prompt: str) -> str:
    """A generated answer, stripped."""
    return generator(prompt).strip()
