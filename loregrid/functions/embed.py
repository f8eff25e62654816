"""Embedders: text to vectors, in batches on executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship

DIMENSIONS = 64


def hashed(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """A unit vector of hashed words: the offline embedder, the same everywhere."""
    out = np.zeros(dimensions)
    for word in (text or "").lower().split():
        raw = hashlib.sha256(word.encode()).digest()
        out[int.from_bytes(raw[:4], "big") % dimensions] += 1 if raw[4] & 1 else -1
    length = np.sqrt(out @ out)
    return (out / length if length else out).tolist()


def embedded(rows: DataFrame, column: str = "content", embed: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16) -> DataFrame:
    """``rows`` with an embedding of a column; ``embed`` takes texts, ``batch`` at a time."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            if embed is None:
                yield pd.Series([hashed(t) for t in texts])
            else:
                yield pd.Series([v for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])])

    return rows.withColumn("embedding", run(F.col(column)))


#: The lengths of vectors of known models, and the prefixes that one family wants.
MODEL_DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
TASK_PREFIXES = {"nomic": ("search_query: ", "search_document: ")}


def dimensions(model: str, embed: Callable[[list[str]], list[list[float]]] | None = None) -> int:
    """The length of a model's vectors: known, or asked from the model, or the offline one."""
    return MODEL_DIMENSIONS.get(model) or (len(embed(["x"])[0]) if embed else DIMENSIONS)


def prefixed(model: str, embed: Callable[[list[str]], list[list[float]]], query: bool) -> Callable[[list[str]], list[list[float]]]:
    """``embed`` with the prefix that the model's family wants for queries or documents."""
    prefix = next((p[0 if query else 1] for family, p in TASK_PREFIXES.items() if family in model), "")
    return lambda texts: embed([prefix + t for t in texts])
