"""Embedding of texts by a caller's model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import ship

#: texts encoded at once
BATCH = 64


def embed(df: DataFrame, text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], *, prefix: str = "", batch: int = BATCH) -> Column:
    """The unit vector (float) of each text; a null text has none, a zero vector stays zero.

    ``load`` gives the encoder and runs once a task.  Questions take their
    instruction as ``prefix``; documents are encoded as they are.
    """
    ship(df.sparkSession)

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            known = [prefix + t for t in texts if t is not None]
            parts = [np.asarray(encoder(known[k : k + batch]), float) for k in range(0, len(known), batch)]
            m = np.concatenate(parts) if parts else np.empty((0, 1))
            n = np.linalg.norm(m, axis=1, keepdims=True)
            units = iter((m / np.where(n == 0, 1, n)).astype(np.float32))
            yield pd.Series([None if t is None else next(units) for t in texts], dtype=object)

    return encode(text)


class Encoders:
    """Encoders by name; an unknown name is a ValueError."""

    def __init__(self, **loaders: Callable):
        self.loaders = loaders

    def __getitem__(self, name: str) -> Callable:
        if name not in self.loaders:
            raise ValueError(f"unknown encoder: {name}")
        return self.loaders[name]


def letter_counts() -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: how often each of 26 letters occurs.  For tests and examples."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], float).reshape(len(texts), 26)

    return encode
