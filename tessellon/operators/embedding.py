"""Embedding text by a pluggable model; the default hashes features and needs nothing but the text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 256
_WORDS = re.compile(r"\w+")


def hash_embed(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Unit rows of signed hashed words and word pairs; a text without words is a zero row."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        words = _WORDS.findall((t or "").lower())
        for f in [*words, *map(" ".join, zip(words, words[1:]))]:
            h = zlib.crc32(f.encode())
            out[i, h % dims] += 1 if h & 0x80000000 else -1
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def embed(column: Column, model: Callable[[list[str]], np.ndarray] = hash_embed) -> Column:
    """A column of unit vectors; null stays null. The model is called once for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            vectors = model([t or "" for t in part])
            yield pd.Series([None if t is None else v for t, v in zip(part, vectors)])

    return run(column)


def embed_missing(df: DataFrame, text: str, vector: str, model: Callable[[list[str]], np.ndarray] = hash_embed) -> DataFrame:
    """``df`` with vectors for the rows that have a text and no vector yet."""
    kind = df.schema[vector].dataType
    todo = df.where(F.col(vector).isNull() & F.col(text).isNotNull()).withColumn(vector, embed(F.col(text), model).cast(kind))
    return df.where(F.col(vector).isNotNull() | F.col(text).isNull()).unionByName(todo)
