"""Vector column functions on arrays of numbers; all arithmetic is in double precision and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order; null where the lengths differ."""
    a, b = doubles(a), doubles(b)
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or unequal lengths."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(v)
    scale = F.array_repeat(F.when(length > 0, length).otherwise(F.lit(1.0)), F.size(v))  # computed once, not for each coordinate
    return F.zip_with(doubles(v), scale, lambda x, s: x / s)


def truncate(v: Column, dims: int, renormalize: bool = False) -> Column:
    """The first ``dims`` coordinates, as nested embeddings allow; 1 to 1024 dims."""
    if not 1 <= dims <= 1024:
        raise ValueError("dims must be from 1 to 1024")
    cut = F.slice(doubles(v), 1, dims)
    return normalize(cut) if renormalize else cut


def parse(text: Column) -> Column:
    """'[0.1,0.2]' as an array of doubles; null where it is no such text."""
    return F.from_json(text, "array<double>")


def render(v: Column) -> Column:
    """The vector as text with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: F.format_string("%.6f", x)), ","), F.lit("]"))


def weight_bucket(similarity: Column) -> Column:
    """1 + floor(9 x similarity): 1 to 10 for similarities from 0 to 1."""
    return (1 + F.floor(9 * similarity)).cast("int")
