"""String similarities without a relational form, as Arrow-batched column functions over plain Python."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine word per row of bits (Hyyrö 2004)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """100 x 2 LCS / (sum of lengths): similarity by insertions and deletions alone; two empty strings are alike."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def sequence_ratio(a: str | None, b: str | None) -> float | None:
    """Ratcliff-Obershelp similarity from 0 to 1."""
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def cover_density(terms: Iterable[str], positions: dict[str, list[int]]) -> float:
    """Sum over minimal covers of 1 / (extra words in the cover + 1), after Clarke, Cormack and Tudhope (2000).

    A cover is a shortest run of positions that holds every term. A single term scores
    its count.
    """
    wanted = set(terms)
    if not wanted or not wanted <= positions.keys():
        return 0.0
    events = sorted((p, t) for t in wanted for p in positions[t])
    last: dict[str, int] = {}
    score, start_before = 0.0, -1
    for p, t in events:
        last[t] = p
        if len(last) == len(wanted) and (start := min(last.values())) > start_before:
            score += 1.0 / (p - start - len(wanted) + 2)
            start_before = start
    return score


def _pairwise(function):  # noqa: ANN001, ANN202
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def indel(a: Column, b: Column) -> Column:
    return _pairwise(indel_ratio)(a, b)


def sequence_match(a: Column, b: Column) -> Column:
    return _pairwise(sequence_ratio)(a, b)


def cover_rank(query_terms: Column, document_terms: Column) -> Column:
    """Cover density of an array of query terms over a document's terms in order."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, documents: pd.Series) -> pd.Series:
        out = []
        for wanted, words in zip(queries, documents):
            positions: dict[str, list[int]] = {}
            need = set(wanted)
            for i, w in enumerate(words):
                if w in need:
                    positions.setdefault(w, []).append(i)
            out.append(cover_density(need, positions))
        return pd.Series(out, dtype="float64")

    return run(query_terms, document_terms)


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def split_sentences(text: str | None) -> list[str]:
    """Sentences after collapsing whitespace: a stop, a blank, and what follows."""
    flat = " ".join((text or "").split())
    return [s for s in _SENTENCE.split(flat) if s]
