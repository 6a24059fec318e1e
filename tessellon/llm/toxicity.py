"""Operator 6: toxicity by a factorisation machine over hashed terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from tessellon.llm import fm

_WORDS = re.compile(r"[^\W_]+").findall


#: Lengths of the letter runs that words are also hashed by.
RUNS = (4, 5)


def terms(text: str) -> set[str]:
    """The distinct words of a whole text; which of them occur together is for the machine's pairs to weigh."""
    return set(_WORDS(text.lower()))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", **columns: str) -> fm.Machine:
    return fm.learn(docs, labels, label, learn_from, terms, runs=RUNS, **columns)


def score(docs: DataFrame, machine: fm.Machine, **columns: str) -> DataFrame:
    """(key, score) for every row: the likelihood that its text is toxic. Null and empty texts get the score of no terms."""
    return fm.score_texts(docs, machine, terms, **columns)


def kept(docs: DataFrame, machine: fm.Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; their columns stay as they are.

    A machine that has learned no feature (no labelled row, or rows of one label only)
    scores all texts alike and cannot tell them apart, so it rejects none.
    """
    if not machine.place:
        return docs
    return docs.where(fm.score_column(machine, terms)(docs[text]) < threshold)
