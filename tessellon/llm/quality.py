"""Operator 4: quality by a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import re
from collections import Counter
from math import log2
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame

from tessellon.llm import fm

_WORDS = re.compile(r"[^\W_]+").findall
_MARKED = re.compile(r"[^\w\s]{2,}(?=\s|$)").findall


def _of(codes: range | bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(codes)] = 1
    return out


_UPPER, _LOWER, _DIGIT, _BAR = _of(range(65, 91)), _of(range(97, 123)), _of(range(48, 58)), _of(b"|")
_SYMBOL = _of([c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"()-?"])


def level(part: float, whole: float) -> int:
    """A share on a scale of doublings, finest near 0."""
    return int(log2(1 + 255 * part / whole)) if whole > 0 else -1


def features(text: str) -> set[str]:
    """Distinct words, and the levels of structure statistics and of the size of a whole text."""
    words = _WORDS(text.lower())
    names = set(words)
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x]
    tokens = len(text.split())
    most = max(Counter(words).values(), default=0)
    levels = {
        "size": int(log2(1 + len(text))),
        "words": int(log2(1 + len(words))),
        "distinct": level(len(names), len(words)) if len(words) < 64 else int(8 * len(names) / len(words)),
        "repeated": level(sum(map(eq, words, words[1:])), len(words)),
        "most": level(most, len(words)),
        "upper": level(octets @ _UPPER, octets @ _UPPER + octets @ _LOWER),
        "digits": level(octets @ _DIGIT, len(text)),
        "symbols": level(octets @ _SYMBOL, len(text)),
        "bars": level(octets @ _BAR, tokens),
        "marked": level(len(_MARKED(text)), tokens),
        "lines": level(len(lines) - len(set(lines)), len(lines)),
        "length": int(len("".join(words)) / len(words)) if words else -1,
    }
    return names | {f" {name}={value}" for name, value in levels.items()}


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", **columns: str) -> fm.Machine:
    return fm.learn(docs, labels, label, learn_from, features, **columns)


def score(docs: DataFrame, machine: fm.Machine, **columns: str) -> DataFrame:
    """(key, score) for every row: the likelihood that its text is good. Null and empty texts get the score of an empty text."""
    return fm.score_texts(docs, machine, features, **columns)
