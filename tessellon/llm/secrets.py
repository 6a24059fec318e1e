"""Operator 9: secret scans.

Patterns propose candidates: keys with a known prefix, values assigned to a telling name,
private key blocks, and long runs that mix letters and digits. A random forest then
removes false findings. It sees a candidate's length, its character transitions, how far
words of a dictionary cover it, the path of its document and the words beside it. It is
trained from labelled findings; ``labelled_findings`` makes a seeded set of them, of
which ``FINDINGS`` are used by default. The dictionary is the words of a public
tokenizer's vocabulary, whose path is a parameter.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import parts

FINDINGS, SEED = 4_000, 31
TREES, DEPTH, LEAST_LEAF = 40, 9, 4
#: Letters of a dictionary's word at least.
LEAST_WORD = 4
#: Characters on each side whose words are neighbours.
NEAR = 48

_KNOWN = [
    ("cloud-key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("service-token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk-[A-Za-z0-9]{20,64}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])")),
    ("private-key", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----")),
]
_MARKS = ("AKIA", "ASIA", "gh", "xox", "sk-", "AIza", "-----BEGIN")
_ASSIGN = re.compile(r"[:=]")
_NAME = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}$")
_VALUE = re.compile(r"[:=]{0,2}\s{0,3}[\"']?([^\s\"'<>,;]{6,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_WORD = re.compile(r"[A-Za-z]{3,}")

#: Neighbours that speak for or against a finding, and paths of what is no real code.
FOR = frozenset("password passwd pwd secret token key credential auth login apikey api access bearer aws".split())
AGAINST = frozenset("example sample dummy fake placeholder test commit sha sha1 sha256 md5 hash checksum digest revision uuid guid build version isbn etag blob".split())
PATHS = re.compile(r"(?i)test|example|sample|fixture|mock|doc")

NAMES = ("length", "entropy", "transitions", "digits", "upper", "vowels", "repeats", "runs", "covered", "path", "for", "against", "assigned", "quoted", "hex", "known")


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str
    value: str
    before: str
    after: str


def candidates(text: str | None) -> list[Finding]:
    """Proposed spans in code points, leftmost first, none inside another of an earlier pattern."""
    text = text or ""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def add(start: int, end: int, kind: str) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))

    if any(map(text.__contains__, _MARKS)):
        for kind, pattern in _KNOWN:
            for m in pattern.finditer(text):
                add(*m.span(), kind)
    for m in _ASSIGN.finditer(text):
        if _NAME.search(text, max(0, m.start() - 24), m.start()) and (v := _VALUE.match(text, m.start())):
            add(*v.span(1), "assigned")
    for m in _RUN.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            add(*m.span(), "run")
    return [Finding(a, b, k, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]) for a, b, k in sorted(found)]


def _kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=2)
def dictionary(vocabulary: str) -> ahocorasick.Automaton:
    """The words of a tokenizer's rank file, those of ``LEAST_WORD`` letters or more that it has at the start of a word, ready to be searched for."""
    words = ahocorasick.Automaton()
    with open(vocabulary, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and len(token) > LEAST_WORD and token[1:].isalpha() and token.isascii():
                word = token[1:].decode().lower()
                words.add_word(word, len(word))
    words.make_automaton()
    return words


def covered(value: str, vocabulary: str) -> float:
    """The share of a value's characters that words of the dictionary cover."""
    marked = bytearray(len(value))
    low = value.lower()
    if len(low) == len(value):
        for end, size in dictionary(vocabulary).iter(low):
            marked[end + 1 - size : end + 1] = b"\1" * size
    return sum(marked) / max(len(value), 1)


def measured(f: Finding, path: str | None, vocabulary: str) -> list[float]:
    """The forest's view of a finding, in the order of ``NAMES``."""
    v, n = f.value, max(len(f.value), 1)
    counts = [v.count(c) for c in set(v)]
    kinds = [_kind_of(c) for c in v]
    near = {w.lower() for w in _WORD.findall(f.before + " " + f.after)}
    longest = run = 1
    for a, b in zip(v, v[1:]):
        run = run + 1 if a == b or ord(b) - ord(a) == 1 else 1
        longest = max(longest, run)
    return [
        n,
        -sum(c / n * log2(c / n) for c in counts),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        sum(c in "aeiouAEIOU" for c in v) / n,
        sum(a == b for a, b in zip(v, v[1:])) / n,
        longest / n,
        covered(v, vocabulary),
        float(bool(PATHS.search(path or ""))),
        float(len(near & FOR)),
        float(len(near & AGAINST)),
        float(f.before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(f.before[-1:] in ("\"", "'")),
        float(all(c in string.hexdigits for c in v)),
        float(f.kind in ("cloud-key", "service-token", "private-key")),
    ]


class Forest:
    """A random forest of binary trees: bagged rows, a random few features at each split, Gini gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._grown(x[rows := rng.integers(0, len(x), len(x))], y[rows], depth, rng) for _ in range(trees)]

    def _grown(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> list[np.ndarray]:
        nodes: list[tuple[int, float, int, int, float]] = []

        def grow(rows: np.ndarray, left: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, float(y[rows].mean())))
            best = (1e-9, -1, 0.0)
            if left and 0 < nodes[at][4] < 1:
                for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    values, ones = x[order, f], np.cumsum(y[order])
                    cut = np.flatnonzero(values[1:] > values[:-1])
                    cut = cut[(cut + 1 >= LEAST_LEAF) & (len(rows) - cut - 1 >= LEAST_LEAF)]
                    if len(cut):
                        n, a, all_, total = cut + 1.0, ones[cut], len(rows), ones[-1]
                        b = total - a
                        gain = (a * a / n + (n - a) ** 2 / n + b * b / (all_ - n) + (all_ - n - b) ** 2 / (all_ - n)) / all_ - (total**2 + (all_ - total) ** 2) / all_**2
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), int(f), float(values[cut[k]] + values[cut[k] + 1]) / 2)
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[at] = (best[1], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1), nodes[at][4])
            return at

        grow(np.arange(len(x)), depth)
        return [np.array(c) for c in zip(*nodes)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for feature, limit, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at[inner]]
                at[inner] = np.where(x[inner, f] <= limit[at[inner]], low[at[inner]], high[at[inner]])
            total += share[at]
        return total / len(self.trees)


#: What made-up placeholders are put together of.
FILLERS = "admin change default demo dummy enter example fake here insert key login name password placeholder replace sample secret some test token user value your".split()


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, path, label): a seeded set of lines, each with a secret (1) or with what only looks like one (0)."""
    rng = random.Random(seed)
    letters, digits = string.ascii_letters, string.digits
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
    phrase = lambda: " ".join(word() for _ in range(rng.randrange(2, 8)))
    name = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apiKey", "access-key", "auth", "client_secret"])
    assign = lambda v: rng.choice([f"{name()}={v}", f'{name()} = "{v}"', f"{name()}: {v}", f"{name().upper()}='{v}'"])
    real = [
        lambda: "AKIA" + some(string.ascii_uppercase + digits, 16),
        lambda: "ghp_" + some(letters + digits, 36),
        lambda: "sk-" + some(letters + digits, rng.randrange(20, 50)),
        lambda: assign(some("0123456789abcdef", rng.choice([16, 18, 20, 32, 40, 64]))),
        lambda: assign(some("0123456789ABCDEF", rng.choice([18, 32, 40]))),
        lambda: assign(some(letters + digits, rng.randrange(10, 44))),
        lambda: assign(some(letters + digits + "!#$%&*+-_/", rng.randrange(9, 30))),
        lambda: "Bearer " + some(letters + digits + "-_", rng.randrange(24, 60)),
    ]
    part = lambda: "".join(rng.choice([w.capitalize(), w, w.upper(), w + rng.choice("-_")]) for w in rng.choices(FILLERS, k=rng.randrange(2, 5)))
    false = [
        lambda: "AKIA" + rng.choice(["EXAMPLE", "SAMPLE", "TESTKEY", "XXXXXXX"]).ljust(16, rng.choice("XA0E")),
        lambda: assign(part()),
        lambda: assign(rng.choice("x*0a.") * rng.randrange(6, 24)),
        lambda: assign(rng.choice(["", "my"]) + rng.choice(FILLERS) + rng.choice(["123", "1234", "-here", "_value", ""]) + rng.choice(FILLERS)),
        lambda: f"{rng.choice(['commit', 'sha1', 'checksum', 'revision', 'md5', 'etag'])} {some('0123456789abcdef', rng.choice([32, 40, 64]))}",
        lambda: f"{rng.choice(['uuid', 'guid', 'build'])} {'-'.join(some('0123456789abcdef', n) for n in (8, 4, 4, 4, 12))}",
        lambda: f"{word()}-{word()}-{word()}-{word()}-{rng.randrange(2000)}-{word()}",
        lambda: f"{part()}{rng.randrange(100)}{part()}_{part()}",
        lambda: assign(word() + word() + word()),
        lambda: f"{word()}/{word()}/{word()}/{word()}/{word()}{rng.randrange(10)}.html",
        lambda: assign("123456789012345678901234567890"[: rng.randrange(8, 30)]),
    ]
    out = []
    for i in range(count):
        made = rng.choice(real if i % 2 else false)()
        path = rng.choice(["lib/net", "web", "app/main", "deploy"]) if i % 2 or rng.random() < 0.6 else rng.choice(["tests/unit", "examples", "docs", "fixtures"])
        hint = rng.choice(FILLERS) + " example " if not i % 2 and rng.random() < 0.2 else ""
        out.append((f"{phrase()} {hint}{made} {phrase()}", path, i % 2))
    return out


def trained(labelled: list[tuple[str, str, int]], vocabulary: str, seed: int = SEED) -> Forest:
    """A forest from labelled lines (text, path, label); every candidate in a line has its label."""
    rows, ys = [], []
    for text, path, label in labelled:
        for f in candidates(text):
            rows.append(measured(f, path, vocabulary))
            ys.append(label)
    if not rows:
        raise ValueError("no labelled line holds a candidate")
    return Forest(np.array(rows), np.array(ys, float), seed=seed)


def scan(df: DataFrame, forest: Forest, vocabulary: str, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """(key, start, end, kind, score, is_secret) of every candidate in every text.

    ``vocabulary`` is the path of a rank file that every executor has, whose words are
    the dictionary. ``path`` is a column that says where a text comes from; it needs not be
    a file's path. Spans are in code points, end exclusive, and no two of a text overlap.
    Whole texts are searched, however long. Null and empty texts have no candidates, a
    null path is no evidence, equal candidates in one text or in repeated rows are each
    given and score alike where their surroundings are alike, and an empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                owner, found, rows = [], [], []
                for i, (t, p) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for f in candidates(t):
                        owner.append(i)
                        found.append(f)
                        rows.append(measured(f, p, vocabulary))
                if rows:
                    score = forest.scores(np.array(rows)).round(6)
                    columns = [part.column(0).take(pa.array(owner)), pa.array([f.start for f in found], pa.int64()), pa.array([f.end for f in found], pa.int64()), pa.array([f.kind for f in found]), pa.array(score), pa.array(score >= threshold)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "start", "end", "kind", "score", "is_secret"]
    base = df.select(F.col(key), F.col(text), F.col(path).cast("string"))
    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, start bigint, end bigint, kind string, score double, is_secret boolean")
