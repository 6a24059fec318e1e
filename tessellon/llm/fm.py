"""Factorisation machines over hashed text features, for operators 4 and 6.

A text becomes a set of hashed features: its words, their letter runs and its
statistics. The machine scores a set with a bias, a weight for each feature and a
low-rank vector for each feature whose inner products weigh every pair; by the identity  sum of pairs = (square of sum - sum of squares) / 2  that costs
time linear in the features. Training is on a bounded, seeded sample of labelled rows
(``SAMPLE`` rows of each label at most, weighted back to the labels' true shares), on
features that are associated with the label in that sample. Those are counted on the
executors, so what the driver gets is ``MOST`` features of the sample's rows at most.
Scoring runs over all rows in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import map_texts
from tessellon.session import drop_path, written

#: The names of a text's features, and the finer features that a name stands for.
Features = Callable[[str], Iterable[str]]

#: Labelled rows of each label that training uses at most.
SAMPLE = 2_000
#: Hash space of the features, and the names whose hash a worker remembers.
SPACE, MEMO = 1 << 24, 100_000
#: A feature is used if this many sampled rows have it and its chi-square statistic is this large; at most ``MOST``.
LEAST_ROWS, LEAST_CHI, MOST = 3, 16.0, 2_048
RANK, STEPS, RATE, DECAY, SEED = 8, 200, 0.05, 1e-3, 11


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SPACE


def finer(name: str, runs: tuple[int, ...]) -> list[str]:
    """A name with its runs of letters of the given lengths, by which inflected forms share features."""
    held = f"<{name}>"
    return [name, *(held[i : i + n] for n in runs for i in range(len(held) - n + 1))]


def packed(names: Iterable[str], runs: tuple[int, ...] = ()) -> bytes:
    """The distinct buckets of all finer features, ascending, as unsigned 32-bit integers."""
    return np.array(sorted({bucket(f) for name in names for f in finer(name, runs)}), "<u4").tobytes()


@dataclass
class Machine:
    """Scores sets of hashed features; ``place`` maps a bucket to its row of weights."""

    place: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    runs: tuple[int, ...] = ()

    def __post_init__(self):
        self.memo: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def rows_of(self, names: Iterable[str]) -> list[int]:
        memo, place, out = self.memo, self.place, set()
        if len(memo) > MEMO:
            memo.clear()
        for name in names:
            if (at := memo.get(name)) is None:
                at = memo[name] = tuple({place[b] for b in map(bucket, finer(name, self.runs)) if b in place})
            if at:
                out.update(at)
        return sorted(out)

    def scores(self, sets: list[list[int]]) -> np.ndarray:
        lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        owner, at = np.repeat(np.arange(len(sets)), lengths), np.fromiter((i for s in sets for i in s), np.int64, int(lengths.sum()))
        margin = self.bias + np.bincount(owner, self.weights[at], len(sets))
        for column in self.vectors.T:
            x = column[at]
            margin += 0.5 * (np.bincount(owner, x, len(sets)) ** 2 - np.bincount(owner, x * x, len(sets)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def trained(sets: list[np.ndarray], labels: list[int], weights: list[float], chosen: list[int], runs: tuple[int, ...] = (), seed: int = SEED) -> Machine:
    """Fit a machine to sets of buckets, of which it uses the ``chosen``. With one label only, or no rows, it knows no more than the share of ones."""
    y, own = np.array(labels, np.float32), np.array(weights, np.float32)
    share = float((y * own).sum() / own.sum()) if len(y) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    place = {b: i for i, b in enumerate(sorted(chosen))}
    if not place or len(set(labels)) < 2:
        return Machine({}, prior, np.zeros(0), np.zeros((0, RANK)), runs)
    chosen = np.array(sorted(place), "<u4")
    x = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(chosen, s[np.isin(s, chosen, assume_unique=True)])] = 1
    rng = np.random.default_rng(seed)
    parts = [p.astype(np.float32) for p in (np.array([prior]), np.zeros(len(place)), rng.normal(0, 0.01, (len(place), RANK)))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    scale = own / own.sum()
    for step in range(1, STEPS + 1):
        bias, w, v = parts
        sums = x @ v
        margin = bias[0] + x @ w + 0.5 * ((sums**2).sum(1) - x @ (v**2).sum(1))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * scale
        pull = x.T @ error
        slopes = [np.array([error.sum()]), pull + DECAY * w / len(place) ** 0.5, x.T @ (error[:, None] * sums) - v * pull[:, None] + DECAY * v]
        for p, g, a, b in zip(parts, slopes, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(parts[0][0]), parts[1], parts[2], runs)


def associated(rows: DataFrame, most: int = MOST) -> list[int]:
    """The buckets most associated with the label in labelled rows (__y, buckets), at most ``most``, by the chi-square statistic.

    Each task counts its own rows first; the counts are summed and ranked in Spark.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(raw, "<u4")
                held.append((found, np.full(len(found), y, np.int64)))
        if held:
            names, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            ones = np.bincount(at, np.concatenate([h[1] for h in held]), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64)), pa.array(ones.astype(np.int64))], names=["b", "n", "ones"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__y"), F.lit(0)).alias("ones")).first()
    every, all_ones = float(total["n"]), float(total["ones"])
    if not 0 < all_ones < every:
        return []
    n, ones = F.col("n").cast("double"), F.col("ones").cast("double")
    gap = ones * every - n * all_ones
    chi = every * gap * gap / F.greatest(n * (every - n) * all_ones * (every - all_ones), F.lit(1.0))
    counts = rows.select("__y", "buckets").mapInArrow(counted, "b bigint, n bigint, ones bigint").groupBy("b").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    best = counts.where(F.col("n") >= LEAST_ROWS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.col("chi").desc(), "b").limit(most)
    return [r["b"] for r in best.select("b").collect()]


def bucketed(df: DataFrame, features: Features, key: str, text: str, runs: tuple[int, ...]) -> DataFrame:
    """(key, buckets binary) for every row."""
    return map_texts(df, key, text, "buckets binary", lambda texts: [[packed(features(t or ""), runs) for t in texts]])


def learn(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, features: Features, key: str = "doc_id", text: str = "text", runs: tuple[int, ...] = (), sample: int = SAMPLE) -> Machine:
    """A machine trained on a bounded sample of the rows of ``labels`` for which ``learn_from`` holds.

    Rows without key or label are skipped; a key labelled twice counts as 1 if one of its
    labels is; a key with several texts is learned from one of them. The sample is by a
    hash of the key, so reruns learn the same machine.
    """
    known = labels.where(learn_from & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("__y"))
    shares = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.col(key)), F.col(key)]
    some = known.where("__y = 0").orderBy(*order).limit(sample).unionByName(known.where("__y = 1").orderBy(*order).limit(sample))
    rows = docs.select(key, text).join(F.broadcast(some), key)  # the sample's bound is the broadcast's
    one = bucketed(rows, features, key, text, runs).groupBy(key).agg(F.min("buckets").alias("buckets")).join(F.broadcast(some), key)
    one, path = written(one.select(key, "__y", "buckets"), "fm-sample")  # counted first, then read again
    chosen = associated(one)
    wanted = np.array(sorted(chosen), "<u4")

    @F.pandas_udf("binary")
    def of_chosen(sets: pd.Series) -> pd.Series:
        return sets.map(lambda raw: (found := np.frombuffer(raw, "<u4"))[np.isin(found, wanted, assume_unique=True)].tobytes())

    got = sorted(((r[key], r["__y"], r["buckets"]) for r in one.select(key, "__y", of_chosen("buckets").alias("buckets")).collect()), key=lambda r: r[0])
    drop_path(docs.sparkSession, path)
    counts = {y: sum(r[1] == y for r in got) for y in shares}
    return trained([np.frombuffer(r[2], "<u4") for r in got], [r[1] for r in got], [shares[r[1]] / counts[r[1]] for r in got], chosen, runs)


def score_texts(df: DataFrame, machine: Machine, features: Features, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) for every row; null texts count as empty, repeated rows stay."""

    def batch(texts: list) -> list[list]:
        return [machine.scores([machine.rows_of(features(t or "")) for t in texts]).tolist()]

    return map_texts(df, key, text, "score double", batch)


def score_column(machine: Machine, features: Features) -> Callable[[Column], Column]:
    """A column function for the score, for use inside a larger plan."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.scores([machine.rows_of(features(t or "")) for t in texts]))

    return scored


def remainder(key: Column, parts: int) -> Column:
    """The fold of a row: CRC-32 of its key as text, modulo ``parts``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(0))
