"""Operator 5: SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint is cut into more blocks than bits may differ, so two close fingerprints
agree on at least ``blocks - distance`` whole blocks. Each distinct fingerprint is dealt
out once for each choice of that many blocks; fingerprints meet on equal blocks, and the
Hamming distance is part of the join condition, so only true links leave the join. More
blocks are used as the count of distinct fingerprints grows, which keeps the share of
fingerprints that meet by chance level; every layout finds every link.

Copies share a fingerprint and are folded before anything is joined. A block value that
more than ``DENSE`` distinct fingerprints share is not joined: two fingerprints are
within d bits exactly when some value lies within d/2 bits of both, so its members are
dealt out to the values around them and linked to the least member that meets them
there. That work is linear in the members, and exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import map_texts
from tessellon.operators.components import connected_components, with_least
from tessellon.session import dropped, written

BITS, SEED = 64, 42
#: Distinct fingerprints that may meet on one block value by comparing pairs.
DENSE = 1_024
#: Bytes of text whose shingles are hashed at once.
SLICE = 1 << 18
#: Fingerprints that one task compares with as many others; a block value that more share is dealt out in cells of so many, two to a task.
CELL = 4_096
#: Fingerprints compared at once.
CHUNK = 1 << 18
#: Comparisons of two fingerprints that cost as much as dealing one out.
RATE = 2_000
#: Chance meetings of a fingerprint that are still cheap; beyond it a layout of more blocks is used.
MEETINGS = 200

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BYTE_OFFSETS = np.arange(8) * 256
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, words: int, size: int | None = None) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles in order, a row of 8 octets each, for a slice of the text at a time.

    Only A-Z are lower-cased; words end at a space or at the characters 9 to 13. Fewer
    words than a shingle make one shingle of them all; no words make none. A slice has
    ``size`` bytes and what is left of its last word, so the lists of words stay short
    however long the text is.
    """
    raw, size, digest = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER), size or SLICE, xxhash.xxh64_digest
    at, before, none = 0, [], True
    while at < len(raw):
        blank = _BLANK.search(raw, at + size)
        end = blank.start() if blank else len(raw)
        parts = before + raw[at:end].split()
        at = end
        line = b" ".join(parts)
        ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[:-1])]
        if hashes := b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]):
            none = False
            yield np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        before = parts[max(0, len(parts) - words + 1) :]
    if none and before:
        yield np.frombuffer(digest(b" ".join(before), SEED), np.uint8).reshape(1, 8)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The signed 64-bit SimHash of a text: the hash of each shingle votes for each bit; no words give 0."""
    seen, count = np.zeros(2048, np.int64), 0
    for octets in shingle_hashes(text, words):
        seen += np.bincount((octets + _BYTE_OFFSETS).ravel(), minlength=2048)
        count += len(octets)
    votes = (seen.reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(votes * 2 > count).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint) for every row; a null text counts as empty, whose fingerprint is 0."""
    return map_texts(df, key, text, "fp bigint", lambda texts: [[fingerprint(t, words) for t in texts]])


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [_signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def layout(count: int, distance: int) -> int:
    """The least number of blocks with which a fingerprint meets few others by chance."""
    for blocks in range(distance + 1, 2 * distance + 3):
        if count * comb(blocks, distance) / 2 ** (BITS * (blocks - distance) / blocks) <= MEETINGS:
            break
    return max(blocks, distance + 2)


def links(prints: DataFrame, distance: int = 4, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """(a, b) of fingerprints that differ in at most ``distance`` bits, enough to connect all that do.

    ``prints`` has one row (fp) for each distinct fingerprint. Pairs outside dense blocks
    come out once each; those inside are linked by way of a common member.
    """
    blocks = blocks or layout(prints.count(), distance)
    masks, shared = block_masks(blocks), blocks - distance
    chosen = [(sum(1 << i for i in c), sum(masks[i] for i in c)) for c in combinations(range(blocks), shared)]
    dealt = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in chosen))).alias("x")).select("fp", "x.t", "x.k")
    heavy, _ = written(dealt.groupBy("t", "k").count().where(F.col("count") > dense).select("t", "k"), "simhash-dense")
    crowded = not heavy.isEmpty()
    light = dealt.join(heavy, ["t", "k"], "left_anti") if crowded else dealt
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    equal = sum((F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)), F.lit(0))
    first, rest = F.lit(0), equal  # a pair is reported for the first blocks it agrees on only
    for _ in range(shared):
        low = rest.bitwiseAND(-rest)
        first, rest = first.bitwiseOR(low), rest.bitwiseXOR(low)
    near = (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(x) <= distance) & (F.col("l.t") == first)
    pairs = light.alias("l").join(light.alias("r").hint("merge"), near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    if crowded:
        members = dealt.join(heavy, ["t", "k"], "left_semi").select("fp").distinct()
        pairs = pairs.unionByName(links_by_centre(members, distance))
    return pairs


def links_by_centre(prints: DataFrame, distance: int) -> DataFrame:
    """Links by way of the values around each fingerprint: at most a few thousand rows for each, however many are close."""
    near, far = distance // 2, distance - distance // 2
    around = lambda radius: [_signed(sum(1 << i for i in c)) for c in combinations(range(BITS), radius)]
    flips = [(m, r) for r in range(far + 1) for m in around(r)]
    at = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(r).alias("r")) for m, r in flips))).alias("x"))
    at = at.select("fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("centre"), F.col("x.r").alias("r"))
    least = at.groupBy("centre").agg(F.min(F.when(F.col("r") <= near, F.col("fp"))).alias("low"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("low is not null and lo <> hi")
    return at.join(least, "centre").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def wide_layout(count: int, distance: int) -> int:
    """The number of blocks with which dealing out and comparing so many fingerprints together cost least."""
    return min(range(distance + 2, 2 * distance + 3), key=lambda b: comb(b, distance) * (1 + count / 2 ** (BITS * (b - distance) / b) / RATE))


def joined_pairs(prints: np.ndarray, masks: np.ndarray, turn: int, distance: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) that connect all pairs of ``prints`` (unsigned) that are near and not reported by other choices of blocks.

    A pair belongs to the first choice of ``shared`` blocks that it agrees on; ``turn``
    is this one, as bits. Where there are more such pairs than fingerprints, each
    fingerprint is paired with the least one that it is connected to by near pairs.
    """
    found, count, label = [], 0, None
    step = max(1, CHUNK // len(prints))
    for at in range(0, len(prints), step):
        x, y = np.nonzero(np.bitwise_count(prints[at : at + step, None] ^ prints[None, at:]) <= distance)
        x, y = x[y > x] + at, y[y > x] + at
        if not len(x):
            continue
        equal = ((prints[x] ^ prints[y])[:, None] & masks == 0).astype(np.int64)
        own = ((equal * (equal.cumsum(1) <= shared)) << np.arange(len(masks))).sum(1) == turn
        x, y = x[own], y[own]
        count += len(x)
        if label is None:
            found.append((x, y))
            if count <= len(prints):
                continue
            label = np.arange(len(prints))
            x, y = (np.concatenate(side) for side in zip(*found))
        while len(x):
            lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            apart = lo < hi
            x, y = x[apart], y[apart]
            np.minimum.at(label, hi[apart], lo[apart])
            while (label != (up := label[label])).any():
                label = up
    if label is not None:
        b = np.flatnonzero(label != np.arange(len(prints)))
        return label[b], b
    return tuple(np.concatenate(side) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def wide_links(prints: DataFrame, distance: int, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """(a, b) that connect all fingerprints within ``distance`` bits: like ``links``, for distances at which many meet by chance.

    Fingerprints that agree on a choice of blocks are compared as arrays; a choice that
    more than ``cell`` agree on is cut into cells, and each pair of cells is a task.
    ``prints`` has one row (fp) for each distinct fingerprint and is read several times.
    """
    blocks = blocks or wide_layout(prints.count(), distance)
    masks, shared = block_masks(blocks), blocks - distance
    turns = list(combinations(range(blocks), shared))
    whole = [sum(masks[i] for i in c) for c in turns]
    dealt = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.hash(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).alias("k")) for t, m in enumerate(whole)))).alias("x")).select("fp", "x.t", "x.k")
    heavy, _ = written(dealt.groupBy("t", "k").count().where(F.col("count") > cell).select("t", "k", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "simhash-heavy")
    unsigned, every = np.array(masks, np.int64).view(np.uint64), np.array([sum(1 << i for i in c) for c in turns])

    def compared(run: np.ndarray, turn: int) -> pa.RecordBatch:
        a, b = joined_pairs(run.view(np.uint64), unsigned, every[turn], distance, shared)
        return pa.RecordBatch.from_arrays([pa.array(run[a]), pa.array(run[b])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])  # t, what tells groups apart, fp
            now = now if left is None else np.concatenate([left, now], 1)
            ends = np.flatnonzero((now[:-1, 1:] != now[:-1, :-1]).any(0)) + 1
            for low, high in zip([0, *ends], ends):
                if high - low > 1:
                    yield compared(now[-1, low:high], now[0, low])
            left = now[:, ends[-1] if len(ends) else 0 :]
        if left is not None and left.shape[1] > 1:
            yield compared(left[-1], left[0, 0])

    def by(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(compare, "a bigint, b bigint")

    if heavy.isEmpty():
        return by(dealt, "t", "k")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = dealt.join(heavy, ["t", "k"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return by(dealt.join(heavy, ["t", "k"], "left_anti"), "t", "k").unionByName(by(cells, "t", "k", "i", "j"))


def grouped(df: DataFrame, distance: int, words: int, key: str, text: str, blocks: int | None, dense: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (id, fp), and the groups (fp, component, low) of the distinct ones.

    ``component`` is the least fingerprint of a group, ``low`` the least id of a fingerprint. Both are written tables.
    """
    scratch: list[str] = []
    prints, _ = written(fingerprints(df, words, key, text).withColumnsRenamed({key: "id"}), "simhash")
    distinct, _ = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct", scratch)
    joined = connected_components(links(distinct.select("fp"), distance, blocks, dense), "a", "b").withColumnRenamed("node", "fp")
    groups, _ = written(distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "low"), "simhash-groups")
    dropped(df.sparkSession, scratch)
    return prints, groups


def near_duplicates(df: DataFrame, distance: int = 4, words: int = 4, key: str = "doc_id", text: str = "text", blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the smallest key it reaches by links.

    Rows link when their fingerprints differ in at most ``distance`` bits, equal ones
    included. Null and empty texts have fingerprint 0 and link like any other; rows with
    a null key take part but never name a component unless it has no other key; repeated
    rows stay; an empty table gives no rows.
    """
    prints, groups = grouped(df, distance, words, key, text, blocks, dense)
    scratch: list[str] = []
    lowest = with_least(groups, "component", "low", "lowest", groups.count(), scratch)
    # written, so that both sides of the last join come straight from a shuffle and a fingerprint of many copies can be split
    named, _ = written(lowest.select("fp", "lowest"), "simhash-named")
    dropped(df.sparkSession, scratch)
    return prints.join(named, "fp").select(F.col("id").alias(key), "fp", F.col("lowest").alias("component"))


def deduplicated(df: DataFrame, distance: int = 4, words: int = 4, key: str = "doc_id", text: str = "text", blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """``df`` with one row of each group of near duplicates: that of the smallest key, null keys last.

    Columns stay as they are. Of rows with one key and fingerprint, repeated rows among
    them, that of the least hash over all columns stays.
    """
    _, groups = grouped(df, distance, words, key, text, blocks, dense)
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp"))).alias("best")).select("best.low", "best.fp")

    @F.pandas_udf("bigint")
    def print_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, words))

    # called nondeterministic so that no filter is pushed below it, which would compute it twice
    rows = df.select(F.struct(*df.columns).alias("row"), print_of.asNondeterministic()(df[text]).alias("fp"))
    rows = rows.select("row", "fp", F.xxhash64(F.col("row")[key], F.col("fp")).alias("h"))
    best = best.select("fp", F.xxhash64("low", "fp").alias("h"), "low")
    # the hash makes keys null-safe for the join; the key itself decides
    left = rows.join(best, ["h", "fp"]).where(F.col("row")[key].eqNullSafe(F.col("low")))
    return left.groupBy("h", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
