"""Operator 8: embedding near-duplicates by randomised-rotation binary codes.

Every unit vector is turned by a seeded random rotation and stored as packed bits: the
signs of its coordinates with their correction factor, the inner product of the vector
and its sign vector, and the turned coordinates themselves in four bits each, rounded by
a seeded dither (RaBitQ, Gao and Long 2024). Bit counts of one vector's signs against
another's four bit planes, divided by the factor, estimate the cosine of the two without
bias, and factor and rounding step bound the error. A pair whose estimate plus bound
stays below the threshold is settled by codes alone. Full vectors are fetched only for
vectors with an open pair and recomputed in double precision; pairs at or above the
threshold are links.

Pairs meet where the codes' cross-polytope hashes agree: in each table a few times over,
the largest of random projections names a direction and its sign. The projections are
independent, so the number of tables follows exactly from the chance of one agreement: a
pair just at the threshold meets in one with probability ``RECALL``, closer pairs are
missed far less often. Copies are folded first. A crowded bucket is cut into cells of at
most ``CELL`` vectors, and pairs of cells are tasks of their own, so no task holds an
unbounded bucket. Tasks return open vectors, counts of links and edges of a spanning
forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import BATCH_ROWS
from tessellon.operators.components import connected_components, with_least
from tessellon.session import dropped, written

THRESHOLD, RECALL, SEED = 0.9, 0.98, 23
#: Vectors of one side of a task, bits of a table's key at least and of one hash at most, and standard errors that the bound allows.
CELL, LEAST_KEY_BITS, HASH_BITS, ERRORS = 1_024, 21, 7, 4.0
#: Buckets of up to this many vectors are compared together, across buckets; pairs compared at once.
SMALL, PAIRS = 8, 65_536
#: Bits of a turned coordinate.
LEVELS = 4


def hash_bits(bits: int) -> list[int]:
    """How a key's bits are spread over hashes."""
    whole, rest = divmod(bits, HASH_BITS)
    return [HASH_BITS] * whole + [rest] * (rest > 0)


@lru_cache(maxsize=32)
def agreement(bits: int, threshold: float) -> float:
    """The chance that one hash of so many bits is equal for two vectors just at the threshold.

    Projections on independent normal directions are pairs of normal numbers correlated
    by the cosine, whatever the vectors' length, so a seeded draw of such pairs tells it.
    """
    rng, n, wide = np.random.default_rng((SEED, bits)), 40_000, 1 << bits - 1
    x = rng.normal(size=(n, wide))
    y = threshold * x + (1 - threshold**2) ** 0.5 * rng.normal(size=(n, wide))
    i, j, rows = np.abs(x).argmax(1), np.abs(y).argmax(1), np.arange(n)
    return float(((i == j) & ((x[rows, i] > 0) == (y[rows, j] > 0))).mean())


def tables(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for a count of vectors."""
    bits = min(47, max(LEAST_KEY_BITS, ceil(log2(max(count, 2))) + 4))
    agree = prod(agreement(b, threshold) for b in hash_bits(bits))
    return bits, ceil(log(1 - recall) / log(1 - agree)) if agree < recall else 1


@lru_cache(maxsize=4)
def rotation(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A random orthogonal matrix and the dither of each coordinate."""
    rng = np.random.default_rng((SEED, dim))
    return np.linalg.qr(rng.normal(size=(dim, dim)))[0], rng.random(dim)


@lru_cache(maxsize=128)
def directions(dim: int, table: int, bits: int) -> np.ndarray:
    """The random directions of a table's hashes, one below the other."""
    return np.random.default_rng((SEED, dim, table)).normal(size=(sum(1 << b - 1 for b in hash_bits(bits)), dim)).astype(np.float32)


def unit(vector) -> np.ndarray | None:  # noqa: ANN001
    """The vector in double precision at length 1, or None where it is null, zero or not finite."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    x = np.asarray(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def classes(df: DataFrame, key: str, vector: str, units: bool) -> DataFrame:
    """(id, cls[, unit]): each row, the name of the vectors equal to its own and the unit vector; nulls for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                raw = [None if u is None else u.tobytes() for u in map(unit, part.column(1).to_pylist())]
                names = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                columns = [part.column(0), pa.array(names, pa.binary()), *([pa.array(raw, pa.binary())] if units else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cls", "unit"][: len(columns)])

    base = df.select(F.col(key).alias("id"), F.col(vector))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, cls binary" + ", unit binary" * units)


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    octets = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(octets, ((0, 0), (0, -octets.shape[1] % 8))).view("<u8")


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: packed signs and factor; packed planes of the coordinates in ``LEVELS`` bits, their least value and step."""
    turn, dither = rotation(units.shape[1])
    turned = units @ turn.T
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << LEVELS) - 1), 1e-300)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, (1 << LEVELS) - 1).astype(np.uint8)
    planes = np.concatenate([packed_bits(level >> b & 1) for b in range(LEVELS)], axis=1)
    return packed_bits(turned > 0), np.abs(turned).sum(1) / units.shape[1] ** 0.5, planes, low, step


def table_keys(units: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The keys of unit rows in all tables; a key holds its table's number."""
    rows, x = np.arange(len(units)), units.astype(np.float32)
    out = np.empty((len(units), count), np.int64)
    for t in range(count):
        y, at, key = x @ directions(units.shape[1], t, bits).T, 0, np.zeros(len(units), np.int64)
        for b in hash_bits(bits):
            part = y[:, at : at + (1 << b - 1)]
            best = np.abs(part).argmax(1)
            key = key << b | best << 1 | (part[rows, best] > 0)
            at += 1 << b - 1
        out[:, t] = t << 47 | key
    return out


def coded(distinct: DataFrame, bits: int, count: int) -> DataFrame:
    """``distinct`` (cls, n, low, unit) with the codes of each vector and its keys in all tables."""
    fields = f"cls binary, n bigint, low {distinct.schema['low'].dataType.simpleString()}, unit binary, dim int, code binary, factor double, planes binary, base double, step double, keys array<bigint>"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(r) // 8 for r in batch.column(3).to_pylist()], np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), BATCH_ROWS):
                    part = batch.take(pa.array(rows[at : at + BATCH_ROWS]))
                    units = np.frombuffer(b"".join(part.column(3).to_pylist())).reshape(-1, dim)
                    code, factor, planes, base, step = codes(units)
                    keys = table_keys(units, bits, count)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, count, dtype=np.int32), keys.ravel())
                    raw = lambda words: pa.array([w.tobytes() for w in words], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(units), dim, np.int32)), raw(code), pa.array(factor), raw(planes), pa.array(base), pa.array(step), lists], names=names)

    return distinct.select("cls", "n", "low", "unit").mapInArrow(run, fields)


class Cells:
    """Rows that meet, cell by cell, with the pairs to look at. Rows of a cell are in the order of their classes, so a pair has one direction everywhere."""

    def __init__(self, table: pa.Table):
        self.size = table.num_rows
        column = lambda c: table.column(c).to_numpy()
        self.k, self.side, self.other, self.dim = (column(c) for c in ("k", "side", "other", "dim"))
        self.i, self.j = column("i"), column("j")
        new = (self.k[1:] != self.k[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.edges = np.concatenate([[0], np.flatnonzero(new) + 1, [self.size]])
        #: The place of each row among those of its length.
        self.place, self.rows = np.zeros(self.size, np.int64), {}
        for dim in np.unique(self.dim).tolist():
            rows = self.rows[dim] = np.flatnonzero(self.dim == dim)
            self.place[rows] = np.arange(len(rows))

    def words(self, column: pa.ChunkedArray, dtype: str, dim: int) -> np.ndarray:
        """Binaries of the rows of one length as a matrix."""
        raw = column.take(pa.array(self.rows[dim])).to_pylist()
        return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)

    def pairs(self, done: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, left, right) of rows of equal length that meet; in large cells rows left of which all are ``done`` are passed over."""
        small = []
        for start, end in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            if 2 <= end - start <= SMALL:
                small.append(np.stack(np.triu_indices(end - start, 1)) + start)
                continue
            rows = np.arange(start, end)
            same, first = self.side[rows] == self.other[rows], self.side[rows] < self.other[rows]
            one = same.all()
            left, right = (rows, rows) if one else (rows[first], rows[~first & ~same])
            for k in range(0, len(left), 64):
                part = left[k : k + 64]
                if done is not None and done[part].all() and done[right].all():
                    continue
                i, j = (x.ravel() for x in np.meshgrid(part, right, indexing="ij"))
                if one:
                    i, j = i[i < j], j[i < j]
                yield from self._by_dim(i, j)
        if small:
            i, j = np.concatenate(small, axis=1)
            # a bucket cut into cells shows a pair of one side only where the cell is that side's own
            real = (self.side[i] != self.side[j]) | (self.side[i] == self.other[i])
            i, j = i[real], j[real]
            for k in range(0, len(i), PAIRS):
                yield from self._by_dim(i[k : k + PAIRS], j[k : k + PAIRS])

    def _by_dim(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        i, j = np.minimum(i, j), np.maximum(i, j)
        for dim in self.rows:
            ok = (self.dim[i] == dim) & (self.dim[j] == dim)
            if ok.any():
                yield dim, i[ok], j[ok]


def open_rows(table: pa.Table, threshold: float) -> np.ndarray:
    """The rows with a pair that codes leave open."""
    cells, open_ = Cells(table), np.zeros(table.num_rows, bool)
    factor, base, step = (table.column(c).to_numpy() for c in ("factor", "base", "step"))
    held = {}
    for dim in cells.rows:
        code, planes = cells.words(table.column("code"), "<u8", dim), cells.words(table.column("planes"), "<u8", dim)
        planes = planes.reshape(len(planes), LEVELS, -1)
        total = sum(np.bitwise_count(planes[:, b]).sum(1, dtype=np.int64) << b for b in range(LEVELS))
        held[dim] = code, planes, 2 * np.bitwise_count(code).sum(1, dtype=np.int64) - dim, total
    for dim, i, j in cells.pairs(open_):
        code, planes, signs, total = held[dim]
        a, b = cells.place[i], cells.place[j]
        own = code[a]
        met = sum(np.bitwise_count(own & planes[b, p]).sum(1, dtype=np.int64) << p for p in range(LEVELS))
        f = np.maximum(factor[i], 1e-12)
        guess = (base[j] * signs[a] + step[j] * (2 * met - total[b])) / dim**0.5 / f
        bound = ERRORS * (np.sqrt(np.maximum(1 - f**2, 0)) / max(dim - 1, 1) ** 0.5 + step[j] / 2) / f
        near = guess + bound >= threshold
        open_[i[near]] = open_[j[near]] = True
    return open_


def exact_links(table: pa.Table, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(vectors linked to each row and shown by no earlier table, edges of a spanning forest)."""
    cells, total, edges = Cells(table), np.zeros(table.num_rows, np.int64), []
    n, number = table.column("n").to_numpy(), cells.k >> 47
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    units = {dim: cells.words(table.column("unit"), "<f8", dim) for dim in cells.rows}
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    for dim, i, j in cells.pairs():
        for t in range(int(number[i].max())):
            shown = (number[i] > t) & (keys[i, t] == keys[j, t])
            i, j = i[~shown], j[~shown]
            if not len(i):
                break
        if not len(i):
            continue
        near = np.einsum("ij,ij->i", units[dim][cells.place[i]], units[dim][cells.place[j]]) >= threshold
        i, j = i[near], j[near]
        np.add.at(total, i, n[j])
        np.add.at(total, j, n[i])
        for x, y in zip(i.tolist(), j.tolist()):
            if (a := root(x)) != (b := root(y)):
                parent[a] = b
                edges.append((x, y))
    return total, edges


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole cells; the last cell of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
        table = pa.Table.from_batches(held)
        same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in enumerate(last)])
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


CELL_FIELDS = "k bigint, i int, j int, side int, other int, cls binary"


def open_members(parts: DataFrame, codes_: DataFrame, threshold: float) -> DataFrame:
    """Those of ``parts`` (cell, side, other, cls) that have an open pair in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            yield from table.select(range(6)).filter(pa.array(open_rows(table, threshold))).to_batches()

    rows = parts.join(codes_.select("cls", "dim", "code", "factor", "planes", "base", "step"), "cls")
    rows = rows.select("k", "i", "j", "side", "other", "cls", "dim", "code", "factor", "planes", "base", "step")
    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "cls").mapInArrow(run, CELL_FIELDS)


def links(members: DataFrame, codes_: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for a class, vectors linked to it in one task (b null), or an edge between classes (links null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            total, edges = exact_links(table, threshold)
            cls, some = table.column("cls"), np.flatnonzero(total)
            left, right = (np.array([e[s] for e in edges], np.int64) for s in (0, 1))
            a = pa.concat_arrays([x.combine_chunks() for x in (cls.take(pa.array(some)), cls.take(pa.array(left)))])
            b = pa.concat_arrays([pa.nulls(len(some), pa.binary()), cls.take(pa.array(right)).combine_chunks()])
            yield pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.array(total[some]), pa.nulls(len(edges), pa.int64())])], names=["a", "b", "links"])

    rows = members.join(codes_.select("cls", "dim", "n", "unit", "keys"), "cls")
    rows = rows.select("k", "i", "j", "side", "other", "cls", "dim", "n", "unit", "keys")
    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "cls").mapInArrow(run, "a binary, b binary, links bigint")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", cell: int = CELL) -> DataFrame:
    """(key, n_links, component, kept) for every row.

    ``n_links`` counts the other rows whose vectors were found within the threshold,
    ``component`` is the smallest key reachable by links, and ``kept`` says whether that
    is the row's own. Vectors that are null, empty, zero, or hold nulls or numbers that
    are not finite link with nothing, nor do vectors of different length; equal vectors
    always link. A row with a null key is never kept. An empty table gives no rows.
    """
    spark, scratch = df.sparkSession, []
    bits, count = tables(df.count(), threshold)
    distinct = classes(df, key, vector, True).where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit"), F.min("id").alias("low"))
    own, _ = written(coded(distinct, bits, count), "vectors-codes", scratch)
    dealt = own.select("cls", F.explode("keys").alias("k"))
    sizes = dealt.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k", F.ceil(F.col("size") / cell).cast("int").alias("cuts"))
    buckets, _ = written(sizes, "vectors-buckets", scratch)
    side = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")
    parts = dealt.join(buckets, "k").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    parts = parts.select("k", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "other", "cls")
    members, _ = written(open_members(parts, own, threshold), "vectors-open", scratch)
    found, _ = written(links(members, own, threshold), "vectors-links", scratch)
    linked = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    joined = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "cls")
    named, _ = written(own.select("cls", "n", "low").join(joined, "cls", "left").select("cls", "n", "low", F.coalesce("component", "cls").alias("component")), "vectors-components", scratch)
    lowest = with_least(named, "component", "low", "lowest", named.count(), scratch).join(linked, F.col("cls") == F.col("a"), "left")
    # written, so that both sides of the last join come straight from a shuffle and a vector of many copies can be split
    answer, _ = written(lowest.select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "lowest"), "vectors-named")
    dropped(spark, scratch)
    out = classes(df, key, vector, False).join(answer, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("lowest"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
