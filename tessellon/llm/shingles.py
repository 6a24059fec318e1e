"""Near-duplicate texts by the exact Jaccard similarity of their word shingles.

Two texts link when their sets of five-word shingles have similarity 0.8 or more. The
candidates are exact (prefix filter): under any one order of all shingles, two such sets
share a shingle among the first n - ceil(0.8 n) + 1 of each. The order is that of the
shingles' hashes, with those that many sets begin with put last, so passages that many
texts quote make candidates only of texts that hold little else.

Equal sets are folded before anything is joined. A shingle that few sets begin with is
joined to pairs, each verified on whole sets. Sets that meet on a crowded shingle are
compared as incidence matrices, cell by cell: that count is quadratic in the group, but
only the links of a spanning forest of two cells leave a task, and no task holds more
than two cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import map_texts, small_batches
from tessellon.llm.simhash import SEED, shingle_hashes
from tessellon.operators.components import connected_components
from tessellon.operators.tables import prefix_sums
from tessellon.session import dropped, written

WORDS = 5
#: Least similarity, as a fraction so that a pair just at it is decided exactly.
PART, WHOLE = 4, 5
#: Sets that may meet on one shingle by comparing pairs, and the most shingles that are put last for being crowded.
CROWD, LAST = 16, 1 << 20
#: Sets (one 64-bit number each) that are broadcast to find their rows, and groups that are broadcast to decide on theirs.
BROADCAST = 1_000_000
#: What a cell of sets holds: shingles, of which each set counts ``LEAST`` more; and columns of one matrix.
CELL, LEAST, COLUMNS = 1 << 20, 512, 1_024


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles, as ``simhash.shingle_hashes`` has them."""
    found = [hashes.view(">i8").ravel() for hashes in shingle_hashes(text, words)]
    return np.unique(np.concatenate(found).astype(np.int64)) if found else np.zeros(0, np.int64)


def among(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the shingles are in the sorted ``last``."""
    return last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found if len(last) else np.zeros(len(found), bool)


def head(found: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The shingles of a set by which it meets all similar ones, those of ``last`` put behind the others."""
    count = len(found) - -(-len(found) * PART // WHOLE) + 1 if len(found) else 0
    if last is not None:
        late = among(found, last)
        found = np.concatenate([found[~late], found[late]])
    return found[:count]


def similar(common, a, b):
    """Whether sets of ``a`` and ``b`` shingles with so many in common are similar enough."""
    return common * (PART + WHOLE) >= PART * (a + b)


def shared(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shingles that several of the sets hold, and for each set the places of those that it holds."""
    flat = np.sort(np.concatenate(sets))
    met = np.unique(flat[1:][flat[1:] == flat[:-1]])
    del flat
    return met, [np.searchsorted(met, s[among(s, met)]).astype(np.int32) for s in sets]


def forest(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs, into ``a`` followed by ``b``, that connect all similar sets of ``a`` and ``b`` to each other."""
    sizes = np.array([len(s) for s in [*a, *b]])
    met, held = shared([*a, *b])
    rows, at = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(h) for h in held]), np.concatenate(held)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    del held, order
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(met), COLUMNS):
        i, j = np.searchsorted(at, [low, low + COLUMNS])
        part = np.zeros((len(sizes), COLUMNS), np.float32)
        part[rows[i:j], at[i:j] - low] = 1
        common += part[: len(a)] @ part[len(a) :].T
    label, out = np.arange(len(sizes)), []
    for i, row in enumerate(common):
        near = len(a) + np.flatnonzero(similar(row.astype(np.int64), sizes[i], sizes[len(a) :]))
        found, first = np.unique(label[near], return_index=True)
        for other, j in zip(found.tolist(), near[first].tolist()):
            if other != label[i]:
                out.append((i, j))
                label[label == other] = label[i]
    return out


def _texts(texts: DataFrame, sets: DataFrame, name: str, scratch: list[str]) -> DataFrame:
    """(sig, text) of one text for each of ``sets`` (sig, th): by broadcast up to ``BROADCAST`` of them, so that other texts stay where they are."""
    sets, _ = written(sets.select("sig", "th").distinct(), name, scratch)
    found = texts.join(F.broadcast(sets) if sets.count() <= BROADCAST else sets, "th")
    return found.groupBy("sig").agg(F.first("text").alias("text"))


def sets_of(texts: DataFrame, sets: DataFrame, words: int, name: str, scratch: list[str]) -> DataFrame:
    """(sig, set) of each of ``sets`` (sig, th)."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, words).tobytes())

    return written(_texts(texts, sets, f"{name}-sigs", scratch).select("sig", packed("text").alias("set")), name, scratch)[0]


def links(texts: DataFrame, distinct: DataFrame, scratch: list[str], words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """(a, b) of sets (by ``sig``) that are similar, enough to connect all that are.

    ``texts`` has the texts (th, text), ``distinct`` one row (sig, th, n, head) for each
    set, with the ``th`` of one of its texts.
    """
    often, _ = written(distinct.select(F.explode("head").alias("t")).groupBy("t").count().where(F.col("count") > crowd), "shingles-often", scratch)
    last = np.sort(often.orderBy(F.col("count").desc(), "t").limit(LAST).select("t").toPandas()["t"].to_numpy(np.int64))
    if len(last):

        @F.pandas_udf("boolean")
        def begins_late(heads: pd.Series) -> pd.Series:
            return heads.map(lambda h: bool(among(np.asarray(h, np.int64), last).any())).astype(bool)

        @F.pandas_udf("array<bigint>")
        def anew(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: head(shingles(t, words), last))

        # a head that holds none of the late shingles is the same under both orders
        late = _texts(texts, distinct.where(begins_late("head")), "shingles-late", scratch)
        heads, _ = written(late.select("sig", anew("text").alias("anew")), "shingles-heads", scratch)
        distinct = distinct.join(heads, "sig", "left").select("sig", "th", "n", F.coalesce("anew", "head").alias("head"))

    # most shingles begin one set only: they are found by themselves, so that what is written and joined is narrow
    several, _ = written(distinct.select(F.explode("head").alias("t")).groupBy("t").count().where("count > 1"), "shingles-several", scratch)
    at = distinct.select("sig", "th", "n", F.posexplode("head").alias("at", "t"))
    shared, _ = written(at.join(several, "t"), "shingles-shared", scratch)

    few = shared.where(F.col("count") <= crowd)
    rest = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))  # the most in common if this shingle is the first
    near = (F.col("l.t") == F.col("r.t")) & (F.col("l.sig") < F.col("r.sig")) & similar(rest, F.col("l.n"), F.col("r.n"))
    ends = (F.struct(F.col(f"{side}.sig"), F.col(f"{side}.th")) for side in "lr")
    met, _ = written(few.alias("l").join(few.alias("r"), near).select(*(e.alias(side) for e, side in zip(ends, "ab"))).distinct(), "shingles-pairs", scratch)
    sets = sets_of(texts, met.select(F.explode(F.array("a", "b")).alias("s")).select("s.*"), words, "shingles-sets", held := [])
    pairs = met.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        unpacked = ((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(a, b))
        return pd.Series([bool(similar(len(np.intersect1d(x, y, True)), len(x), len(y))) for x, y in unpacked], dtype=bool)

    of = lambda side: sets.select(F.col("sig").alias(side), F.col("set").alias(f"set_{side}"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").where(alike("set_a", "set_b")).select("a", "b")
    found, _ = written(found, "shingles-found", scratch)
    dropped(texts.sparkSession, held)

    many = shared.where(F.col("count") > crowd)
    return found if many.isEmpty() else found.unionByName(_crowded(texts, many, words, scratch))


def dealt_in_cells(members: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """``members`` (g, n, sig and more), written with its ``cell``; and its rows dealt to pairs (g, i, j) of cells of a group.

    ``n`` is the size of a set. Pairs of cells that by their sizes hold no similar sets are left out.
    """
    weight = (F.col("n") + LEAST).cast("bigint")
    placed = prefix_sums(members, [F.col("g"), F.col("n"), F.col("sig")], {"before": weight})  # over all groups: a group may be in one cell more, no task sees a whole one
    placed, _ = written(placed.select(*members.columns, F.floor((F.col("before") + weight) / CELL).alias("cell")), "shingles-cells", scratch)
    cells = placed.groupBy("g", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = cells.alias("x"), cells.alias("y")
    tasks = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.cell") <= F.col("y.cell")) & (F.col("x.hi") * WHOLE >= F.col("y.lo") * PART))
    tasks = tasks.select(F.col("x.g").alias("g"), F.col("x.cell").alias("i"), F.col("y.cell").alias("j"))
    return placed, tasks.withColumn("cell", F.explode(F.array_distinct(F.array("i", "j")))).join(placed, ["g", "cell"])


def _crowded(texts: DataFrame, many: DataFrame, words: int, scratch: list[str]) -> DataFrame:
    """Links of sets that meet on crowded shingles; shingles that one set begins with make one group of sets."""
    least, _ = written(many.groupBy("sig").agg(F.min("t").alias("low"), F.first("th").alias("th"), F.first("n").alias("n")), "shingles-least", scratch)
    ties = many.join(least.select("sig", "low"), "sig").select("t", "low").distinct()
    named = connected_components(ties, "t", "low").withColumnsRenamed({"node": "low", "component": "g"})
    members = least.join(named, "low", "left").select("sig", "th", "n", F.coalesce("g", "low").alias("g"))
    members, dealt = dealt_in_cells(members.select("sig", "th", "n", "g"), scratch)
    sets = sets_of(texts, members, words, "shingles-crowded", scratch)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cell", "sig"])
        first = frame["cell"] == frame["i"]
        a, b = frame[first], frame[frame["cell"] == frame["j"]]
        unpack = lambda part: [np.frombuffer(s, np.int64) for s in part["set"]]
        sigs = np.concatenate([a["sig"].to_numpy(np.int64), b["sig"].to_numpy(np.int64)])
        edges = np.array(forest(unpack(a), unpack(b)), np.int64).reshape(-1, 2)
        out = pd.DataFrame({"a": sigs[edges[:, 0]], "b": sigs[edges[:, 1]]})
        return out[out["a"] != out["b"]]

    return dealt.join(sets, "sig").groupBy("g", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def deduplicated(df: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``df`` with one row of each group of similar texts: that of the smallest key, null keys last.

    Columns stay as they are. Of rows with one key and one set of shingles, repeated rows
    among them, that of the least hash over all columns stays. Null and empty texts have
    no shingles and are one group. Texts and sets of shingles are known by 64-bit hashes.
    ``df`` is read several times and should come from a table.
    """
    spark, scratch = df.sparkSession, []
    th = F.xxhash64(df[text])

    def marks(texts: list) -> list[list]:
        found = [shingles(t, words) for t in texts]
        sigs = [int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True) for s in found]
        return [sigs, [len(s) for s in found], [head(s) for s in found]]

    base = df.select(F.struct(df[key].alias("low"), th.alias("th")).alias("k"), df[text].alias("text"))
    with small_batches(spark):
        marked, _ = written(map_texts(base, "k", "text", "sig bigint, n int, head array<bigint>", marks), "shingles-marked", whole := [])
        distinct = marked.groupBy("sig").agg(F.min("k.low").alias("low"), F.count(F.lit(1)).alias("rows"), F.min("k.th").alias("th"), F.first("n").alias("n"), F.first("head").alias("head"))
        distinct, _ = written(distinct, "shingles-distinct", scratch)
        told, _ = written(marked.select("sig", "k.th").distinct(), "shingles-told", scratch)
        dropped(spark, whole)
        texts = df.select(th.alias("th"), df[text].alias("text"))
        joined = connected_components(links(texts, distinct.select("sig", "th", "n", "head"), scratch, words, crowd), "a", "b").withColumnRenamed("node", "sig")
    groups = distinct.select("sig", "low", "rows").join(joined, "sig", "left").select("sig", "low", F.coalesce("component", "sig").alias("component"), (F.col("component").isNotNull() | (F.col("rows") > 1)).alias("several"))
    # a set that one row alone has and none is similar to is kept as it is; only the others are decided on
    several, _ = written(groups.where("several").select("sig", "low", "component"), "shingles-decided-sets", scratch)
    return one_of_each(df, several, told, key, th, scratch)


def one_of_each(df: DataFrame, several: DataFrame, told: DataFrame, key: str, th: Column, scratch: list[str]) -> DataFrame:
    """``df`` with, of each component of ``several`` (sig, low, component), the row of the least ``low``; rows of other texts stay.

    ``low`` is the least key of a ``sig``, ``told`` has the texts' hashes (sig, th), ``th`` is that hash of a row of ``df``.
    """
    spark = df.sparkSession
    best = several.groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("sig"))).alias("best")).select(F.col("best.sig").alias("sig"), F.lit(True).alias("best"))
    decided = several.select("sig", "low").join(best, "sig", "left").join(told, "sig")
    decided, _ = written(decided.select("th", F.struct("sig", "low", F.coalesce("best", F.lit(False)).alias("best")).alias("decided")), "shingles-decided")
    few = decided.count() <= BROADCAST
    dropped(spark, scratch)
    rows = df.select(F.struct(*df.columns).alias("row"), th.alias("th")).join(F.broadcast(decided) if few else decided, "th", "left")
    own = rows.where("decided.best").where(F.col("row")[key].eqNullSafe(F.col("decided.low"))).groupBy("decided.sig").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.where("decided is null").select("row.*").unionByName(own.select("row.*"))
