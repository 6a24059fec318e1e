"""Near copies by operator 5, each of its links checked on the texts' shingles.

Two texts link when their SimHash fingerprints differ in at most ``DISTANCE`` bits and
their sets of five-word shingles have Jaccard similarity 0.8 or more. Fingerprints are
those of operator 5, of word pairs: a changed word changes two of them and five of the
shingles, so texts of that similarity lie within fewer bits than by longer runs of words.
Fingerprints are linked by pigeonhole blocks, every pair within the distance, and their
components are the groups in which texts may link; only texts of such groups are read
again. There every pair within the distance is checked on whole sets, in cells of bounded
size, two to a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import shingles
from tessellon.llm.arrow import map_texts, small_batches
from tessellon.llm.simhash import fingerprint, wide_links
from tessellon.operators.components import connected_components
from tessellon.session import dropped, written

#: Words of a shingle that votes for the fingerprint, and the most bits by which linked fingerprints differ.
PAIR, DISTANCE = 2, 10


def checked(prints: np.ndarray, sets: list[np.ndarray], cross: int = 0, distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """Index pairs that connect all that link, those of the first ``cross`` to the others; all to each other where it is 0."""
    sizes, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    met, held = shingles.shared(sets)
    mark = np.zeros(len(met), bool)
    for x in range(cross or len(sets)):
        low = cross or x + 1
        near = np.bitwise_count(prints[x] ^ prints[low:]) <= distance
        near &= (label[low:] != label[x]) & shingles.similar(np.minimum(sizes[x], sizes[low:]), sizes[x], sizes[low:])
        if not len(near := low + np.flatnonzero(near)):
            continue
        mark[held[x]] = True
        ends = np.cumsum([len(held[y]) for y in near])
        sums = np.concatenate([[0], np.cumsum(mark[np.concatenate([held[y] for y in near])])])
        mark[held[x]] = False
        common = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        for y in near[shingles.similar(common, sizes[x], sizes[near])].tolist():
            if label[y] != label[x]:
                yield x, y
                label[label == label[y]] = label[x]


def links(texts: DataFrame, distinct: DataFrame, scratch: list[str], distance: int = DISTANCE, words: int = shingles.WORDS) -> DataFrame:
    """(a, b) of texts (by ``th``) that connect all that link.

    ``texts`` has the texts (th, text), ``distinct`` one row (th, fp) for each text, written.
    """
    prints, _ = written(distinct.select("fp").distinct(), "near-prints", scratch)
    named = connected_components(wide_links(prints, distance), "a", "b").withColumnRenamed("node", "fp")
    groups, _ = written(distinct.join(named, "fp", "left").select("th", "fp", F.coalesce("component", "fp").alias("g")), "near-groups", scratch)
    # written, so that a large group's rows come to the join from a plain shuffle, which can be split
    several, _ = written(groups.groupBy("g").count().where("count > 1").select("g"), "near-several", scratch)
    members, _ = written(groups.join(several, "g"), "near-members", scratch)
    sets = shingles.sets_of(texts, members.select(F.col("th").alias("sig"), "th"), words, "near-sets", scratch)
    sizes = sets.select(F.col("sig").alias("th"), (F.octet_length("set") / 8).cast("int").alias("n"))
    _, dealt = shingles.dealt_in_cells(members.join(sizes, "th").select(F.col("th").alias("sig"), "fp", "g", "n"), scratch)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """All groups of a cell, or of a pair of cells."""
        out = []
        for _, part in frame.sort_values(["g", "cell", "sig"]).groupby("g"):
            first, sigs = int((part["cell"] == part["i"]).sum()), part["sig"].to_numpy(np.int64)
            found = checked(part["fp"].to_numpy(np.int64).view(np.uint64), [np.frombuffer(s, np.int64) for s in part["set"]], first % len(part), distance)
            out += [(sigs[x], sigs[y]) for x, y in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return dealt.join(sets, "sig").select("g", "i", "j", "cell", "sig", "fp", "set").groupBy("i", "j").applyInPandas(compare, "a bigint, b bigint")


def deduplicated(df: DataFrame, distance: int = DISTANCE, words: int = shingles.WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of linked texts: that of the smallest key, null keys last.

    Columns stay as they are. Of rows with one key and text, repeated rows among them,
    that of the least hash over all columns stays. Null and empty texts have fingerprint
    0 and no shingles and are one group. Texts are known by 64-bit hashes. ``df`` is read
    several times and should come from a table.
    """
    spark, scratch = df.sparkSession, []
    th = F.xxhash64(df[text])
    base = df.select(F.struct(df[key].alias("low"), th.alias("th")).alias("k"), df[text].alias("text"))
    with small_batches(spark):
        marked, _ = written(map_texts(base, "k", "text", "fp bigint", lambda texts: [[fingerprint(t, PAIR) for t in texts]]), "near-marked", whole := [])
        distinct = marked.groupBy("k.th").agg(F.min("k.low").alias("low"), F.count(F.lit(1)).alias("rows"), F.first("fp").alias("fp"))
        distinct, _ = written(distinct, "near-distinct", scratch)
        dropped(spark, whole)
        joined = connected_components(links(df.select(th.alias("th"), df[text].alias("text")), distinct.select("th", "fp"), scratch, distance, words), "a", "b").withColumnRenamed("node", "th")
    several = distinct.join(joined, "th", "left").where("component is not null or rows > 1")
    several, _ = written(several.select(F.col("th").alias("sig"), "low", F.coalesce("component", "th").alias("component")), "near-decided-texts", scratch)
    return shingles.one_of_each(df, several, several.select("sig", F.col("sig").alias("th")), key, th, scratch)
