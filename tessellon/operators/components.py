"""Connected components of an undirected edge list.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Every step gives each node's edges the least end among
them, which is pre-aggregated before its shuffle. Least ends go back to the edges by
broadcast while there are at most ``BROADCAST``; beyond that they are written, so the
join reads two plain tables and adaptive execution can split a node of very high degree.
Each step's edges are written to the shared folder, which keeps the plan short and
survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessellon.session import dropped, written


#: Least ends (an id pair each) that are broadcast at most.
BROADCAST = 200_000


def with_least(rows: DataFrame, key: str, value: str, name: str, most: int, scratch: list[str]) -> DataFrame:
    """``rows`` with the least ``value`` of its ``key``, of which there are at most ``most``.

    ``rows`` is read twice.
    """
    least = rows.groupBy(key).agg(F.min(value).alias(name))
    return rows.join(F.broadcast(least) if most <= BROADCAST else written(least, "least", scratch)[0], key)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it can reach.

    Edges with a null end are ignored; loops and repeated edges are harmless; nodes
    without an edge to another node are absent. Node columns may be of any orderable type.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state, scratch = None, []
    for _ in range(max_rounds):
        seen = Observation()
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        now, path = written(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("h")), "components")
        dropped(spark, scratch)
        scratch.append(path)
        count = seen.get["n"]
        if state == (found := (count, seen.get["h"])) or not count:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = found
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred = with_least(both, "u", "v", "w", 2 * count, scratch).where("v > u").select(F.col("v").alias("u"), F.least("u", "w").alias("v"))
        large = starred if count <= BROADCAST else written(starred, "components-star", scratch)[0]  # few are made twice, many are read twice
        # small star: every smaller neighbour of a node, and the node itself, is tied to the least of them
        small = with_least(large, "u", "v", "low", count, scratch)
        ends = F.array(*(F.struct(F.col(c).alias("u"), F.col("low").alias("v")) for c in ("u", "v")))
        pairs = small.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
