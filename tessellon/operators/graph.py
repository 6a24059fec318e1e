"""The entity graph: building it, walking it, resolving entities and finding communities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.functions.similarity import indel_ratio
from tessellon.operators.components import connected_components
from tessellon.operators.leiden import divided
from tessellon.operators.pairs import with_cosines
from tessellon.operators.search import ranked, within_budget
from tessellon.operators.tables import numbered, upsert_names
from tessellon.session import drop_path, written

#: Tokens above which a community has no summary, and the text where it has no edges.
MOST_TOKENS, NO_EDGES = 8_000, "No internal relationships found."
#: Characters of a piece of a community's context.
PIECE = 1 << 20
#: Names of one side of a task that compares them.
NAMES = 512


def entities_of(relations: DataFrame) -> DataFrame:
    """(entity_name): distinct filled sources and targets."""
    return relations.select(F.explode(F.array("source", "target")).alias("entity_name")).where("entity_name <> ''").distinct()


def resolved_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``relations`` with from_entity and to_entity; those with an end that is no entity are dropped."""
    a = entities.select(F.col("entity_id").alias("from_entity"), F.col("entity_name").alias("source"))
    b = entities.select(F.col("entity_id").alias("to_entity"), F.col("entity_name").alias("target"))
    return relations.join(a, "source").join(b, "target")


def built_graph(chunks: DataFrame, extract: Callable[[Column], Column], known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a knowledge graph from chunks (chunk_id, document_id, content).

    ``extract`` gives a text of triplet lines for a chunk's content; lines that are no
    triplets, and chunks without any, add nothing. Entities keep the ids they have in
    ``known`` (entity_id, entity_name) and new ones follow by name. The result holds
    ``entities`` (entity_id, entity_name), ``relations`` (from_entity, to_entity,
    description, summary, chunk_id, document_id; one for each line, repeats included),
    ``entity_documents`` and ``entity_chunks``.
    """
    lines = chunks.select("chunk_id", "document_id", F.explode(tx.triplets(extract(F.col("content")))).alias("t")).select("chunk_id", "document_id", "t.*")
    lines, _ = written(lines, "graph-lines")  # a model is asked once for each chunk
    have = known if known is not None else chunks.sparkSession.createDataFrame([], "entity_id bigint, entity_name string")
    entities, _ = written(upsert_names(have, entities_of(lines)), "graph-entities")
    ends = lines.select("chunk_id", "document_id", F.explode(F.array("source", "target")).alias("entity_name")).join(entities, "entity_name")
    return {
        "entities": entities,
        "relations": resolved_relations(lines, entities).select("from_entity", "to_entity", "description", "summary", "chunk_id", "document_id"),
        "entity_documents": ends.select("entity_id", "document_id").distinct(),
        "entity_chunks": ends.select("entity_id", "chunk_id").distinct(),
    }


def graph_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(nodes, edges) of a graph's tables."""
    return entities.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(relations.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def relation_weights(relations: DataFrame, entities: DataFrame, id_col: str = "entity_id", vector: str = "embedding") -> DataFrame:
    """``relations`` with ``weight`` filled from the cosine of its ends where it is null and both have vectors."""
    own = F.col("weight") if "weight" in relations.columns else F.lit(None).cast("int")
    return with_cosines(relations, entities, "__cosine", id_col=id_col, vector=vector).withColumn("weight", F.coalesce(own, vx.weight_bucket(F.col("__cosine")))).drop("__cosine")


def simple_graph(relations: DataFrame, nodes: DataFrame | None = None, node: str = "entity_id") -> DataFrame:
    """(u, v, weight), u <= v: parallel and opposite edges fold, the last rel_id's weight stays, null weighs 1.

    With ``nodes``, edges whose ends are not both nodes are dropped.
    """
    edges = relations
    if nodes is not None:
        ids = nodes.select(node)
        edges = edges.join(ids, edges["from_entity"] == ids[node], "left_semi")
        edges = edges.join(ids, edges["to_entity"] == ids[node], "left_semi")
    low, high = F.least("from_entity", "to_entity"), F.greatest("from_entity", "to_entity")
    return edges.groupBy(low.alias("u"), high.alias("v")).agg(F.max_by(F.coalesce("weight", F.lit(1)), "rel_id").alias("weight"))


def connected_nodes(nodes: DataFrame, edges: DataFrame, node: str = "entity_id") -> DataFrame:
    """Nodes with at least one edge, a loop included."""
    ends = edges.select(F.explode(F.array("u", "v")).alias(node)).distinct()
    return nodes.join(ends, node, "left_semi")


def khop_edges(relations: DataFrame, seeds: DataFrame, depth: int, node: str = "node") -> DataFrame:
    """(rel_id): edges on undirected walks of 1 to ``depth`` steps from the seeds.

    Those are the edges with an end at most depth - 1 steps away, so each step needs the
    frontier alone; it is written between steps and never leaves the cluster.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    both = relations.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b")).unionByName(relations.select(F.col("to_entity").alias("a"), F.col("from_entity").alias("b"))).distinct()
    reached = seeds.select(F.col(node).alias("n")).distinct()
    frontier, last = reached, None
    for _ in range(depth - 1):
        step = both.join(frontier, both["a"] == frontier["n"], "left_semi").select(F.col("b").alias("n")).distinct().join(reached, "n", "left_anti")
        frontier, path = written(step, "khop")
        reached, new = written(reached.unionByName(frontier), "khop-reached")
        if last:
            for p in last:
                drop_path(relations.sparkSession, p)
        last = (path, new)
        if frontier.isEmpty():
            break
    near = reached.select("n")
    hits = relations.join(near, relations["from_entity"] == near["n"], "left_semi").select("rel_id")
    return hits.unionByName(relations.join(near, relations["to_entity"] == near["n"], "left_semi").select("rel_id")).distinct()


def deepen(relations: DataFrame, seeds: DataFrame, enough: Callable[[DataFrame, int], bool], most: int = 4) -> tuple[DataFrame, int]:
    """Edges at the least depth from 1 to ``most`` whose edges are enough, and that depth."""
    for depth in range(1, most + 1):
        found = khop_edges(relations, seeds, depth)
        if depth == most or enough(found, depth):
            break
    return found, depth


def ranked_relations(relations: DataFrame, found: DataFrame, question: list[float], vector: str = "embedding") -> DataFrame:
    """``relations`` of the ids in ``found`` (rel_id) with similarity to a question's vector and rank by it, those without a vector last."""
    asked = F.array(*map(F.lit, map(float, question)))
    near = relations.join(found.select("rel_id"), "rel_id", "left_semi").withColumn("similarity", vx.cosine(F.col(vector), asked))
    return ranked(near, [], [F.col("similarity").desc_nulls_last(), F.col("rel_id")])


def graph_retrieval(relations: DataFrame, seeds: DataFrame, question: list[float], budget: int, enough: Callable[[DataFrame], bool], most: int = 4, vector: str = "embedding", tokens: str = "tokens") -> DataFrame:
    """The context of a question from the graph: (rel_id, tokens, similarity, rank, running_tokens, depth).

    ``seeds`` (node) are the entities near those that the question names. The relations
    on walks from them are ranked by similarity to the question and cut to the token
    budget; while ``enough`` says no to that context, walks grow by a step, ``most`` at most.
    """
    for depth in range(1, most + 1):
        close = ranked_relations(relations, khop_edges(relations, seeds, depth), question, vector)
        kept = within_budget(close, [], [F.col("rank")], tokens, budget)
        context, _ = written(kept.select("rel_id", tokens, "similarity", "rank", "running_tokens", F.lit(depth).alias("depth")), "graph-context")
        if depth == most or enough(context):
            return context
    raise ValueError("walks need at least one step")


def mergeable_pairs(pairs: DataFrame, entities: DataFrame, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """Pairs (u, v, ...) whose two names may both be merged; a missing name may not."""
    ok = entities.where(tx.mergeable(F.col(name))).select(id_col)
    return pairs.join(ok, pairs["u"] == ok[id_col], "left_semi").join(ok, F.col("v") == ok[id_col], "left_semi")


def entity_groups(pairs: DataFrame, threshold: float = 0.9, names: DataFrame | None = None, id_col: str = "entity_id", name: str = "entity_name") -> tuple[DataFrame, DataFrame]:
    """Groups (component, size, representative, confidence) and members (node, component) of pairs (u, v, sim).

    With ``names`` only pairs whose two names may be merged count. The representative is
    the member with most pairs, the smallest of several; confidence is the mean similarity.
    """
    kept = pairs.where(F.col("sim") >= threshold).select("u", "v", "sim")
    edges, _ = written(kept if names is None else mergeable_pairs(kept, names, id_col, name), "entity-pairs")
    members, _ = written(connected_components(edges, "u", "v"), "entity-members")
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    best = members.join(degree, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("representative"))
    sure = edges.join(members, edges["u"] == members["node"]).groupBy("component").agg(F.avg("sim").alias("confidence"))
    return best.join(sure, "component").select("component", "size", "representative", "confidence"), members


def group_summary(groups: DataFrame) -> DataFrame:
    """One row on groups (size, confidence): how many, their members, and mean, largest and smallest size and confidence."""
    n, c = F.col("size"), F.col("confidence")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum(n).alias("members"), F.avg(n).alias("mean_size"), F.max(n).alias("largest"), F.min(n).alias("smallest"), F.avg(c).alias("mean_confidence"), F.max(c).alias("highest"), F.min(c).alias("lowest"))


def alike_names(names: DataFrame, least: float, block: int = NAMES) -> DataFrame:
    """(u, v) of nodes (component, node, name) of one component whose names have an indel ratio of ``least`` or more, enough to connect all such.

    Equal names meet by grouping. The others of a component are dealt to blocks of about
    ``block`` names, and each pair of blocks is one task that gives a spanning forest of
    its links, so neither a task nor what it returns grows with the component.
    """
    one, _ = written(names.groupBy("component", F.lower("name").alias("name")).agg(F.min("node").alias("low")), "alike-names")
    cuts = one.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "cuts")
    dealt = one.join(cuts, "component").withColumn("b", F.pmod(F.xxhash64("name"), "cuts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("component", "low", "name", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("low")
        a, b = part[part["b"] == part["i"].iloc[0]], part[part["b"] == part["j"].iloc[0]]
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        out = []
        for u, x in zip(a["low"], a["name"]):
            for v, y in zip(b["low"], b["name"]):
                # a ratio is at most twice the shorter length over both
                if 200 * min(len(x), len(y)) >= least * (len(x) + len(y)) and (p := root(u)) != (q := root(v)) and indel_ratio(x, y) >= least:
                    parent[max(p, q)] = min(p, q)
                    out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"])

    kind = names.schema["node"].dataType.simpleString()
    links = dealt.groupBy("component", "i", "j").applyInPandas(compare, f"u {kind}, v {kind}")
    copies = names.join(one, (names["component"] == one["component"]) & (F.lower(names["name"]) == one["name"])).where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    return links.unionByName(copies)


def refined_groups(members: DataFrame, names: DataFrame, least: float = 90.0, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """(component, node, subgroup): groups of more than two, split by string similarity of their mergeable names.

    A group is replaced by the connected parts of two or more names only where more than
    one such part is left; else it stays whole. ``subgroup`` is the smallest member's id.
    """
    rows = members.join(names.select(F.col(id_col).alias("node"), F.col(name).alias("name")), "node", "left").withColumn("ok", tx.mergeable(F.coalesce("name", F.lit(""))))
    rows, _ = written(rows.select("component", "node", "name", "ok"), "refined-names")
    whole = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    large = rows.where("ok").join(whole.where("n > 2").select("component"), "component", "left_semi")
    parts = connected_components(alike_names(large.select("component", "node", "name"), least), "u", "v").select("node", F.col("component").alias("part"))
    placed, _ = written(large.select("component", "node").join(parts, "node"), "refined-parts")
    several = placed.groupBy("component").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("component")
    replaced = placed.join(several, "component", "left_semi").select("component", "node", F.col("part").alias("subgroup"))
    kept = rows.select("component", "node").join(several, "component", "left_anti").join(whole.select("component", F.col("first").alias("subgroup")), "component")
    return replaced.unionByName(kept.select("component", "node", "subgroup"))


def validated_groups(members: DataFrame, names: DataFrame, decide: Callable[[Column], Column] | None = None, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """(node, representative, confidence, resolved_name, label) after a decision on each group (group, node, representative, confidence).

    ``decide`` gets the array of a group's names, "Entity_<id>" where one is missing, and
    gives an answer that ``tx.merge_decision`` reads. A group that is answered NO falls
    apart: each member represents itself with confidence 0. A group without any name is
    not asked about, and a null answer, the sign of a failed call, leaves it as it is.
    Without ``decide`` every group is accepted.
    """
    named = members.join(names.select(F.col(id_col).alias("node"), F.col(name).alias("name")), "node", "left")
    named, _ = written(named.select("group", "node", "representative", "confidence", "name"), "validated-names")
    shown = F.array_sort(F.collect_list(F.struct("node", F.coalesce("name", F.concat(F.lit("Entity_"), F.col("node").cast("string"))).alias("shown"))))
    asked = named.groupBy("group").agg(F.transform(shown, lambda x: x["shown"]).alias("names"), F.count("name").alias("known"))
    answer = F.lit("Decision: YES") if decide is None else decide(F.col("names"))
    asked = asked.select("group", F.when(F.col("known") > 0, answer).alias("answer"))
    asked = asked.select("group", F.when(F.col("answer").isNotNull(), tx.merge_decision(F.col("answer"))).alias("said"))
    no = F.coalesce(~F.col("said.merge"), F.lit(False))
    out = named.join(asked, "group")
    return out.select(
        "node",
        F.when(no, F.col("node")).otherwise(F.col("representative")).alias("representative"),
        F.when(no, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~no, F.nullif(F.col("said.name"), F.lit(""))).alias("resolved_name"),
        F.when(~no, F.col("said.confidence")).alias("label"),
    )


def decision_counts(validated: DataFrame) -> DataFrame:
    """(label, groups): approved groups by the confidence that came with the decision."""
    return validated.where("label is not null").groupBy("label").agg(F.count_distinct("representative").alias("groups"))


def apply_merges(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations with each end replaced by its representative (node, representative).

    Loops go, and relations that then have equal ends fold to the one of the least
    rel_id, whose other columns stay; only the weight is the largest of all.
    """
    to = lambda c: merges.select(F.col("node").alias(c), F.col("representative").alias(f"__{c}"))
    out = relations.join(to("from_entity"), "from_entity", "left").join(to("to_entity"), "to_entity", "left")
    ends = [F.coalesce(f"__{c}", c).alias(c) for c in ("from_entity", "to_entity")]
    others = [c for c in relations.columns if c not in ("from_entity", "to_entity", "rel_id", "weight")]
    folded = [F.min("rel_id").alias("rel_id"), *([F.max("weight").alias("weight")] if "weight" in relations.columns else [])]
    if others:
        folded.append(F.min_by(F.struct(*others), "rel_id").alias("__row"))
    merged = out.select(*ends, *(c for c in relations.columns if c not in ("from_entity", "to_entity"))).where("from_entity <> to_entity").groupBy("from_entity", "to_entity").agg(*folded)
    return merged.select("from_entity", "to_entity", "rel_id", *([F.col("weight")] if "weight" in relations.columns else []), *(F.col(f"__row.{c}").alias(c) for c in others))


def merged_links(links: DataFrame, merges: DataFrame, node: str, linked: str) -> DataFrame:
    """(node, linked): what entities are linked to, moved to their representatives, once each."""
    to = merges.select(F.col("node").alias(node), F.col("representative").alias("__to"))
    return links.join(to, node, "left").select(F.coalesce("__to", node).alias(node), linked).distinct()


def merged_entities(entities: DataFrame, merges: DataFrame, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """Entities without those that another represents; a resolved name replaces the representative's own."""
    to = merges.select(F.col("node").alias(id_col), "representative", *(["resolved_name"] if "resolved_name" in merges.columns else []))
    out = entities.join(to, id_col, "left").where(F.col("representative").isNull() | (F.col("representative") == F.col(id_col)))
    if "resolved_name" in merges.columns:
        out = out.withColumn(name, F.coalesce("resolved_name", name))
    return out.select(*entities.columns)


def resolved_entities(pairs: DataFrame, names: DataFrame, decide: Callable[[Column], Column] | None = None, threshold: float = 0.9, least: float = 90.0, id_col: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """Entity resolution end to end: (node, representative, confidence, resolved_name, label) of all grouped entities.

    Similar pairs whose names may be merged are grouped, groups are refined by their
    names and put to the decision. A group that refinement leaves whole keeps its
    representative; that of a part is its smallest member.
    """
    groups, members = entity_groups(pairs, threshold, names, id_col, name)
    parts = refined_groups(members, names, least, id_col, name)
    several = parts.groupBy("component").agg(F.count_distinct("subgroup").alias("parts"))
    own = groups.join(several, "component").select("component", "confidence", F.when(F.col("parts") == 1, F.col("representative")).alias("__whole"))
    placed = parts.join(own, "component").select(F.col("subgroup").alias("group"), "node", F.coalesce("__whole", "subgroup").alias("representative"), "confidence")
    return validated_groups(placed, names, decide, id_col, name)


def communities(edges: DataFrame, most: int = 10, max_level: int = 4, seed: int = 1, nodes: DataFrame | None = None, node: str = "entity_id") -> DataFrame:
    """(node, level, cluster, parent) of a hierarchy of Leiden communities over edges (u, v, weight).

    Where there is no edge at all, each of ``nodes`` is a community of its own on level 0.

    Components are found on the cluster and divided one by one, so every run agrees. A
    community of more than ``most`` nodes is divided again on the next level. ``cluster``
    is the component's smallest node and the community's place in it.
    """
    edges, _ = written(edges.select("u", "v", F.col("weight").cast("double").alias("weight")), "community-edges")
    if nodes is not None and edges.isEmpty():
        own = nodes.select(F.col(node).alias("node")).distinct()
        return own.select("node", F.lit(0).alias("level"), F.concat(F.col("node").cast("string"), F.lit(":0")).alias("cluster"), F.lit(None).cast("string").alias("parent"))
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    members = connected_components(edges, "u", "v")
    members = members.unionByName(loops.join(members, "node", "left_anti").distinct())

    kind = edges.schema["u"].dataType.simpleString()
    fields = f"node {kind}, level int, cluster string, parent string"
    schema = to_arrow_schema(edges.sparkSession.createDataFrame([], fields).schema)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, root = [], None
        for batch in batches:
            root = batch.column(0)[0].as_py() if root is None else root
            ends.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)])
        u, v, w = map(np.concatenate, zip(*ends))
        ends.clear()
        name = lambda c: None if c is None else f"{root}:{c}"
        for members, level, c, p in divided(u, v, w, most, seed, max_level):
            n = len(members)
            yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip((members, [level] * n, [name(c)] * n, [name(p)] * n), schema.types)], schema=schema)

    owned = edges.join(members, edges["u"] == members["node"]).select("component", "u", "v", "weight")
    return owned.groupBy("component").applyInArrow(divide, fields)


def community_tables(divided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (community_id, level, parent, num_nodes) and members (community_id, node) of divided nodes."""
    groups = divided.groupBy("level", "cluster").agg(F.first("parent").alias("parent_cluster"), F.count_distinct("node").alias("num_nodes"))
    ids, _ = written(numbered(groups, ["level", "cluster"], "community_id"), "community-ids")
    up = ids.select(F.col("cluster").alias("parent_cluster"), F.col("community_id").alias("parent"))
    out = ids.join(up, "parent_cluster", "left").select("community_id", "level", "parent", "num_nodes")
    return out, divided.join(ids.select("cluster", "community_id"), "cluster").select("community_id", "node").distinct()


def summarised_communities(context: DataFrame, summarise: Callable[[Column], Column], attempts: int = 2) -> DataFrame:
    """``context`` with a summary for each community; those that are too long, or have none after ``attempts`` calls, are dropped.

    ``summarise`` gives a text for a context, null where a call fails.
    """
    left, done = context.where("not too_long"), None
    for _ in range(attempts):
        asked, _ = written(left.withColumn("summary", summarise(F.col("context"))), "community-summaries")
        good = asked.where("summary is not null")
        done = good if done is None else done.unionByName(good)
        left = asked.where("summary is null").drop("summary")
    return done


def community_links(members: DataFrame, links: DataFrame, linked: str) -> DataFrame:
    """(community_id, linked): what the nodes of each community are linked to, once each."""
    return members.join(links, "node").select("community_id", linked).distinct()


def internal_edges(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(community_id, rel_id, ...): relations with both ends in a community."""
    a = members.select("community_id", F.col("node").alias("from_entity"))
    b = members.select("community_id", F.col("node").alias("to_entity"))
    return relations.join(a, "from_entity").join(b, ["community_id", "to_entity"])


def community_context(members: DataFrame, relations: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """(community_id, n_edges, tokens, too_long, context) with the lines of a community's edges by rel_id."""
    inside = internal_edges(members, relations).select("community_id", "rel_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), "line")
    bare = members.select("community_id", F.lit(None).cast(inside.schema["rel_id"].dataType).alias("first"), F.lit(-1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("text")).distinct()
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("first", "place", "text")))), lambda x: x["text"])
    n, total = F.sum("rows"), F.sum("tokens")
    # the text is made by the aggregation itself and is not joined to anything, because it may take a good part of a task's memory
    context = F.when(n == 0, F.lit(NO_EDGES)).when(F.count("text") == 0, F.lit("- ")).otherwise(F.concat_ws("\n", texts))
    return _pieces(inside).unionByName(bare).groupBy("community_id").agg(n.alias("n_edges"), total.alias("tokens"), (total > most).alias("too_long"), context.alias("context"))


def _pieces(inside: DataFrame) -> DataFrame:
    """(community_id, first, place, rows, tokens, text): the lines of each community by rel_id, in pieces of about ``PIECE`` characters.

    Rows are range-partitioned and stream past sorted, so no task holds a community's
    lines one by one. Pieces are in the order of their first rel_id and their place; the
    text is null where all lines are.
    """
    spread = inside.repartitionByRange("community_id", "rel_id").sortWithinPartitions("community_id", "rel_id", "line")
    fields = f"community_id {inside.schema['community_id'].dataType.simpleString()}, first {inside.schema['rel_id'].dataType.simpleString()}, place bigint, rows bigint, tokens bigint, text string"
    schema = to_arrow_schema(inside.sparkSession.createDataFrame([], fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, size = None, 0, 0
        lines: list[str] = []
        done = lambda: (*held, "\n".join(lines) if lines else None)
        for batch in batches:
            out = []
            for community, rel, tokens, line in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or community != held[0] or size > PIECE:
                    if held is not None:
                        out.append(done())
                    held, lines, size, place = [community, rel, place, 0, 0], [], 0, place + 1
                held[3] += 1
                held[4] += tokens
                if line is not None:
                    lines.append(f"- {line}")
                    size += len(line)
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), schema.types)] if out else [pa.array([], f) for f in schema.types], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f) for x, f in zip(done(), schema.types)], schema=schema)

    return spread.mapInArrow(run, fields)
