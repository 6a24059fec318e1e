"""Queries of the entity graph: construction, resolution, traversal and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import similarity as sim
from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.operators import chunking, embedding, graph, pairs, search, tables
from tessellon.operators.components import connected_components
from tessellon.plans import inputs
from tessellon.plans.inputs import cte
from tessellon.session import table
from tessellon.sources import files, generators


def _triplet_text(spark: SparkSession, sf: str) -> DataFrame:
    """A line of four parts for each part, one of three, and one with an empty part."""
    name, brand = F.col("p_name"), F.col("p_brand")
    good = F.concat_ws(" | ", name, brand, F.concat(F.lit("Made by "), brand), F.lit("Maker"))
    return table(spark, sf, "part").select("p_partkey", F.concat(good, F.lit("\n\n"), F.concat_ws("|", name, brand, F.lit("short")), F.lit("\r\n"), F.concat_ws("|", name, F.lit(" "), F.lit("a"), F.lit("b"))).alias("content"))


def triplet_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _triplet_text(spark, sf).select("p_partkey", F.explode(tx.triplets(F.col("content"))).alias("t"))
    return rows.select("p_partkey", "t.source", "t.target", "t.description", "t.summary")


def entities_from_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entities_of(triplet_parse(spark, sf))


def relations_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of parts and brands whose target is a known entity: brands of the first kind are not."""
    rows = triplet_parse(spark, sf)
    names = graph.entities_of(rows).where("entity_name <> 'brand#11'")
    known = tables.numbered(names, ["entity_name"], "entity_id")
    return graph.resolved_relations(rows, known).select("p_partkey", "from_entity", "to_entity")


def entity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), F.lower("n_name").alias("entity_name"))
    new = table(spark, sf, "part").select(F.lower("p_name").alias("entity_name")).unionByName(known.select("entity_name"))
    return tables.upsert_names(known, new)


def entity_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Links added where they are not there yet."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("document_id"))
    return tables.insert_ignore(rows.where("document_id % 2 = 0").distinct(), rows, ["entity_id", "document_id"])


def update_values(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return tables.updated(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), new, ["c_custkey"])


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left in each table once the customers in debt are gone with their orders."""
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    owned = {"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))}
    left = tables.cascade_delete(gone, owned, "key")
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in left.items()]
    return counts[0].unionByName(counts[1])


def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return tables.missing(docs, table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def _part_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("bigint").alias("id"))


def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.trigram_pairs(_part_names(spark, sf), 0.2).select("u", "v", F.round("sim", 9).alias("sim"))


def combined_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine and trigram scores of similar vectors, named by parts."""
    names = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"))
    out = pairs.scored_pairs(inputs.similar_pairs(spark, sf), names, "sim")
    return out.select("u", "v", F.round("trigram", 9).alias("trigram"), F.round("combined", 6).alias("combined"))


def allpairs_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.all_pairs(table(spark, sf, "embeddings"), inputs.LEAST_SIMILARITY).select("u", "v", F.round("sim", 6).alias("sim"))


def allpairs_top(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose larger id is among the four vectors nearest to the smaller, itself included."""
    out = pairs.all_pairs(table(spark, sf, "embeddings"), inputs.LEAST_SIMILARITY, top_k=4)
    return out.select("u", "v", F.round("sim", 6).alias("sim"))


def allpairs_lsh(spark: SparkSession, sf: str) -> DataFrame:
    out = pairs.all_pairs_hashed(table(spark, sf, "embeddings"), inputs.LEAST_SIMILARITY)
    return out.select("u", "v", F.round("sim", 6).alias("sim"))


#: Names of all the kinds that may or may not be merged.
NAMES = (
    "2023", "12345", "3.14", "16:9", "$10 million", "5.2 billion", "25 percent", "10.5%", "3 hrs", "10 min", "12 oz", "5 gal", "5k", "2 b", "3 bears", "january 2022 report", "May 2022", "march 5, 2020", "01/15/2023", "1-2-99",
    "10km", "150 mg", "7 seas", "april", "june", "may", "jan", "barack obama", "route 66", "$ sign", "  7  ", "6 ft", "ft 6", "December",
)


def nonmergeable_filter(spark: SparkSession, sf: str) -> DataFrame:
    dates = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("name"))
    money = table(spark, sf, "part").select(F.concat(F.lit("$"), F.col("p_size")).alias("name"))
    every = dates.unionByName(money).unionByName(_part_names(spark, sf).select("name")).unionByName(table(spark, sf, "part").select(F.concat(F.col("p_size"), F.lit(" km")).alias("name")))
    every = every.unionByName(spark.createDataFrame([(n,) for n in NAMES], "name string")).distinct()
    return every.select("name", tx.mergeable(F.col("name")).alias("mergeable"))


def mergeable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar vectors whose names may be merged; sizes of parts stand for names of even ids."""
    p = F.col("p_partkey")
    names = table(spark, sf, "part").select(p.cast("bigint").alias("entity_id"), F.when(p % 2 == 0, F.concat(F.col("p_size"), F.lit("%"))).otherwise(F.col("p_name")).alias("entity_name"))
    return graph.mergeable_pairs(inputs.similar_pairs(spark, sf), names).select("u", "v")


def components(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.stored(spark, sf, "components", lambda: connected_components(inputs.similar_pairs(spark, sf), "u", "v"))


def entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of entities with text ids whose names may be merged."""
    groups, _ = graph.entity_groups(inputs.named_pairs(spark, sf), inputs.LEAST_SIMILARITY, inputs.entity_names(spark, sf))
    return groups.select("component", "size", "representative", F.round("confidence", 6).alias("confidence"))


def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    groups, _ = graph.entity_groups(inputs.named_pairs(spark, sf), inputs.LEAST_SIMILARITY, inputs.entity_names(spark, sf))
    out = graph.group_summary(groups)
    return out.select("groups", "members", "largest", "smallest", *(F.round(c, 6).alias(c) for c in ("mean_size", "mean_confidence", "highest", "lowest")))


def indel_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups divided by the likeness of their names."""
    _, members = graph.entity_groups(inputs.named_pairs(spark, sf), inputs.LEAST_SIMILARITY)
    return graph.refined_groups(members, inputs.entity_names(spark, sf))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Entity resolution with a decision that turns groups of more than three names down and calls the others by the last of their names."""
    answer = lambda n: F.when(F.size(n) > 3, "Decision: NO").otherwise(F.concat(F.lit("Decision: YES\nResolved Name: "), F.array_max(n), F.lit("\nConfidence: "), F.when(F.size(n) == 2, "high").otherwise("medium")))
    return inputs.stored(spark, sf, "resolved", lambda: graph.resolved_entities(inputs.named_pairs(spark, sf), inputs.entity_names(spark, sf), answer, inputs.LEAST_SIMILARITY))


def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    out = _resolved(spark, sf)
    return out.select("node", "representative", F.round("confidence", 6).alias("confidence"), "resolved_name", "label")


def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.decision_counts(_resolved(spark, sf))


def resolved_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities once their merges are applied."""
    return graph.merged_entities(inputs.entity_names(spark, sf), _resolved(spark, sf))


def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Which orders entities occur in once their merges are applied."""
    links = table(spark, sf, "lineitem").select(F.concat(F.lit("e"), F.col("l_partkey")).alias("entity_id"), F.col("l_orderkey").alias("document_id"))
    return graph.merged_links(links, _resolved(spark, sf), "entity_id", "document_id")


def indel_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """String similarity of the names that share enough trigrams."""
    names = _part_names(spark, sf)
    out = pairs.scored_pairs(pairs.trigram_pairs(names, 0.2), names, "sim")
    return out.select("u", "v", F.round(sim.indel(F.col("u_name"), F.col("v_name")), 6).alias("indel"))


def sequence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The other string similarity of the same names."""
    names = _part_names(spark, sf)
    out = pairs.scored_pairs(pairs.trigram_pairs(names, 0.2), names, "sim")
    return out.select("u", "v", F.round(sim.sequence_match(F.col("u_name"), F.col("v_name")), 6).alias("matcher"))


def batch_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of entities against all others, by vector and by the trigrams of their names without stop words."""
    names = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    batch = e.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    out = pairs.batch_pairs(e.join(names, "id"), batch, 0.25, 0.05, ("almond", "antique"))
    return out.select("source", "target", F.round("semantic", 6).alias("semantic"), F.round("lexical", 9).alias("lexical"), F.round("combined", 6).alias("combined"))


def apply_merges(spark: SparkSession, sf: str) -> DataFrame:
    rel = inputs.pair_relations(spark, sf).unionByName(_order_relations(spark, sf)).withColumn("weight", (F.col("rel_id") % 7).cast("int"))
    merges = components(spark, sf).select("node", F.col("component").alias("representative"))
    return graph.apply_merges(rel, merges).select("from_entity", "to_entity", "rel_id", "weight", "tokens", "line")


def _extraction(content):  # noqa: ANN001, ANN202
    """A stand-in for a model: the first words of a chunk as a triplet line, and a line that is none."""
    t = tx.tokens(F.regexp_replace(content, r"\|", " "))
    return F.concat(F.get(t, F.lit(0)), F.lit(" | "), F.get(t, F.lit(1)), F.lit(" | "), F.concat_ws(" ", F.get(t, F.lit(2)), F.get(t, F.lit(3))), F.lit("|"), F.get(t, F.lit(4)), F.lit("\n"), F.get(t, F.lit(0)), F.lit("|short"))


def _built(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = inputs.chunks(spark, sf).select((F.col("doc_id") * 1000 + F.col("chunk_no")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "content")
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), F.lower("n_name").alias("entity_name"))
    return graph.built_graph(rows, _extraction, known)


def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of a graph built from all chunks."""
    return _built(spark, sf)["relations"]


def graph_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Its entities, with the chunks and documents each occurs in."""
    made = _built(spark, sf)
    n = lambda t, c: made[t].groupBy("entity_id").agg(F.count(F.lit(1)).alias(c))
    out = made["entities"].join(n("entity_chunks", "chunks"), "entity_id", "left").join(n("entity_documents", "documents"), "entity_id", "left")
    return out.select("entity_id", "entity_name", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("documents", F.lit(0)).alias("documents"))


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    made = _built(spark, sf)
    return graph.graph_counts(made["entities"], made["relations"])


def graph_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The context of one question: entities near two that it names, walks that grow until the context is close enough."""
    e = table(spark, sf, "embeddings")
    named = e.where("vec_id IN (1, 2)").select(F.col("vec_id").alias("query_id"), "embedding")
    seeds = search.nearest_union(search.semantic_search(e, named, 5)).select(F.col("vec_id").alias("node"))
    a, b = F.col("from_entity"), F.col("to_entity")
    rel = _order_relations(spark, sf).select("rel_id", a, b, (1 + (a + b) % 7).cast("int").alias("tokens"), ((a * 7 + b) % 500).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id")
    enough = lambda context: (context.agg(F.avg("similarity")).first()[0] or 0) >= 0.3
    out = graph.graph_retrieval(rel, seeds, inputs.vector_of(spark, sf, 0), 200, enough)
    return out.select("rel_id", "rank", "running_tokens", F.round("similarity", 6).alias("similarity"), "depth")


def relations_inserted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows added to a table as they are, repeats included."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_entity"), F.col("l_partkey").alias("to_entity"))
    return tables.inserted(rows, rows).groupBy("from_entity", "to_entity").agg(F.count(F.lit(1)).alias("rows"))


def rows_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return tables.delete_where(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 100000).select("o_orderkey")


def edge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Relations as lines of text, some without a description."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", tx.edge_line(F.col("p_name"), F.col("p_brand"), F.when(p % 3 > 0, F.col("p_type"))).alias("line"))


def document_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct documents over two data sets, counted for each."""
    d = table(spark, sf, "documents").select(F.col("text").alias("document"), F.col("doc_id").alias("item_id"))
    _, counts = files.document_mapping({"even": d.where("item_id % 2 = 0"), "all": d})
    return counts


def _order_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Which part an order's supplier delivers, as relations between numbered nodes."""
    s, p = F.col("l_suppkey").cast("bigint"), F.col("l_partkey").cast("bigint")
    rows = table(spark, sf, "lineitem").select(s.alias("from_entity"), p.alias("to_entity")).distinct()
    return rows.select((F.lit(10**15) + F.col("from_entity") * 10_000_000 + F.col("to_entity")).alias("rel_id"), "from_entity", "to_entity", F.lit(3).alias("tokens"), F.lit("x").alias("line"))


def simple_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    rel = _order_relations(spark, sf).withColumn("weight", F.when(F.col("to_entity") % 5 > 0, (F.col("rel_id") % 7).cast("int")))
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"))
    return graph.simple_graph(rel, nodes)


def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that have a similar one."""
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"))
    return graph.connected_nodes(nodes, inputs.similar_pairs(spark, sf))


def rel_weight_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rel = inputs.pair_relations(spark, sf).select("rel_id", "from_entity", "to_entity", F.lit(None).cast("int").alias("weight"))
    out = graph.relation_weights(rel, table(spark, sf, "embeddings"), "vec_id")
    return out.select("rel_id", "weight")


def edge_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the vectors at both ends of the relations that have them."""
    e = table(spark, sf, "embeddings")
    out = pairs.with_cosines(_order_relations(spark, sf).select("rel_id", "from_entity", "to_entity"), e, "similarity", id_col="vec_id", inner=True)
    return out.select("rel_id", F.round("similarity", 6).alias("similarity"))


def khop_edges(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("s1",)], "node string")
    return graph.khop_edges(inputs.supply_relations(spark, sf), seeds, 3)


def leiden_communities(spark: SparkSession, sf: str) -> DataFrame:
    edges = inputs.similar_pairs(spark, sf).select("u", "v", F.col("sim").alias("weight"))
    return graph.communities(edges)


def community_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    groups, _ = graph.community_tables(leiden_communities(spark, sf))
    return groups


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return components(spark, sf).select(F.col("component").alias("community_id"), "node")


def community_internal_edges(spark: SparkSession, sf: str) -> DataFrame:
    rel = inputs.pair_relations(spark, sf).unionByName(_order_relations(spark, sf))
    return graph.internal_edges(_members(spark, sf), rel).select("community_id", "rel_id")


def community_context(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.community_context(_members(spark, sf), inputs.pair_relations(spark, sf), 60)
    return out.select("community_id", "n_edges", "tokens", "too_long", "context")


def community_documents(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("document_id"))
    return graph.community_links(_members(spark, sf), links, "document_id")


def community_chunks(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))
    return graph.community_links(_members(spark, sf), links, "chunk_id")


def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(table(spark, sf, "documents"), "recursive", 80, 20)


def cluster_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(table(spark, sf, "documents"), "cluster", 400)


def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(table(spark, sf, "documents"), "semantic", 400)


def positioned_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(table(spark, sf, "documents"), "token", 40, 10)


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", embedding.embed(F.col("text")).alias("embedding"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    run = F.pandas_udf(lambda parts: parts.map(files.html_to_text, na_action="ignore"), "string")
    return table(spark, sf, "pages").select("page_id", run("html").alias("content"))


def synthetic_entities(spark: SparkSession, sf: str) -> DataFrame:
    return generators.synthetic_entities(spark, 10_000)


def _gram_sql(name: str) -> str:
    words = rf"regexp_extract_all(lower({name}), '[\p{{L}}\p{{N}}]+')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_PARTS = rf"""t AS (SELECT p_partkey, p_name AS n, p_brand AS b FROM part),
tri AS (SELECT p_partkey, lower(trim(n)) AS source, lower(trim(b)) AS target, lower('Made by ' || b) AS description, 'maker' AS summary FROM t),
names AS (SELECT p_name AS name, min(p_partkey)::BIGINT AS id, {_gram_sql('p_name')} AS g FROM part GROUP BY p_name)"""
_TRIG = "len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"
_ORDER_REL = "SELECT DISTINCT 1000000000000000 + l_suppkey::BIGINT * 10000000 + l_partkey AS rel_id, l_suppkey::BIGINT AS from_entity, l_partkey::BIGINT AS to_entity FROM lineitem"
# what must not be merged, told in the order of kinds: blank, month dates, digit dates, numbers, amounts, shares, ratios, measures
_PLAIN = "regexp_replace(lower(name), '^\\s+|\\s+$', '', 'g')"
_MERGEABLE = f"""coalesce({_PLAIN} <> ''
 AND NOT regexp_matches({_PLAIN}, '^(january|february|march|april|may|june|july|august|september|october|november|december)\\s+([0-9]{{4}}|[0-9]{{1,2}})')
 AND NOT regexp_matches({_PLAIN}, '^[0-9]{{1,2}}([/-])[0-9]{{1,2}}[/-][0-9]{{2,4}}')
 AND NOT regexp_full_match({_PLAIN}, '[0-9]+([.:][0-9]+)?')
 AND NOT regexp_matches({_PLAIN}, '^[$]?[0-9]+([.][0-9]+)?\\s*[mbtk]')
 AND NOT regexp_matches({_PLAIN}, '^[$]?[0-9]+([.][0-9]+)?\\s*(million|billion|trillion|thousand)')
 AND NOT regexp_matches({_PLAIN}, '^[0-9]+([.][0-9]+)?(\\s*percent|%)')
 AND NOT regexp_full_match({_PLAIN}, '[0-9]+([.][0-9]+)?\\s*(km|cm|mm|mi|ft|in|kg|g|mg|lb|oz|l|ml|gal|hr|hrs|min|sec|m)'), false)"""
_LCS = "list_last(list_reduce(string_split({0}, ''), lambda r, c: list_reduce(range(1, length({1}) + 1), lambda k, j: list_append(k, greatest(k[j], r[j + 1], r[j] + CASE WHEN substr({1}, j::INT, 1) = c THEN 1 ELSE 0 END)), [0::BIGINT]), list_transform(range(length({1}) + 1), lambda z: 0::BIGINT)))"
_INDEL = "200.0::DOUBLE * " + _LCS + " / (length({0}) + length({1}))"
_ENTITIES = "en AS (SELECT 'e' || p_partkey AS entity_id, CASE WHEN p_partkey % 7 = 0 THEN p_size || ' percent' ELSE p_name END AS entity_name FROM part), ok AS (SELECT entity_id, entity_name FROM (SELECT *, entity_name AS name FROM en) WHERE {0})"
_NAMED = "np AS MATERIALIZED (SELECT least('e' || u, 'e' || v) AS u, greatest('e' || u, 'e' || v) AS v, sim FROM sp)"


def _groups(pairs_from: str, p: str) -> str:
    """Components and their groups over text ids: tables named by a prefix."""
    return f"""{p}p AS MATERIALIZED ({pairs_from}), {p}b AS (SELECT u AS a, v AS b FROM {p}p UNION ALL SELECT v, u FROM {p}p),
 {p}r AS (SELECT DISTINCT a AS node, a AS r FROM {p}b UNION SELECT {p}r.node, {p}b.b FROM {p}r JOIN {p}b ON {p}r.r = {p}b.a), {p}c AS MATERIALIZED (SELECT node, min(r) AS component FROM {p}r GROUP BY node),
 {p}d AS (SELECT component, node, count(*) AS k FROM {p}c JOIN {p}b ON a = node GROUP BY ALL), {p}s AS (SELECT component, avg(sim) AS x FROM {p}p JOIN {p}c ON u = node GROUP BY 1),
 {p}g AS MATERIALIZED (SELECT component, count(*) AS size, arg_min(node, (-k, node)) AS representative, max(x) AS confidence FROM {p}d JOIN {p}s USING (component) GROUP BY component)"""


def _refined(p: str) -> str:
    """Groups divided by their names, as {p}f (component, node, subgroup)."""
    return f"""{p}m AS MATERIALIZED (SELECT c.component, c.node, lower(entity_name) AS name FROM {p}c c JOIN ok ON entity_id = node WHERE component IN (SELECT component FROM {p}c GROUP BY 1 HAVING count(*) > 2)),
 {p}l AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM {p}m x JOIN {p}m y ON x.component = y.component AND x.node <> y.node WHERE x.name = y.name OR {_INDEL.format('x.name', 'y.name')} >= 90),
 {p}q AS (SELECT DISTINCT a AS node, a AS r FROM {p}l UNION SELECT {p}q.node, {p}l.b FROM {p}q JOIN {p}l ON {p}q.r = {p}l.a), {p}t AS MATERIALIZED (SELECT node, min(r) AS part FROM {p}q GROUP BY node),
 {p}n AS (SELECT component FROM {p}t JOIN {p}c USING (node) GROUP BY 1 HAVING count(DISTINCT part) > 1),
 {p}f AS MATERIALIZED (SELECT component, node, part AS subgroup FROM {p}t JOIN {p}c USING (node) WHERE component IN (SELECT component FROM {p}n)
  UNION ALL SELECT component, node, min(node) OVER (PARTITION BY component) FROM {p}c WHERE component NOT IN (SELECT component FROM {p}n))"""


_OK_PAIRS = "SELECT * FROM np WHERE u IN (SELECT entity_id FROM ok) AND v IN (SELECT entity_id FROM ok)"
_RESOLVED = (
    cte("sp").rstrip()
    + f""", {_ENTITIES.format(_MERGEABLE)}, {_NAMED}, {_groups(_OK_PAIRS, 'g')}, {_refined('g')},
 w AS (SELECT f.subgroup, f.node, g.confidence, CASE WHEN f.component IN (SELECT component FROM gn) THEN f.subgroup ELSE g.representative END AS representative, entity_name FROM gf f JOIN gg g USING (component) JOIN en ON entity_id = node),
 z AS (SELECT *, count(*) OVER (PARTITION BY subgroup) AS n, max(encode(entity_name)) OVER (PARTITION BY subgroup) AS longest FROM w),
 merged AS MATERIALIZED (SELECT node, CASE WHEN n > 3 THEN node ELSE representative END AS representative, CASE WHEN n > 3 THEN 0.0::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN n <= 3 THEN decode(longest) END AS resolved_name, CASE WHEN n = 2 THEN 'HIGH' WHEN n = 3 THEN 'MEDIUM' END AS label FROM z)
 """
)
_TRIPLES = r""", w AS (SELECT doc_id * 1000 + chunk_no AS chunk_id, doc_id AS document_id, regexp_extract_all(replace(content, '|', ' '), '[^ \t\n\r\f\x0B]+') AS t FROM ch),
 x AS MATERIALIZED (SELECT chunk_id, document_id, lower(t[1]) AS source, lower(t[2]) AS target, lower(t[3] || ' ' || t[4]) AS description, lower(t[5]) AS summary FROM w WHERE len(t) >= 5),
 kn AS (SELECT n_nationkey::BIGINT AS entity_id, lower(n_name) AS entity_name FROM nation), nw AS (SELECT source AS entity_name FROM x UNION SELECT target FROM x),
 en AS MATERIALIZED (SELECT * FROM kn UNION ALL SELECT (SELECT max(entity_id) FROM kn) + row_number() OVER (ORDER BY encode(entity_name)), entity_name FROM nw WHERE entity_name NOT IN (SELECT entity_name FROM kn))
 """

SQL = {
    "triplet_parse": f"WITH {_PARTS} SELECT p_partkey, source, target, description, summary FROM tri",
    "entities_from_relations": f"WITH {_PARTS} SELECT source AS entity_name FROM tri UNION SELECT target FROM tri",
    "relations_resolved": f"WITH {_PARTS}, n AS (SELECT entity_name, row_number() OVER (ORDER BY encode(entity_name)) AS id FROM (SELECT source AS entity_name FROM tri UNION SELECT target FROM tri) WHERE entity_name <> 'brand#11') SELECT p_partkey, a.id AS from_entity, b.id AS to_entity FROM tri JOIN n a ON a.entity_name = source JOIN n b ON b.entity_name = target",
    "entity_upsert": "WITH n AS (SELECT n_nationkey::BIGINT AS entity_id, lower(n_name) AS entity_name FROM nation), f AS (SELECT DISTINCT lower(p_name) AS entity_name FROM part WHERE lower(p_name) NOT IN (SELECT entity_name FROM n)) SELECT * FROM n UNION ALL SELECT (SELECT max(entity_id) FROM n) + row_number() OVER (ORDER BY encode(entity_name)), entity_name FROM f",
    "entity_documents": "SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS document_id FROM lineitem",
    "update_values": "SELECT c_custkey, greatest(c_acctbal::DOUBLE, 0) AS c_acctbal FROM customer",
    "cascade_delete": "SELECT 'customer' AS name, count(*) AS rows FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "missing_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "trigram_similarity": f"WITH {_PARTS} SELECT a.id AS u, b.id AS v, round({_TRIG}, 9) AS sim FROM names a JOIN names b ON a.id < b.id WHERE {_TRIG} >= 0.2",
    "combined_similarity": cte("sp") + f", names AS (SELECT p_partkey::BIGINT AS id, {_gram_sql('p_name')} AS g FROM part) SELECT u, v, round({_TRIG}, 9) AS trigram, round(0.7 * sim + 0.3 * {_TRIG}, 6) AS combined FROM sp JOIN names a ON a.id = u JOIN names b ON b.id = v",
    "allpairs_similarity": cte("sp") + "SELECT u, v, round(sim, 6) AS sim FROM sp",
    "allpairs_top": cte("e") + ", r AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY CASE WHEN a.vec_id = b.vec_id THEN 2 ELSE list_cosine_similarity(a.v, b.v) END DESC, b.vec_id) AS n FROM e a, e b) SELECT u, v, round(sim, 6) AS sim FROM r WHERE n <= 4 AND u < v AND r.sim >= 0.35",
    "nonmergeable_filter": f"SELECT name, {_MERGEABLE} AS mergeable FROM (SELECT o_orderdate::VARCHAR AS name FROM orders UNION SELECT '$' || p_size FROM part UNION SELECT p_name FROM part UNION SELECT p_size || ' km' FROM part UNION SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]))",
    "mergeable_pairs": cte("sp") + f", n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size || '%' ELSE p_name END AS name FROM part), ok AS (SELECT id FROM n WHERE {_MERGEABLE}) SELECT u, v FROM sp WHERE u IN (SELECT id FROM ok) AND v IN (SELECT id FROM ok)",
    "indel_ratio": f"WITH {_PARTS} SELECT a.id AS u, b.id AS v, round({_INDEL.format('a.name', 'b.name')}, 6) AS indel FROM names a JOIN names b ON a.id < b.id WHERE {_TRIG} >= 0.2",
    "batch_similarity": cte("e") + f""", n AS (SELECT p_partkey AS vec_id, list_distinct(flatten(list_transform(list_filter(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ('almond', 'antique')), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part), a AS (SELECT vec_id, v, g FROM e JOIN n USING (vec_id)),
 s AS (SELECT x.vec_id AS source, y.vec_id AS target, list_cosine_similarity(x.v, y.v) AS semantic, CASE WHEN len(x.g) + len(y.g) = 0 THEN 0 ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) END AS lexical FROM a x JOIN a y ON x.vec_id % 10 = 0 AND x.vec_id <> y.vec_id)
 SELECT source, target, round(s.semantic, 6) AS semantic, round(s.lexical, 9) AS lexical, round(0.7 * s.semantic + 0.3 * s.lexical, 6) AS combined FROM s WHERE s.semantic >= 0.25 AND s.lexical >= 0.05""",
    "components": cte("comp") + "SELECT node, component FROM comp",
    "entity_groups": cte("sp") + f", {_ENTITIES.format(_MERGEABLE)}, {_NAMED}, {_groups(_OK_PAIRS, 'g')} SELECT component, size, representative, round(confidence, 6) AS confidence FROM gg",
    "group_summary": cte("sp") + f", {_ENTITIES.format(_MERGEABLE)}, {_NAMED}, {_groups(_OK_PAIRS, 'g')} SELECT count(*) AS groups, sum(size)::BIGINT AS members, max(size) AS largest, min(size) AS smallest, round(avg(size), 6) AS mean_size, round(avg(confidence), 6) AS mean_confidence, round(max(confidence), 6) AS highest, round(min(confidence), 6) AS lowest FROM gg",
    "indel_groups": cte("sp") + f", {_ENTITIES.format(_MERGEABLE)}, {_NAMED}, {_groups('SELECT * FROM np', 'g')}, {_refined('g')} SELECT component, node, subgroup FROM gf",
    "entity_resolution": _RESOLVED + "SELECT node, representative, round(confidence, 6) AS confidence, resolved_name, label FROM merged",
    "decision_counts": _RESOLVED + "SELECT label, count(DISTINCT representative) AS groups FROM merged WHERE label IS NOT NULL GROUP BY label",
    "resolved_entities": _RESOLVED + "SELECT entity_id, coalesce(resolved_name, entity_name) AS entity_name FROM en LEFT JOIN merged ON node = entity_id WHERE representative IS NULL OR representative = entity_id",
    "resolved_links": _RESOLVED + "SELECT DISTINCT coalesce(representative, 'e' || l_partkey) AS entity_id, l_orderkey AS document_id FROM lineitem LEFT JOIN merged ON node = 'e' || l_partkey",
    "apply_merges": cte("comp", "prel") + f", r AS (SELECT rel_id, from_entity, to_entity, tokens, line FROM prel UNION ALL SELECT *, 3, 'x' FROM ({_ORDER_REL})), m AS (SELECT coalesce(a.component, from_entity) AS from_entity, coalesce(b.component, to_entity) AS to_entity, rel_id, tokens, line FROM r LEFT JOIN comp a ON a.node = from_entity LEFT JOIN comp b ON b.node = to_entity) SELECT from_entity, to_entity, min(m.rel_id) AS rel_id, max(m.rel_id % 7)::INT AS weight, arg_min(tokens, m.rel_id) AS tokens, arg_min(line, m.rel_id) AS line FROM m WHERE from_entity <> to_entity GROUP BY 1, 2",
    "graph_build": cte("ch") + _TRIPLES + "SELECT a.entity_id AS from_entity, b.entity_id AS to_entity, description, summary, chunk_id, document_id FROM x JOIN en a ON a.entity_name = source JOIN en b ON b.entity_name = target",
    "graph_entities": cte("ch") + _TRIPLES + ", o AS (SELECT source AS entity_name, chunk_id, document_id FROM x UNION SELECT target, chunk_id, document_id FROM x) SELECT entity_id, entity_name, count(DISTINCT chunk_id) AS chunks, count(DISTINCT document_id) AS documents FROM en LEFT JOIN o USING (entity_name) GROUP BY 1, 2",
    "graph_counts": cte("ch") + _TRIPLES + "SELECT (SELECT count(*) FROM en) AS nodes, (SELECT count(*) FROM x) AS edges",
    "graph_retrieval": cte("e") + f""", r AS MATERIALIZED (SELECT rel_id, from_entity, to_entity, (1 + (from_entity + to_entity) % 7)::INT AS tokens, list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)) AS similarity FROM ({_ORDER_REL}) JOIN e ON vec_id = (from_entity * 7 + to_entity) % 500),
 b AS (SELECT from_entity AS a, to_entity AS c FROM r UNION SELECT to_entity, from_entity FROM r),
 seeds AS (SELECT DISTINCT vec_id FROM (SELECT c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS n FROM e q, e c WHERE q.vec_id IN (1, 2)) WHERE n <= 5),
 n0 AS (SELECT vec_id AS n FROM seeds), n1 AS (SELECT n FROM n0 UNION SELECT c FROM b JOIN n0 ON n = a), n2 AS (SELECT n FROM n1 UNION SELECT c FROM b JOIN n1 ON n = a), n3 AS (SELECT n FROM n2 UNION SELECT c FROM b JOIN n2 ON n = a),
 d AS (SELECT 1 AS depth, n FROM n0 UNION ALL SELECT 2, n FROM n1 UNION ALL SELECT 3, n FROM n2 UNION ALL SELECT 4, n FROM n3),
 f AS (SELECT DISTINCT depth, rel_id, tokens, similarity FROM r JOIN d ON n = from_entity UNION SELECT DISTINCT depth, rel_id, tokens, similarity FROM r JOIN d ON n = to_entity),
 k AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY similarity DESC, rel_id)::INT AS rank FROM f),
 t AS MATERIALIZED (SELECT *, sum(tokens) OVER (PARTITION BY depth ORDER BY rank)::BIGINT AS running_tokens FROM k QUALIFY running_tokens <= 200),
 s AS (SELECT coalesce(min(depth) FILTER (a >= 0.3), 4) AS depth FROM (SELECT depth, avg(similarity) AS a FROM t GROUP BY depth))
 SELECT rel_id, rank, running_tokens, round(t.similarity, 6) AS similarity, t.depth::INT AS depth FROM t JOIN s USING (depth)""",
    "relations_inserted": "SELECT l_suppkey AS from_entity, l_partkey AS to_entity, 2 * count(*) AS rows FROM lineitem GROUP BY 1, 2",
    "rows_deleted": "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)",
    "edge_lines": "SELECT p_partkey, p_name || ' -> ' || p_brand || ': ' || CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'No description' END AS line FROM part",
    "document_mapping": "SELECT dataset, count(*) AS documents FROM (SELECT CASE WHEN bool_or(doc_id % 2 = 0) THEN 'even' ELSE 'all' END AS dataset FROM documents GROUP BY text) GROUP BY 1",
    "simple_graph_edges": f"WITH r AS ({_ORDER_REL}) SELECT least(from_entity, to_entity) AS u, greatest(from_entity, to_entity) AS v, arg_max(CASE WHEN to_entity % 5 > 0 THEN rel_id % 7 ELSE 1 END, rel_id)::INT AS weight FROM r WHERE from_entity IN (SELECT vec_id FROM embeddings) AND to_entity IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2",
    "isolated_nodes": cte("spb") + "SELECT DISTINCT a AS entity_id FROM spb",
    "rel_weight_bucket": cte("sp") + "SELECT u * 10000000 + v AS rel_id, (1 + floor(9 * sim))::INT AS weight FROM sp",
    "edge_similarity": cte("e") + f", r AS ({_ORDER_REL}) SELECT rel_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM r JOIN e a ON a.vec_id = from_entity JOIN e b ON b.vec_id = to_entity",
    "khop_edges": cte("rel") + ", b AS (SELECT from_entity AS a, to_entity AS c FROM rel UNION ALL SELECT to_entity, from_entity FROM rel), walk AS (SELECT 's1' AS n, 0 AS d UNION SELECT c, d + 1 FROM walk JOIN b ON a = n WHERE d < 2) SELECT rel_id FROM rel WHERE from_entity IN (SELECT n FROM walk) OR to_entity IN (SELECT n FROM walk)",
    "community_internal_edges": cte("comp", "prel") + f", r AS (SELECT rel_id, from_entity, to_entity FROM prel UNION ALL {_ORDER_REL}) SELECT a.component AS community_id, rel_id FROM r JOIN comp a ON a.node = from_entity JOIN comp b ON b.node = to_entity AND a.component = b.component",
    "community_context": cte("comp", "prel") + "SELECT component AS community_id, count(*) AS n_edges, sum(tokens)::BIGINT AS tokens, sum(tokens) > 60 AS too_long, '- ' || string_agg(line, chr(10) || '- ' ORDER BY rel_id) AS context FROM prel JOIN comp ON node = from_entity GROUP BY 1",
    "community_documents": cte("comp") + "SELECT DISTINCT component AS community_id, l_orderkey AS document_id FROM comp JOIN lineitem ON l_partkey = node",
    "community_chunks": cte("comp") + "SELECT DISTINCT component AS community_id, l_orderkey * 10 + l_linenumber AS chunk_id FROM comp JOIN lineitem ON l_partkey = node",
}

QUERIES = [
    triplet_parse, entities_from_relations, relations_resolved, relations_inserted, entity_upsert, entity_documents, update_values, rows_deleted, cascade_delete, missing_ids, document_mapping, graph_build, graph_entities, graph_counts, edge_lines,
    trigram_similarity, combined_similarity, batch_similarity, allpairs_similarity, allpairs_top, allpairs_lsh, nonmergeable_filter, mergeable_pairs, components, entity_groups, group_summary, indel_groups, indel_ratio, sequence_ratio,
    entity_resolution, decision_counts, resolved_entities, resolved_links, apply_merges, simple_graph_edges, isolated_nodes, rel_weight_bucket, edge_similarity, khop_edges, graph_retrieval, leiden_communities, community_hierarchy,
    community_internal_edges, community_context, community_documents, community_chunks, recursive_chunks, cluster_chunks, semantic_chunks, positioned_chunks, embed_hash, html_text, synthetic_entities,
]
