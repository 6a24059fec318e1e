"""Tables that the registered queries share, made from the input tables, and the SQL that makes the same ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.operators import pairs, search
from tessellon.operators.chunking import token_chunks
from tessellon.session import table, written

SIZE, OVERLAP = 40, 10
LEAST_SIMILARITY = 0.35


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, made once for an application and a folder of input tables and kept in the shared folder.

    The input tables must not change meanwhile; ``forget`` makes the next query build anew.
    """
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _STORED:
        _STORED[at], _ = written(make(), f"stored-{name}")
    return _STORED[at]


def forget(*kept: str) -> None:
    """Have all stored tables but those of the names ``kept`` built anew."""
    for at in [x for x in _STORED if x[2] not in kept]:
        del _STORED[at]


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return token_chunks(table(spark, sf, "documents"), SIZE, OVERLAP)


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of vector searches: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf, "documents").join(e, "doc_id").select("doc_id", "text", "lang", "embedding")


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items(spark, sf).join(e, "query_id")


def term_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stored terms of all documents, which every keyword search reads."""
    return stored(spark, sf, "terms", lambda: search.term_index(table(spark, sf, "documents")))


def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "keyword", lambda: search.keyword_search(term_index(spark, sf), search.query_terms(items(spark, sf)), None))


def semantic_hits(spark: SparkSession, sf: str, k: int = 120) -> DataFrame:
    hits = stored(spark, sf, "semantic", lambda: search.semantic_search(document_vectors(spark, sf), item_vectors(spark, sf), 120, "doc_id"))
    return hits.where(F.col("rank") <= k)


def hybrid_hits(spark: SparkSession, sf: str, k: int = 60) -> DataFrame:
    hits = stored(spark, sf, "hybrid", lambda: search.reciprocal_rank_fusion(semantic_hits(spark, sf), keyword_hits(spark, sf), k=60))
    return hits.where(F.col("rank") <= k)


def reranked(spark: SparkSession, sf: str, hits: DataFrame, initial: int, k: int) -> DataFrame:
    """The first ``initial`` hits of each item by the share of its terms that a document holds; documents bring their stored terms along."""
    pool = hits.where(F.col("rank") <= initial).select("query_id", "doc_id", "rank")
    wanted = items(spark, sf).select("query_id", F.array_distinct(tx.terms(F.col("text"))).alias("wanted"))
    both = pool.join(wanted, "query_id").join(term_index(spark, sf).select("doc_id", "found"), "doc_id")
    return search.rerank(both, search.shared_terms, "wanted", "found", k)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id) of documents that hold an item's text. Such a document has all of the item's terms, so it is a keyword hit."""
    hits = keyword_hits(spark, sf).select("query_id", "doc_id").join(items(spark, sf), "query_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    return stored(spark, sf, "truth", lambda: hits.join(docs, "doc_id").where(F.contains("document", "text")).select("query_id", "doc_id"))


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as searches read them: of two kinds, each with one of the vectors."""
    d, n = F.col("doc_id"), F.col("chunk_no")
    rows = chunks(spark, sf).select((d * 1000 + n).alias("chunk_id"), d.alias("document_id"), "content", "tokens", F.when(d % 2 == 0, "token").otherwise("recursive").alias("type"), ((d * 7 + n) % 500).alias("vec_id"))
    return rows.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")


def item_questions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items(spark, sf).join(e, "query_id").select("query_id", "text", "embedding")


def vector_of(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "pairs", lambda: pairs.all_pairs(table(spark, sf, "embeddings"), LEAST_SIMILARITY))


def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    """Named entities with text ids, one for each part; sizes stand for the names of every seventh."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(F.concat(F.lit("e"), p).alias("entity_id"), F.when(p % 7 == 0, F.concat("p_size", F.lit(" percent"))).otherwise(F.col("p_name")).alias("entity_name"))


def named_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of entities with text ids, the smaller first."""
    u, v = (F.concat(F.lit("e"), c) for c in ("u", "v"))
    return similar_pairs(spark, sf).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "sim")


def supply_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Who supplies what, as relations between named nodes."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rows.select((s * 10_000_000 + p).alias("rel_id"), F.concat(F.lit("s"), s).alias("from_entity"), F.concat(F.lit("p"), p).alias("to_entity"), (1 + (s * 7 + p) % 10).cast("int").alias("weight"))


def pair_relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = similar_pairs(spark, sf)
    line = F.concat(F.col("u").cast("string"), F.lit(" -> "), F.col("v").cast("string"), F.lit(": alike"))
    return rows.select((F.col("u") * 10_000_000 + F.col("v")).alias("rel_id"), F.col("u").alias("from_entity"), F.col("v").alias("to_entity"), F.lit(3).alias("tokens"), line.alias("line"))


#: Parts that are costly and read more than once.
HEAVY = {"sp", "post", "sem0", "cover", "dt"}


def cte(*names: str) -> str:
    """WITH clause of the named parts and all that they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = PARTS[name]
        for n in needs:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in HEAVY)}({PARTS[n][1]})" for n in order) + "\n"


TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')"
TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

_RERANK = "SELECT query_id, doc_id, x, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, r0, doc_id)::INT AS rank FROM (SELECT h.query_id, h.doc_id, h.rank AS r0, len(list_intersect(qt.t, dt.t))::DOUBLE / len(qt.t) AS x FROM {0} h JOIN qt USING (query_id) JOIN dt USING (doc_id) WHERE h.rank <= 20) QUALIFY rank <= 10"
_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"

#: name: (parts needed, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": ((), f"SELECT doc_id, {TOKENS} AS t FROM documents"),
    "ch": (("tok",), f"""SELECT doc_id, i::INT AS chunk_no, array_to_string(t[i * 30 + 1 : i * 30 + {SIZE}], ' ') AS content, len(t[i * 30 + 1 : i * 30 + {SIZE}])::INT AS tokens,
      (i * 30)::INT AS start_token, least(i * 30 + {SIZE}, len(t))::INT AS end_token
      FROM (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {SIZE} THEN 1 ELSE (len(t) - {SIZE} + 29) // 30 + 1 END)) AS i FROM tok)"""),
    "e": ((), "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"),
    "items": ((), "SELECT item_id AS query_id, text FROM benchmark"),
    "asked": (("items",), f"SELECT DISTINCT query_id, unnest({TERMS}) AS term FROM items"),
    "post": ((), f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL"),
    "key0": (("asked", "post"), "SELECT query_id, doc_id, need FROM asked JOIN post USING (term) JOIN (SELECT query_id, count(*) AS need FROM asked GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need"),
    "places": (("key0", "asked"), f"SELECT k.query_id, k.doc_id, k.need, d.term, d.p FROM key0 k JOIN (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM (SELECT doc_id, {TERMS} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM key0))) d USING (doc_id) JOIN asked a ON a.query_id = k.query_id AND a.term = d.term"),
    "low": (("places", "asked"), "SELECT query_id, doc_id, need, p, min(last) AS low FROM (SELECT w.query_id, w.doc_id, w.need, w.p, max(CASE WHEN w.term = a.term THEN w.p END) OVER (PARTITION BY w.query_id, w.doc_id, a.term ORDER BY w.p) AS last FROM places w JOIN asked a ON a.query_id = w.query_id) GROUP BY ALL HAVING count(last) = need"),
    "cover": (("low",), "SELECT query_id, doc_id, sum(CASE WHEN before IS NULL OR low > before THEN 1.0::DOUBLE / (p - low - need + 2) ELSE 0 END ORDER BY p) AS cover FROM (SELECT *, lag(low) OVER (PARTITION BY query_id, doc_id ORDER BY p) AS before FROM low) GROUP BY 1, 2"),
    "key": (("cover",), "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cover DESC, doc_id)::INT AS rank FROM cover"),
    "qt": (("items",), f"SELECT query_id, list_distinct({TERMS}) AS t FROM items"),
    "dt": ((), f"SELECT doc_id, list_distinct({TERMS}) AS t FROM documents"),
    "rsem": (("sem", "qt", "dt"), _RERANK.format("sem")),
    "rhyb": (("hyb", "qt", "dt"), _RERANK.format("hyb")),
    "dv": (("e",), "SELECT doc_id, text, lang, v FROM documents JOIN e ON doc_id = vec_id"),
    "sem0": (("dv", "e", "items"), "SELECT query_id, doc_id, list_cosine_similarity(q.v, dv.v) AS score FROM items JOIN e q ON query_id = q.vec_id, dv"),
    "sem": (("sem0",), "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sem0 QUALIFY rank <= 120"),
    "hyb0": (("sem", "key"), "SELECT query_id, doc_id, s.rank AS sem_rank, k.rank AS key_rank, 1.0::DOUBLE / (60 + coalesce(s.rank, 121)) + 1.0::DOUBLE / (60 + coalesce(k.rank, 121)) AS score FROM sem s FULL JOIN (SELECT * FROM key WHERE rank <= 120) k USING (query_id, doc_id)"),
    "hyb": (("hyb0",), "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM hyb0 QUALIFY rank <= 60"),
    "truth": (("items",), "SELECT query_id, doc_id FROM items JOIN documents d ON contains(d.text, items.text)"),
    "ct": (("ch", "e"), "SELECT doc_id * 1000 + chunk_no AS chunk_id, doc_id AS document_id, content, tokens, CASE WHEN doc_id % 2 = 0 THEN 'token' ELSE 'recursive' END AS type, v FROM ch JOIN e ON vec_id = (doc_id * 7 + chunk_no) % 500"),
    "sp": (("e",), f"SELECT * FROM (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id) WHERE sim >= {LEAST_SIMILARITY}"),
    "spb": (("sp",), "SELECT u AS a, v AS b FROM sp UNION ALL SELECT v, u FROM sp"),
    "reach": (("spb",), "SELECT DISTINCT a AS node, a AS r FROM spb UNION SELECT reach.node, spb.b FROM reach JOIN spb ON reach.r = spb.a"),
    "comp": (("reach",), "SELECT node, min(r) AS component FROM reach GROUP BY node"),
    "rel": ((), "SELECT DISTINCT l_suppkey * 10000000 + l_partkey AS rel_id, 's' || l_suppkey AS from_entity, 'p' || l_partkey AS to_entity, (1 + (l_suppkey * 7 + l_partkey) % 10)::INT AS weight FROM lineitem"),
    "prel": (("sp",), "SELECT u * 10000000 + v AS rel_id, u AS from_entity, v AS to_entity, 3 AS tokens, u || ' -> ' || v || ': alike' AS line FROM sp"),
}
