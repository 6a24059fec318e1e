"""Queries of vectors, chunks, search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.operators import chunking, evaluation, ranges, search, tables
from tessellon.plans import inputs
from tessellon.plans.inputs import TERMS, cte
from tessellon.session import table


def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.semantic_search(table(spark, sf, "embeddings"), inputs.query_vectors(spark, sf), 10, exclude_same=True)
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def mrl_truncate_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Both ways of truncating to 32 dims: cut and renormalise, or cut alone."""
    out = None
    for mode, again in (("renormalized", True), ("cut", False)):
        cut = lambda df: df.withColumn("embedding", vx.truncate(vx.normalize(F.col("embedding")), 32, again))  # noqa: B023, E731
        q = cut(inputs.query_vectors(spark, sf))
        scored = search.dot_search(cut(table(spark, sf, "embeddings")), q, 10)
        part = scored.select(F.lit(mode).alias("mode"), "query_id", "vec_id", "rank", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    total = F.aggregate(vx.normalize(e), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(vx.norm(e), 6).alias("norm"), F.round(total, 6).alias("unit_sum"))


def vector_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("["), F.col("vec_id"), F.lit(",0.5,-2.25,"), F.col("label"), F.lit("]"))
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(vx.parse(text), F.lit(0.0), lambda s, x: s + x).alias("total"))


def similar_entities_union(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.semantic_search(table(spark, sf, "embeddings"), inputs.query_vectors(spark, sf), 5, exclude_same=True)
    return search.nearest_union(hits)


def adaptive_topk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("entities"), search.adaptive_k(F.col("n_nationkey")).alias("k"))


def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.chunks(spark, sf).select("doc_id", "chunk_no", "content", "tokens", "start_token", "end_token")


def token_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    kept = search.within_budget(inputs.chunks(spark, sf), ["doc_id"], [F.col("chunk_no")], "tokens", 200)
    return kept.select("doc_id", "chunk_no", "running_tokens")


def greedy_token_batches(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", tx.token_count(F.col("text")).alias("tokens"))
    return search.greedy_batches(turns, ["conv_id"], "turn", "tokens", 200)


def term_postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "documents"))


def keyword_match_and(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.keyword_hits(spark, sf).select("query_id", "doc_id", F.round("cover", 9).alias("cover"), "rank")


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.hybrid_hits(spark, sf).select("query_id", "doc_id", "sem_rank", "key_rank", F.round("score", 9).alias("score"), "rank")


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = inputs.reranked(spark, sf, inputs.hybrid_hits(spark, sf), 20, 10)
    return out.select("query_id", "doc_id", "rank", F.round("rerank_score", 9).alias("rerank_score"), "rerank_rank")


def semantic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred documents nearest to each item, reranked to ten."""
    out = inputs.reranked(spark, sf, inputs.semantic_hits(spark, sf), 100, 10)
    return out.select("query_id", "doc_id", "rank", F.round("rerank_score", 9).alias("rerank_score"), "rerank_rank")


def chunk_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of one kind within a token budget, in four ways: semantic and hybrid, reranked or not."""
    store = search.Retriever(inputs.stored(spark, sf, "chunk-table", lambda: inputs.chunk_table(spark, sf).where("type = 'token'")), budget=250)
    asked, out = inputs.item_questions(spark, sf), None
    for name, way in (("semantic", store.semantic), ("hybrid", store.hybrid)):
        for again in (False, True):  # all ask for chunks of one kind, which are made once
            part = way(asked, "token", 10, again).select(F.lit(name + "_reranked" * again).alias("way"), "query_id", "chunk_id", "document_id", "rank", "running_tokens", F.round("score", 9).alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


def score_debug(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every vector for one question."""
    return search.scored_rows(table(spark, sf, "embeddings"), inputs.vector_of(spark, sf, 0)).select("vec_id", F.round("score", 6).alias("score"))


def locate_text(spark: SparkSession, sf: str) -> DataFrame:
    """Where the items stand in the documents that hold them."""
    both = inputs.truth(spark, sf).join(inputs.items(spark, sf), "query_id").join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")
    return chunking.located(both, "document", "text").select("query_id", "doc_id", "start", "end")


def relevance_substring(spark: SparkSession, sf: str) -> DataFrame:
    hits = inputs.hybrid_hits(spark, sf, 5).join(inputs.items(spark, sf), "query_id")
    hits = hits.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")
    out = evaluation.relevance(hits, "text", "document")
    return out.select("query_id", "doc_id", F.round("jaccard", 9).alias("jaccard"), F.round("bidir", 9).alias("bidir"), "relevant")


def lenient_relevance(spark: SparkSession, sf: str) -> DataFrame:
    hits = inputs.hybrid_hits(spark, sf, 5).join(inputs.items(spark, sf), "query_id")
    hits = hits.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")
    out = evaluation.lenient_relevance(hits, "document", "text")
    return out.select("query_id", "doc_id", F.round("overlap", 9).alias("overlap"), "relevant")


def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.precision_recall(inputs.items(spark, sf), inputs.hybrid_hits(spark, sf), inputs.truth(spark, sf), (1, 3, 5, 10))
    return out.select("query_id", "k", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def mrr_map_hit(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.ranking_metrics(inputs.items(spark, sf), inputs.hybrid_hits(spark, sf), inputs.truth(spark, sf))
    return out.select("query_id", F.round("mrr", 9).alias("mrr"), F.round("ap", 9).alias("ap"), "hit")


STRATEGIES = ["semantic_basic", "semantic_reranked", "hybrid_basic", "hybrid_reranked"]


def _strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each item under each strategy, with the tokens of what it found and whether that is anything."""
    asked, want, out = inputs.items(spark, sf), inputs.truth(spark, sf), None
    sem, hyb = inputs.semantic_hits(spark, sf), inputs.hybrid_hits(spark, sf)
    sizes = table(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))
    again = lambda hits: inputs.reranked(spark, sf, hits, 20, 10).select("query_id", "doc_id", F.col("rerank_rank").alias("rank"))
    for name, hits in zip(STRATEGIES, (sem.where("rank <= 10"), again(sem), hyb.where("rank <= 10"), again(hyb))):
        hits = hits.select("query_id", "doc_id", "rank", F.lit(name).alias("strategy"))
        out = hits if out is None else out.unionByName(hits)
    hits = inputs.stored(spark, sf, "strategy-hits", lambda: out.join(sizes, "doc_id"))
    every = asked.select("query_id", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy")).select(F.struct("strategy", "query_id").alias("key"))
    keyed = hits.select(F.struct("strategy", "query_id").alias("key"), "doc_id", "rank", "tokens")
    wanted = want.select(F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy"), "query_id", "doc_id").select(F.struct("strategy", "query_id").alias("key"), "doc_id")
    scored = evaluation.ranking_metrics(every, keyed, wanted, "key")
    length = keyed.groupBy("key").agg(F.sum("tokens").alias("context_length"))
    out = scored.join(length, "key", "left").select("key.strategy", "key.query_id", "mrr", "ap", "hit", F.coalesce("context_length", F.lit(0)).alias("context_length"), F.col("context_length").isNotNull().cast("int").alias("success"))
    return out.withColumn("dataset", F.concat(F.lit("d"), F.col("query_id") % 3))


def strategy_results(spark: SparkSession, sf: str) -> DataFrame:
    return _strategies(spark, sf).select("strategy", "dataset", "query_id", F.round("mrr", 9).alias("mrr"), F.round("ap", 9).alias("ap"), "hit", "context_length", "success")


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.metric_rollup(_strategies(spark, sf), "strategy", "dataset", ["mrr", "ap", "hit", "context_length", "success"])
    return out.select("strategy", "dataset", "questions", *(F.round(c, 6).alias(c) for c in ("mrr", "ap", "hit", "context_length", "success")))


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.metric_summary(_strategies(spark, sf), "strategy", "mrr")
    return out.select("strategy", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "std_sample", "perfect")), evaluation.in_band(F.col("mean"), 0.2, 0.7).alias("realistic"))


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.metric_pivot(_strategies(spark, sf), "dataset", "strategy", "mrr", STRATEGIES)
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in STRATEGIES), "best")


def dimension_study(spark: SparkSession, sf: str) -> DataFrame:
    """Mean precision and recall of vectors cut to fewer dimensions; vectors of an equal label are relevant."""
    e, out = table(spark, sf, "embeddings"), None
    labelled = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    for dims in (16, 32, 64):
        cut = e.withColumn("embedding", vx.truncate(F.col("embedding"), dims, True))
        asked = cut.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        scores = evaluation.label_precision_recall(labelled, search.dot_search(cut, asked, 20), e, (1, 5, 20), item="vec_id")
        part = scores.groupBy("k").agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(dims).alias("dims"), "k", "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return out


def idset_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    hits = search.semantic_search(e, asked.select("query_id", "embedding"), 20, exclude_same=True)
    out = evaluation.label_precision_recall(asked, hits, e, (1, 5, 10, 20), item="vec_id")
    return out.select("query_id", "k", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """A range in each chunk, of 20 to 44 tokens, so that neighbours may or may not overlap."""
    s = F.col("start_token")
    return inputs.chunks(spark, sf).select("doc_id", s.alias("start"), F.least(s + 20 + s * 7 % 25, "end_token").alias("end"))


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    """A range for each document: its middle half."""
    n = tx.token_count(F.col("text"))
    return table(spark, sf, "documents").where(n > 0).select("doc_id", F.floor(n / 4).cast("int").alias("start"), F.floor(3 * n / 4).cast("int").alias("end"))


def union_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.union_ranges(_spans(spark, sf), ["doc_id"])


def range_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.intersect_ranges(_spans(spark, sf), _relevant(spark, sf), ["doc_id"])


def range_difference(spark: SparkSession, sf: str) -> DataFrame:
    target = _relevant(spark, sf).select("doc_id", F.col("start").alias("ts"), F.col("end").alias("te"))
    return ranges.subtract_range(_spans(spark, sf).join(target, "doc_id"), F.col("ts"), F.col("te")).select("doc_id", "start", "end")


def range_iou(spark: SparkSession, sf: str) -> DataFrame:
    out = ranges.range_scores(_spans(spark, sf), _relevant(spark, sf), ["doc_id"])
    return out.select("doc_id", *(F.round(c, 9).alias(c) for c in ("iou", "precision", "recall", "f1")))


def embedding_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return tables.embedding_counts(d, "embedding")


def text_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of documents in order: limit and offset are the feature."""
    return tables.page(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 25, 50)


def clipped_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Strings of more than 50 characters, clipped at 2000: the clip is the feature."""
    return table(spark, sf, "documents").where(F.char_length("text") > 50).select("doc_id", F.md5(tx.clipped(F.col("text")).cast("binary")).alias("digest"))


_SPAN_SQL = "(SELECT doc_id, start_token AS s, least(start_token + 20 + start_token * 7 % 25, end_token) AS e FROM ch)"
_REL_SQL = "(SELECT doc_id, len(t) // 4 AS ts, 3 * len(t) // 4 AS te FROM tok WHERE len(t) > 0)"
_UNION_SQL = """SELECT doc_id, min(s)::INT AS s, max(e)::INT AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {0}) x) y GROUP BY doc_id, g"""
_METRICS = """SELECT i.query_id, coalesce(1.0::DOUBLE / f, 0) AS mrr, CASE WHEN n > 0 THEN coalesce(total / n, 0) ELSE 0 END AS ap, (f IS NOT NULL)::INT AS hit
  FROM items i LEFT JOIN (SELECT query_id, min(rank) AS f, sum(nth / rank) AS total FROM (SELECT h.query_id, h.rank, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank)::DOUBLE AS nth FROM {0} h JOIN truth USING (query_id, doc_id)) g GROUP BY query_id) r USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id) w USING (query_id)"""
_HITS = {"semantic_basic": "sem", "semantic_reranked": "rsem", "hybrid_basic": "hyb", "hybrid_reranked": "rhyb"}
_FOUND = "(SELECT query_id, doc_id, rank FROM {0} WHERE rank <= 10)"
_ONE = """SELECT '{1}' AS strategy, 'd' || (query_id % 3) AS dataset, m.*, coalesce(c.n, 0) AS context_length, (c.n IS NOT NULL)::INT AS success FROM ({2}) m
  LEFT JOIN (SELECT query_id, sum(len(t))::BIGINT AS n FROM {0} JOIN tok USING (doc_id) GROUP BY 1) c USING (query_id)"""
_RES = cte("rsem", "rhyb", "truth", "tok").rstrip() + ",\nres AS (" + " UNION ALL ".join(_ONE.format(_FOUND.format(h), n, _METRICS.format(_FOUND.format(h))) for n, h in _HITS.items()) + ")\n"
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, q.label AS wanted, c.label, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0)"

_CHUNK_WAY = """SELECT '{1}' AS way, query_id, chunk_id, document_id, rank, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS running_tokens, round(score, 9) AS score FROM {0} JOIN c USING (chunk_id) QUALIFY running_tokens <= 250"""
_CHUNK_AGAIN = "SELECT query_id, chunk_id, x AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, r0, chunk_id)::INT AS rank FROM (SELECT query_id, chunk_id, h.rank AS r0, len(list_intersect(qt.t, c.t))::DOUBLE / len(qt.t) AS x FROM {0} h JOIN qt USING (query_id) JOIN c USING (chunk_id) WHERE h.rank <= 20) QUALIFY rank <= 10"
_CHUNKS = (
    cte("ct", "qt", "asked").rstrip()
    + f""",
 c AS MATERIALIZED (SELECT chunk_id, document_id, tokens, v, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS words, list_distinct(words) AS t FROM ct WHERE type = 'token'),
 s0 AS (SELECT query_id, chunk_id, list_cosine_similarity(q.v, c.v).round(12) AS score FROM items JOIN e q ON query_id = q.vec_id, c),
 s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s0 QUALIFY rank <= 120),
 k0 AS MATERIALIZED (SELECT query_id, chunk_id, len(qt.t) AS need FROM qt JOIN c ON len(list_intersect(qt.t, c.t)) = len(qt.t)),
 o AS (SELECT k0.query_id, chunk_id, need, term, p FROM k0 JOIN (SELECT chunk_id, unnest(words) AS term, unnest(range(len(words))) AS p FROM c) USING (chunk_id) JOIN asked USING (query_id, term)),
 l AS (SELECT query_id, chunk_id, need, p, min(last) AS low FROM (SELECT o.query_id, chunk_id, need, p, max(CASE WHEN o.term = a.term THEN p END) OVER (PARTITION BY o.query_id, chunk_id, a.term ORDER BY p) AS last FROM o JOIN asked a ON a.query_id = o.query_id) GROUP BY ALL HAVING count(last) = need),
 v AS (SELECT query_id, chunk_id, sum(CASE WHEN before IS NULL OR low > before THEN 1.0::DOUBLE / (p - low - need + 2) ELSE 0 END ORDER BY p) AS cover FROM (SELECT *, lag(low) OVER (PARTITION BY query_id, chunk_id ORDER BY p) AS before FROM l) GROUP BY 1, 2),
 k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY cover DESC, chunk_id)::INT AS rank FROM v QUALIFY rank <= 120),
 h0 AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + coalesce(s.rank, 121)) + 1.0::DOUBLE / (60 + coalesce(k.rank, 121)) AS score FROM s FULL JOIN k USING (query_id, chunk_id)),
 h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM h0 QUALIFY rank <= 20)
 """
    + " UNION ALL ".join(f"({_CHUNK_WAY.format(f'({rows})', way)})" for rows, way in (("SELECT * FROM s WHERE rank <= 10", "semantic"), (_CHUNK_AGAIN.format("s"), "semantic_reranked"), ("SELECT * FROM h WHERE rank <= 10", "hybrid"), (_CHUNK_AGAIN.format("h"), "hybrid_reranked")))
)

SQL = {
    "semantic_topk": cte("e") + f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ({_TOP}) WHERE rank <= 10",
    "mrl_truncate_topk": cte("e") + """, n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))[1:32] AS v FROM e),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS d, list_cosine_similarity(q.v, c.v) AS c FROM n q JOIN n c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
 m AS (SELECT 'cut' AS mode, query_id, vec_id, d AS score FROM s UNION ALL SELECT 'renormalized', query_id, vec_id, c FROM s)
 SELECT mode, query_id, vec_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, vec_id)::INT AS rank, round(score, 6) AS score FROM m QUALIFY rank <= 10""",
    "vector_normalize": cte("e") + "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS unit_sum FROM e",
    "vector_parse": "SELECT vec_id, vec_id + 0.5::DOUBLE - 2.25::DOUBLE + label AS total FROM embeddings",
    "similar_entities_union": cte("e") + f"SELECT DISTINCT vec_id FROM ({_TOP}) WHERE rank <= 5",
    "adaptive_topk": "SELECT n_nationkey AS entities, CASE WHEN n_nationkey < 3 THEN 5 WHEN n_nationkey = 4 THEN 3 ELSE 2 END::INT AS k FROM nation",
    "token_chunks": cte("ch") + "SELECT doc_id, chunk_no, content, tokens, start_token, end_token FROM ch",
    "token_budget_prefix": cte("ch") + "SELECT doc_id, chunk_no, sum(tokens) OVER (PARTITION BY doc_id ORDER BY chunk_no)::BIGINT AS running_tokens FROM ch QUALIFY running_tokens <= 200",
    "greedy_token_batches": rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, len({inputs.TOKENS})::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, len({inputs.TOKENS})) AS n FROM conversations),
 r AS (SELECT conv_id, turn, tokens, n, tokens AS total, 0::BIGINT AS batch_no FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.tokens, t.n, CASE WHEN r.total > 0 AND r.total + t.tokens > 200 THEN t.tokens ELSE r.total + t.tokens END, r.batch_no + CASE WHEN r.total > 0 AND r.total + t.tokens > 200 THEN 1 ELSE 0 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
 SELECT conv_id, turn, tokens, batch_no FROM r""",
    "term_postings": cte("post") + "SELECT doc_id, term, tf FROM post",
    "keyword_match_and": cte("key") + "SELECT query_id, doc_id, round(cover, 9) AS cover, rank FROM key",
    "hybrid_rrf": cte("hyb") + "SELECT query_id, doc_id, sem_rank, key_rank, round(score, 9) AS score, rank FROM hyb",
    "rerank_topk": cte("hyb", "qt", "dt") + """, s AS (SELECT query_id, doc_id, rank, len(list_intersect(qt.t, dt.t))::DOUBLE / len(qt.t) AS x FROM hyb JOIN qt USING (query_id) JOIN dt USING (doc_id) WHERE rank <= 20)
 SELECT query_id, doc_id, rank, round(x, 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, rank, doc_id)::INT AS rerank_rank FROM s QUALIFY rerank_rank <= 10""",
    "semantic_rerank": cte("sem", "qt", "dt") + """, s AS (SELECT query_id, doc_id, rank, len(list_intersect(qt.t, dt.t))::DOUBLE / len(qt.t) AS x FROM sem JOIN qt USING (query_id) JOIN dt USING (doc_id) WHERE rank <= 100)
 SELECT query_id, doc_id, rank, round(x, 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, rank, doc_id)::INT AS rerank_rank FROM s QUALIFY rerank_rank <= 10""",
    "chunk_retrieval": _CHUNKS,
    "score_debug": cte("e") + "SELECT c.vec_id, round(list_cosine_similarity(c.v, q.v), 6) AS score FROM e c JOIN e q ON q.vec_id = 0",
    "locate_text": "SELECT item_id AS query_id, doc_id, (strpos(d.text, b.text) - 1)::INT AS start, (strpos(d.text, b.text) - 1 + length(b.text))::INT AS \"end\" FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "lenient_relevance": cte("hyb") + r""", h AS (SELECT query_id, doc_id, lower(trim(d.text)) AS a, lower(trim(i.text)) AS b FROM hyb JOIN items i USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 5),
 x AS (SELECT *, list_distinct(regexp_extract_all(a, '[^ \t\n\r\f\x0B]+')) AS p, list_distinct(regexp_extract_all(b, '[^ \t\n\r\f\x0B]+')) AS q FROM h),
 y AS (SELECT query_id, doc_id, CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0::DOUBLE ELSE len(list_intersect(p, q))::DOUBLE / len(q) END AS o FROM x)
 SELECT query_id, doc_id, round(o, 9) AS overlap, (o >= 0.3)::INT AS relevant FROM y""",
    "relevance_substring": cte("hyb") + r""", h AS (SELECT query_id, doc_id, lower(trim(i.text)) AS a, lower(trim(d.text)) AS b FROM hyb JOIN items i USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 5),
 x AS (SELECT *, list_distinct(regexp_extract_all(a, '[^ \t\n\r\f\x0B]+')) AS p, list_distinct(regexp_extract_all(b, '[^ \t\n\r\f\x0B]+')) AS q FROM h),
 y AS (SELECT *, len(list_intersect(p, q))::DOUBLE AS n FROM x)
 SELECT query_id, doc_id, round(n / (len(p) + len(q) - n), 9) AS jaccard, round((n / len(p) + n / len(q)) / 2, 9) AS bidir, (contains(a, b) OR contains(b, a))::INT AS relevant FROM y""",
    "precision_recall_at_k": cte("hyb", "truth") + """, g AS (SELECT h.query_id, h.doc_id, h.rank FROM hyb h JOIN truth USING (query_id, doc_id)),
 k AS (SELECT query_id, unnest([1, 3, 5, 10])::INT AS k FROM items), n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
 m AS (SELECT kk.query_id, kk.k, count(g.rank)::DOUBLE / kk.k AS p, CASE WHEN max(n.n) > 0 THEN count(DISTINCT g.doc_id)::DOUBLE / max(n.n) ELSE 0 END AS r FROM k kk LEFT JOIN g ON g.query_id = kk.query_id AND g.rank <= kk.k LEFT JOIN n ON n.query_id = kk.query_id GROUP BY kk.query_id, kk.k)
 SELECT query_id, k, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m""",
    "mrr_map_hit": cte("hyb", "truth") + f"SELECT query_id, round(mrr, 9) AS mrr, round(ap, 9) AS ap, hit FROM ({_METRICS.format('hyb')})",
    "strategy_results": _RES + "SELECT strategy, dataset, query_id, round(mrr, 9) AS mrr, round(ap, 9) AS ap, hit, context_length, success FROM res",
    "metric_rollup": _RES + "SELECT strategy, dataset, count(*) AS questions, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, round(avg(hit), 6) AS hit, round(avg(context_length), 6) AS context_length, round(avg(success), 6) AS success FROM res GROUP BY GROUPING SETS ((strategy, dataset), (strategy))",
    "metric_summary": _RES + "SELECT strategy, round(avg(mrr), 6) AS mean, round(quantile_cont(mrr, 0.5), 6) AS median, round(stddev_pop(mrr), 6) AS std, round(stddev_samp(mrr), 6) AS std_sample, round(avg((mrr >= 0.99)::INT), 6) AS perfect, avg(mrr) BETWEEN 0.2 AND 0.7 AS realistic FROM res GROUP BY strategy",
    "metric_pivot": _RES + ", p AS (SELECT dataset, " + ", ".join(f"avg(mrr) FILTER (strategy = '{n}') AS {n}" for n in _HITS) + " FROM res GROUP BY dataset) SELECT dataset, " + ", ".join(f"round({n}, 6) AS {n}" for n in _HITS) + ", CASE greatest(" + ", ".join(_HITS) + ") " + " ".join(f"WHEN {n} THEN '{n}'" for n in _HITS) + " END AS best FROM p",
    "dimension_study": cte("e") + """, d AS (SELECT unnest([16, 32, 64])::INT AS dims), n AS (SELECT dims, vec_id, label, v[1:dims] AS v FROM e, d),
 t AS (SELECT q.dims, q.vec_id AS query_id, q.label = c.label AS good, row_number() OVER (PARTITION BY q.dims, q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 12) DESC, c.vec_id) AS rank FROM n q JOIN n c ON q.dims = c.dims AND q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
 w AS (SELECT dims, query_id, count(*) FILTER (good) AS n FROM t GROUP BY 1, 2),
 m AS (SELECT t.dims, k, t.query_id, count(*) FILTER (good)::DOUBLE / k AS p, CASE WHEN any_value(n) > 0 THEN count(*) FILTER (good)::DOUBLE / any_value(n) ELSE 0 END AS r FROM t JOIN w USING (dims, query_id), (SELECT unnest([1, 5, 20])::INT AS k) WHERE rank <= k GROUP BY 1, 2, 3)
 SELECT dims, k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM m GROUP BY 1, 2""",
    "idset_precision_recall": cte("e") + f""", t AS (SELECT * FROM ({_TOP}) WHERE rank <= 20), k AS (SELECT vec_id AS query_id, label, unnest([1, 5, 10, 20])::INT AS k FROM e WHERE vec_id % 100 = 0),
 n AS (SELECT k.query_id, k, (SELECT count(*) FROM e WHERE e.label = k.label AND e.vec_id <> k.query_id) AS n FROM k)
 SELECT n.query_id, n.k, round(count(t.vec_id)::DOUBLE / n.k, 9) AS precision, round(CASE WHEN n.n > 0 THEN count(t.vec_id)::DOUBLE / n.n ELSE 0 END, 9) AS recall FROM n LEFT JOIN t ON t.query_id = n.query_id AND t.rank <= n.k AND t.label = t.wanted GROUP BY n.query_id, n.k, n.n""",
    "union_ranges": cte("ch") + f"SELECT doc_id, s AS start, e AS \"end\" FROM ({_UNION_SQL.format(_SPAN_SQL)})",
    "range_intersection": cte("ch") + f"SELECT doc_id, greatest(s, ts)::INT AS start, least(e, te)::INT AS \"end\" FROM {_SPAN_SQL} JOIN {_REL_SQL} USING (doc_id) WHERE greatest(s, ts) <= least(e, te)",
    "range_difference": cte("ch") + f"""SELECT doc_id, a::INT AS start, b::INT AS "end" FROM (SELECT doc_id, unnest(CASE WHEN te <= s OR ts >= e THEN [{{'a': s, 'b': e}}] ELSE [{{'a': s, 'b': least(e, ts)}}, {{'a': greatest(s, te), 'b': e}}] END, recursive := true), te <= s OR ts >= e AS apart FROM {_SPAN_SQL} JOIN {_REL_SQL} USING (doc_id)) WHERE apart OR a < b""",
    "range_iou": cte("ch") + f""", g AS ({_UNION_SQL.format(_SPAN_SQL)}), r AS (SELECT * FROM {_REL_SQL}),
 z AS (SELECT coalesce(a.doc_id, r.doc_id) AS doc_id, coalesce(got, 0)::DOUBLE AS got, coalesce(te - ts, 0)::DOUBLE AS want, coalesce(b, 0)::DOUBLE AS b FROM (SELECT doc_id, sum(e - s) AS got FROM g GROUP BY 1) a FULL JOIN r ON a.doc_id = r.doc_id
  LEFT JOIN (SELECT doc_id, sum(least(e, te) - greatest(s, ts)) AS b FROM g JOIN r USING (doc_id) WHERE greatest(s, ts) <= least(e, te) GROUP BY 1) c ON c.doc_id = coalesce(a.doc_id, r.doc_id))
 SELECT doc_id, round(CASE WHEN got + want - b > 0 THEN b / (got + want - b) ELSE 0 END, 9) AS iou, round(CASE WHEN got > 0 THEN b / got ELSE 0 END, 9) AS precision, round(CASE WHEN want > 0 THEN b / want ELSE 0 END, 9) AS recall, round(CASE WHEN got + want > 0 THEN 2 * b / (got + want) ELSE 0 END, 9) AS f1 FROM z""",
    "embedding_counts": "SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS waiting FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "text_page": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50",
    "clipped_documents": "SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END) AS digest FROM documents WHERE length(text) > 50",
}

QUERIES = [semantic_topk, mrl_truncate_topk, vector_normalize, vector_parse, similar_entities_union, adaptive_topk, token_chunks, token_budget_prefix, greedy_token_batches, term_postings, keyword_match_and, hybrid_rrf, rerank_topk, semantic_rerank, chunk_retrieval, score_debug, locate_text, relevance_substring, lenient_relevance, precision_recall_at_k, mrr_map_hit, strategy_results, metric_rollup, metric_summary, metric_pivot, dimension_study, idset_precision_recall, union_ranges, range_intersection, range_difference, range_iou, embedding_counts, text_page, clipped_documents]
