"""Vector, keyword and hybrid search for many queries at once, and what is done with ranked rows.

Up to ``QUERY_BLOCK`` query vectors go to the executors as one matrix, against which each
task keeps a running best for each query, so the corpus is never shuffled. More queries
are a table of their own: blocks of queries meet blocks of the corpus, each pair in one
task of bounded size. Every ranking breaks ties by the smallest id, so ranks are
reproducible. Rows without a vector are never ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.session import written

#: Query vectors that are broadcast, and corpus rows of one task beyond; query terms and hits (an id pair each) that are broadcast.
QUERY_BLOCK, CORPUS_BLOCK, BROADCAST_TERMS, BROADCAST_HITS = 2_048, 65_536, 100_000, 200_000
#: Rarest terms of a query that documents are looked up by.
PROBED = 3


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", k: int | None = None) -> DataFrame:
    """``df`` with the rank of each row among those of equal ``by``; only the first ``k`` where it is given.

    Without ``by`` all rows are one ranking: for the rows of one question, not for tables.
    """
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def unit_rows(vectors: list, dims: int, unit: bool = True) -> np.ndarray:
    """A matrix of rows at length 1, or as they are; rows that are null, zero or of another length are not a number."""
    out = np.full((len(vectors), dims), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims and (length := np.sqrt(np.square(x := np.asarray(v, float)).sum())) > 0:
            out[i] = x / length if unit else x
    return out


def matrix(column: pa.Array, dims: int | None = None, unit: bool = True) -> np.ndarray:
    """``unit_rows`` of an Arrow column of vectors, without a Python object for each; the longest vector has ``dims`` where it is not given."""
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    dims = max(1, int(size.max(initial=0))) if dims is None else dims
    out, whole = np.full((len(size), dims), np.nan), size == dims
    if whole.any():
        rows = (column if whole.all() else column.filter(pa.array(whole))).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        with np.errstate(invalid="ignore", divide="ignore"):
            length = np.sqrt(np.square(rows).sum(1))[:, None]
            out[whole] = np.where(length > 0, rows / length if unit else rows, np.nan)
    return out


class Best:
    """The best rows seen for each query, of equal scores those of the least id."""

    def __init__(self, asked: np.ndarray, k: int | None):
        self.asked, self.k, self.held = asked, k, None

    def add(self, names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) by query of the rows now best; with ``k`` None those of this batch alone."""
        scores = (self.asked @ own.T).round(12)
        ids = np.broadcast_to(names, scores.shape)
        if self.k is not None and self.held is not None:
            ids, scores = np.concatenate([self.held[0], ids], 1), np.concatenate([self.held[1], scores], 1)
        if self.k is not None and scores.shape[1] > self.k:
            # all that reach the k-th score may still tie with it
            limit = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1, None]
            ids, scores = self._cut(ids, scores, limit)
        self.held = ids, scores
        return self.held

    def _cut(self, ids: np.ndarray, scores: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_ids, out_scores = np.empty((len(ids), self.k), ids.dtype), np.empty((len(ids), self.k))
        for q in range(len(ids)):
            at = np.flatnonzero(scores[q] >= limit[q])
            if len(at) < self.k:  # a query that is not a number
                at = np.arange(self.k)
            at = at[np.lexsort((ids[q, at], -scores[q, at]))][: self.k]
            out_ids[q], out_scores[q] = ids[q, at], scores[q, at]
        return out_ids, out_scores


def _rows(asked_ids: list, found: tuple[np.ndarray, np.ndarray], fields: list[str], least: float | None) -> pd.DataFrame:
    q, i = np.nonzero(~np.isnan(found[1]) if least is None else found[1] >= least)
    return pd.DataFrame({fields[0]: [asked_ids[x] for x in q], fields[1]: found[0][q, i], fields[2]: found[1][q, i]})


def semantic_search(corpus: DataFrame, queries: DataFrame, k: int | None, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", where: Column | None = None, exclude_same: bool = False, unit: bool = True, least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows by cosine to each query (query_id, embedding).

    ``k`` None ranks all rows, ``least`` only those of so high a score. ``exclude_same``
    leaves out the row whose id is the query's. Scores have 12 decimals, so rows of equal
    vectors tie wherever they stand.
    """
    corpus = corpus.where(F.col(vector).isNotNull() if where is None else where & F.col(vector).isNotNull()).select(id_col, vector)
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    fields = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {corpus.schema[id_col].dataType.simpleString()}, score double"
    first = asked.limit(QUERY_BLOCK + 1).collect()
    keep = None if k is None else k + exclude_same
    if len(first) <= QUERY_BLOCK:
        pairs = _nearest(corpus, [r[0] for r in first], [r[1] for r in first], keep, unit, fields, least)
    else:
        pairs = _nearest_by_blocks(corpus, asked, keep, unit, fields, least)
    if exclude_same:
        pairs = pairs.where(F.col(query_id) != F.col(id_col))
    return ranked(pairs, [query_id], [F.col("score").desc(), F.col(id_col)], "rank", k)


def _nearest(corpus: DataFrame, ids: list, found: list, k: int | None, unit: bool, fields: str, least: float | None) -> DataFrame:
    """Each task's best rows for each query."""
    dims = max((len(v) for v in found), default=1)
    asked = unit_rows(found, dims, unit)
    schema = to_arrow_schema(corpus.sparkSession.createDataFrame([], fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked, k)
        for batch in batches:
            own = matrix(batch.column(1), dims, unit)
            ok = np.flatnonzero(~np.isnan(own[:, 0]))
            if not len(ok) or not len(ids):
                continue
            held = best.add(np.array(batch.column(0).to_pylist())[ok], own[ok])
            if k is None:
                yield pa.RecordBatch.from_pandas(_rows(ids, held, schema.names, least), schema=schema)
        if k is not None and best.held is not None:
            yield pa.RecordBatch.from_pandas(_rows(ids, best.held, schema.names, least), schema=schema)

    return corpus.mapInArrow(run, fields)


def _nearest_by_blocks(corpus: DataFrame, asked: DataFrame, k: int | None, unit: bool, fields: str, least: float | None) -> DataFrame:
    """Each pair of blocks' best rows for each query of the block."""
    (query_id, vector), (id_col, _) = asked.columns, corpus.columns
    cuts, parts = -(-corpus.count() // CORPUS_BLOCK) or 1, -(-asked.count() // QUERY_BLOCK)
    left = corpus.withColumn("__c", F.pmod(F.xxhash64(id_col), F.lit(cuts)).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.select(F.col(query_id).alias("__id"), F.col(vector).alias("__x")).withColumn("__q", F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int")).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    names = [f.split()[0] for f in fields.split(", ")]

    def compare(own: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(want):
            return pd.DataFrame({n: [] for n in names})
        dims = int(want["__x"].map(len).max())
        rows = unit_rows(own[vector].tolist(), dims, unit)
        ok = ~np.isnan(rows[:, 0])
        best, at = Best(unit_rows(want["__x"].tolist(), dims, unit), k), 0
        out, ids = [], own[id_col].to_numpy()[ok]
        for at in range(0, len(ids), 4_096):
            held = best.add(np.array(ids[at : at + 4_096].tolist()), rows[ok][at : at + 4_096])
            if k is None:
                out.append(_rows(want["__id"].tolist(), held, names, least))
        if k is not None and best.held is not None:
            out.append(_rows(want["__id"].tolist(), best.held, names, least))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    return left.groupBy("__c", "__q").cogroup(right.groupBy("__c", "__q")).applyInPandas(compare, fields)


def dot_search(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` other rows with the largest inner product; vectors are taken as they are."""
    return semantic_search(corpus, queries, k, id_col, vector, query_id, exclude_same=True, unit=False)


def nearest_union(hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The distinct ids that any query found."""
    return hits.select(id_col).distinct()


def adaptive_k(entities: Column) -> Column:
    """Neighbours for each of a query's entities: 5 while there are fewer than three, 3 for exactly four, else 2."""
    return F.when(entities < 3, 5).when(entities == 4, 3).otherwise(2)


def postings(documents: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf): how often each term occurs in each document."""
    return documents.select(id_col, F.explode(tx.terms(F.col(text), stop_words)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(query_id, term): the distinct terms of each query, the first ``most`` of them where it is given."""
    found = F.array_distinct(tx.terms(F.col(text)))
    return queries.select(query_id, F.explode(F.slice(found, 1, most) if most else found).alias("term"))


def term_index(documents: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, terms, found): a document's terms in order, and its distinct terms. Worth storing where many searches follow."""
    rows = documents.select(id_col, tx.terms(F.col(text), stop_words).alias("terms"))
    return rows.select(id_col, "terms", F.array_distinct("terms").alias("found"))


def keyword_search(index: DataFrame, asked: DataFrame, k: int | None, id_col: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, cover, rank) of documents that hold every term (query_id, term) of a query, by cover density.

    ``index`` is what ``term_index`` gives. Documents are looked up by each query's
    ``PROBED`` rarest terms, by id and term alone, and only those few that have them are
    held against its other terms and ranked, so a frequent term makes no rows. Their
    terms are read in place: the index is dealt out by id only where more than
    ``BROADCAST_HITS`` are found. A query without terms, or with one that no document
    has, finds nothing.
    """
    wanted = asked.where(F.col("term").isNotNull()).distinct()
    terms = wanted.select("term").distinct()
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    few = F.broadcast if small else (lambda df: df)
    often = index.select(F.explode("found").alias("term")).join(few(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known, _ = written(wanted.join(often, "term", "left").select(query_id, "term", F.coalesce("df", F.lit(0)).alias("df")), "query-terms")
    whole = known.groupBy(query_id).agg(F.sort_array(F.collect_list("term")).alias("wanted"), F.min("df").alias("least"))
    whole = whole.where("least > 0").select(query_id, "wanted")
    probes = ranked(known, [query_id], [F.col("df"), F.col("term")], "place", PROBED).select(query_id, "term").join(whole, query_id)
    probes = probes.select(query_id, "term", F.least(F.size("wanted"), F.lit(PROBED)).alias("need"))
    near = index.select(id_col, F.explode("found").alias("term")).join(few(probes), "term").groupBy(query_id, id_col).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    near, _ = written(near.where("n = need").select(query_id, id_col), "query-hits")
    held = F.broadcast(near) if near.count() <= BROADCAST_HITS else near
    hits = index.join(held, id_col).join(few(whole), query_id)
    hits = hits.where(F.size(F.array_intersect("wanted", "found")) == F.size("wanted")).select(query_id, id_col, cover_density("wanted", "terms").alias("cover"))
    return ranked(hits, [query_id], [F.col("cover").desc(), F.col(id_col)], "rank", k)


def cover_density(wanted: str, terms: str) -> Column:
    """Sum over the shortest runs of an array of terms that hold all ``wanted`` ones of 1 / (other terms in the run + 1).

    A fold over the terms: it keeps the last place of each wanted term, and a run ends
    wherever the earliest of those moves on.
    """
    want = F.col(wanted)
    places = F.filter(F.transform(F.col(terms), lambda t, i: F.struct(F.array_position(want, t).cast("int").alias("w"), i.alias("i"))), lambda x: x["w"] > 0)
    start = F.struct(F.array_repeat(F.lit(-1), F.size(want)).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == x["w"] - 1, x["i"]).otherwise(p))
        low = F.array_min(last)
        new = low > acc["before"]
        more = F.when(new, F.lit(1.0) / (x["i"] - low - F.size(want) + 2)).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), F.greatest(acc["before"], low).alias("before"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(places, start, step, lambda acc: acc["sum"])


def reciprocal_rank_fusion(semantic: DataFrame, keyword: DataFrame, id_col: str = "doc_id", query_id: str = "query_id", rrf_k: int = 60, pool: int = 120, k: int | None = 60) -> DataFrame:
    """(query_id, id, sem_rank, key_rank, score, rank): both rankings fused; a rank that is missing counts as pool + 1."""
    sem = semantic.where(F.col("rank") <= pool).select(query_id, id_col, F.col("rank").alias("sem_rank"))
    key = keyword.where(F.col("rank") <= pool).select(query_id, id_col, F.col("rank").alias("key_rank"))
    part = lambda c: F.lit(1.0) / (F.lit(float(rrf_k)) + F.coalesce(F.col(c), F.lit(pool + 1)))
    both = sem.join(key, [query_id, id_col], "full_outer").withColumn("score", part("sem_rank") + part("key_rank"))
    return ranked(both, [query_id], [F.col("score").desc(), F.col(id_col)], "rank", k)


def term_overlap(query: Column, document: Column) -> Column:
    """The offline reranker: the share of a query's distinct terms that a document holds."""
    return shared_terms(F.array_distinct(tx.terms(query)), F.array_distinct(tx.terms(document)))


def shared_terms(wanted: Column, found: Column) -> Column:
    """The same for distinct terms that are already at hand."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], query: str, document: str, k: int | None, initial: int | None = None, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """The first ``initial`` hits of each query in the order of another score, ``k`` of them."""
    pool = hits if initial is None else hits.where(F.col("rank") <= initial)
    scored = pool.withColumn("rerank_score", scorer(F.col(query), F.col(document)))
    return ranked(scored, [query_id], [F.col("rerank_score").desc(), F.col("rank"), F.col(id_col)], "rerank_rank", k)


def within_budget(df: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group's ranking whose tokens fit the budget; null counts as 0."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_tokens", F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(run)).where(F.col("running_tokens") <= budget)


def greedy_batches(df: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """Each row with the number of its batch: a batch ends where the next row would pass the budget; a row above it is a batch of its own.

    The sum starts anew with each batch, so a group is read in order; its rows stream
    past sorted, and a task holds one Arrow batch of them whatever the group's size.
    """
    rows = df.select(*by, order, F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias(tokens))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, number = None, 0, 0
        for batch in batches:
            out = []
            for *key, size in zip(*(batch.column(i).to_pylist() for i in (*range(n), n + 1))):
                if key != group:
                    group, total, number = key, 0, 0
                if total > 0 and total + size > budget:
                    total, number = 0, number + 1
                total += size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch_no"])

    return rows.repartition(*by).sortWithinPartitions(*by, order, tokens).mapInArrow(run, f"{fields}, batch_no bigint")


def scored_rows(corpus: DataFrame, question: list[float], only: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): the cosine of each row, or of those that ``only`` names, with a question; to look into a ranking."""
    rows = corpus if only is None else corpus.where(only)
    return rows.select(id_col, vx.cosine(F.col(vector), F.array(*map(F.lit, map(float, question)))).alias("score"))


@dataclass(frozen=True)
class Retriever:
    """Retrieval over chunks (chunk_id, document_id, content, tokens, type, embedding), for all questions (query_id, text, embedding) at once.

    ``index`` is the term index of the chunks (id ``chunk_id``); where it is not given,
    that of a kind is built and written once. ``scorer`` reranks; with ``budget`` each question's hits are cut to the
    longest prefix within so many tokens.
    """

    chunks: DataFrame
    index: DataFrame | None = None
    scorer: Callable[[Column, Column], Column] = term_overlap
    budget: int | None = None
    pool: int = 120
    initial: int = 20
    _built: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def semantic(self, questions: DataFrame, kind: str, k: int = 10, reranked: bool = False) -> DataFrame:
        """The chunks of a kind nearest to each question; reranked from the first ``initial`` of them."""
        hits = semantic_search(self.chunks, questions, self.initial if reranked else k, "chunk_id", where=F.col("type") == kind)
        return self._answer(questions, hits, k, reranked)

    def hybrid(self, questions: DataFrame, kind: str, k: int = 10, reranked: bool = False) -> DataFrame:
        """The fusion of both rankings of the chunks of a kind; reranked from the first ``initial`` of it."""
        own = self.chunks.where(F.col("type") == kind)
        near = semantic_search(own, questions, self.pool, "chunk_id")
        if self.index is None and kind not in self._built:
            self._built[kind], _ = written(term_index(own, "chunk_id", "content"), "chunk-terms")
        index = self._built[kind] if self.index is None else self.index.join(own.select("chunk_id"), "chunk_id", "left_semi")
        words = keyword_search(index, query_terms(questions), self.pool, "chunk_id")
        return self._answer(questions, reciprocal_rank_fusion(near, words, "chunk_id", pool=self.pool, k=self.initial if reranked else k), k, reranked)

    def _answer(self, questions: DataFrame, hits: DataFrame, k: int, reranked: bool) -> DataFrame:
        """(query_id, chunk_id, document_id, content, tokens, score, rank[, running_tokens])"""
        out = hits.select("query_id", "chunk_id", "score", "rank").join(self.chunks.select("chunk_id", "document_id", "content", "tokens"), "chunk_id")
        if reranked:
            out = rerank(out.join(questions.select("query_id", "text"), "query_id"), self.scorer, "text", "content", k, id_col="chunk_id")
            out = out.select("query_id", "chunk_id", "document_id", "content", "tokens", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"))
        if self.budget is not None:
            out = within_budget(out, ["query_id"], [F.col("rank")], "tokens", self.budget)
        return out
