"""Worked examples and properties of the operators."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.functions import similarity, text, vectors
from tessellon.operators import chunking, embedding, evaluation, graph, leiden, pairs, ranges, search, tables
from tessellon.sources import files, generators
from tessellon.streaming import ingest


def ranged(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "doc string, start int, end int")


def plain(df):
    return sorted((r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("given, want", [([(0, 5), (3, 8), (10, 12)], [(0, 8), (10, 12)]), ([(0, 5), (5, 8)], [(0, 8)]), ([(0, 20), (2, 3), (4, 6)], [(0, 20)]), ([], [])])
def test_union_ranges(spark, given, want):
    assert plain(ranges.union_ranges(ranged(spark, given), ["doc"])) == want


def test_other_ranges(spark):
    assert ranges.range_sizes(ranged(spark, [(0, 10), (15, 20)]), ["doc"]).first().size == 15
    for width in (3, 256):
        assert plain(ranges.intersect_ranges(ranged(spark, [(0, 10)]), ranged(spark, [(5, 15)]), ["doc"], width)) == [(5, 10)]
        assert plain(ranges.intersect_ranges(ranged(spark, [(0, 5)]), ranged(spark, [(5, 9)]), ["doc"], width)) == [(5, 5)]
    minus = lambda r, s, e: plain(ranges.subtract_range(ranged(spark, [r]), F.lit(s), F.lit(e)))
    assert minus((0, 10), 3, 7) == [(0, 3), (7, 10)]
    assert minus((0, 10), 10, 12) == [(0, 10)] and minus((0, 10), 0, 10) == [] and minus((0, 10), 5, 20) == [(0, 5)]
    row = ranges.range_scores(ranged(spark, [(0, 10)]), ranged(spark, [(5, 15)]), ["doc"]).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5) and row.iou == pytest.approx(1 / 3)


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " a b c d e f g h i j "), (2, "a b c d"), (3, ""), (4, None), (5, " \n")], "doc_id long, text string")
    got = {(r.doc_id, r.start_token, r.end_token, r.content) for r in chunking.token_chunks(df, 4, 2).collect()}
    assert got == {(1, 0, 4, "a b c d"), (1, 2, 6, "c d e f"), (1, 4, 8, "e f g h"), (1, 6, 10, "g h i j"), (2, 0, 4, "a b c d")}
    with pytest.raises(ValueError):
        chunking.token_chunks(df, 4, 4)


def test_chunks_stand_where_they_say(spark):
    rng = random.Random(1)
    doc = "\n\n".join(". ".join(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))) for _ in range(12))
    for pieces in (chunking.window_pieces(doc, 40, 10), chunking.recursive_pieces(doc, 40, 10), chunking.recursive_pieces(doc, 30, 0, chunking.LANGUAGES["markdown"], True)):
        found = list(pieces)
        assert found and all(doc[a:b] == content for content, a, b in found)
        covered = set()
        for _, a, b in found:
            covered |= set(range(a, b))
        assert all(i in covered for i, c in enumerate(doc) if not c.isspace())
    assert all(len(c.split()) <= 40 for c, _, _ in chunking.recursive_pieces(doc, 40, 10))
    for pieces in (chunking.cluster_pieces(doc, 200), chunking.semantic_pieces(doc, 200)):
        assert "".join("".join(c.split()) for c, _, _ in pieces) == "".join(doc.split())
    df = spark.createDataFrame([(1, doc), (2, None), (3, " ")], "doc_id long, text string")
    for kind in ("token", "recursive", "cluster", "semantic"):
        assert {r.doc_id for r in chunking.chunk(df, kind, 60, 10).collect()} == {1}
    with pytest.raises(ValueError):
        chunking.chunk(df, "sentence")


def test_runs_never_pass_the_cap():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(7, 3))
    sizes = [3, 1, 4, 1, 5, 2, 6]

    def divisions(n):
        return [[]] if n == 0 else [d + [(k, n)] for k in range(n) for d in divisions(k)]

    mean = np.mean([v[i] @ v[j] for i in range(7) for j in range(i)])
    assert np.isclose(chunking.mean_similarity(v), mean)
    value = lambda d, bonus: sum(sum(v[i] @ v[j] - mean for i in range(a, b) for j in range(a, b) if i != j) + bonus * np.log(b - a) for a, b in d)
    for most, budget, bonus in ((2, None, 0.0), (3, None, 0.2), (7, 6, 0.2), (7, 1, 0.0)):
        got = chunking.segments(v, most, sizes, budget, bonus)
        fits = [d for d in divisions(7) if all(b - a <= most and (budget is None or b - a == 1 or sum(sizes[a:b]) <= budget) for a, b in d)]
        assert got in fits and np.isclose(value(got, bonus), max(value(d, bonus) for d in fits))


def test_locate(spark):
    doc = "The quick  brown fox\njumps over the lazy dog. Another sentence here."
    for part, want in (("brown fox", "brown fox"), ("quick brown fox jumps", "quick  brown fox\njumps"), ("THE LAZY DOG", "the lazy dog"), ("jumps ovr the lazy dog", "jumps over the lazy do")):
        a, b = chunking.locate(doc, part)
        assert doc[a:b] == want
    assert chunking.locate(doc, "nothing of the kind anywhere") is None and chunking.locate(doc, " ") is None and chunking.locate(None, "a") is None
    marked = "a state @-@ of @-@ the art , 3 @.@ 5 m wide"
    a, b = chunking.locate(marked, "state-of-the art, 3.5 m")
    assert marked[a:b] == "state @-@ of @-@ the art , 3 @.@ 5 m"
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    text, part = " ".join(words), " ".join(words[30:70])
    at = text.index(part)
    head = part[:60] + part[60:].replace("a", "b", 9)
    assert chunking._by_head(text, head)[0] == at
    assert chunking._by_sentence("One. " + part + ". Two.", part[:-9]) == (5, 5 + len(part))
    broken = "zzzzz " * 6 + part[36:]
    a, b = chunking._by_pieces(text, broken)
    assert abs(a - at) <= 2 and b - a == len(broken)
    rows = spark.createDataFrame([(1, doc, "brown fox"), (2, doc, "zebra zoo"), (3, None, "x")], "id int, t string, p string")
    assert {r.id: (r.start, r.end) for r in chunking.located(rows, "t", "p").collect()} == {1: (11, 20), 2: (None, None), 3: (None, None)}


def test_budget_batches_and_adaptive_k(spark):
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate((5, 4, 3))], "q string, n int, tokens int")
    assert search.within_budget(df, ["q"], [F.col("n")], "tokens", 9).count() == 2
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate((6, 3, 2, 9, 30, 1))], "q string, n int, tokens int")
    got = sorted((r.n, r.batch_no) for r in search.greedy_batches(df, ["q"], "n", "tokens", 9).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    ks = spark.createDataFrame([(n,) for n in range(1, 6)], "n int").select(search.adaptive_k(F.col("n")).alias("k")).collect()
    assert [r.k for r in ks] == [5, 5, 2, 3, 2]


def test_fusion(spark):
    sem = spark.createDataFrame([(1, 7, 1)], "query_id int, doc_id int, rank int")
    key = spark.createDataFrame([], "query_id int, doc_id int, rank int")
    assert search.reciprocal_rank_fusion(sem, key).first().score == 1 / 61 + 1 / 181


def test_search_edges(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(1, 1), (1, 6), (2, 2), (2, 5), (5, 5), (5, 1), (6, 1), (6, 6)}
    found = lambda: {(r.query_id, r.vec_id) for r in search.semantic_search(corpus, asked, 2).collect()}
    assert found() == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert found() == want
    monkeypatch.setattr(search, "CORPUS_BLOCK", 2)
    assert found() == want
    assert search.semantic_search(corpus, asked, None).count() == 16
    monkeypatch.undo()
    assert search.semantic_search(corpus, asked.limit(0), 2).count() == 0
    assert search.semantic_search(corpus, asked, None).count() == 16
    assert search.semantic_search(corpus, asked, None, least=0.9).count() == 6


def test_search_keeps_the_best_of_many_batches(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 4)).round(1)
    v[1::3] = v[0]  # a tie of many rows
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    asked = corpus.where("vec_id in (0, 5, 9)").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = search.semantic_search(corpus, asked, 7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for q in (0, 5, 9):
        s = (unit @ unit[q]).round(12)
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(3000), -s))[:7].tolist()


def test_keyword_search_by_cover(spark):
    docs = spark.createDataFrame([(1, "red car and a blue car"), (2, "car red"), (3, "red red"), (4, None), (5, "Red! car"), (6, "red x y z car red")], "doc_id long, text string")
    asked = search.query_terms(spark.createDataFrame([(1, "red CAR"), (2, "red"), (3, "nowhere red"), (4, "")], "query_id long, text string"))
    got = search.keyword_search(search.term_index(docs), asked, None).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 6), (1, 2, 1), (1, 3, 2), (1, 4, 5), (2, 1, 3), (2, 2, 6), (2, 3, 1), (2, 4, 2), (2, 5, 5)]
    rng = random.Random(12)
    rows = [(i, [rng.choice("abcdx") for _ in range(rng.randrange(1, 40))]) for i in range(60)]
    df = spark.createDataFrame([(i, w, list("abc")) for i, w in rows], "i int, terms array<string>, wanted array<string>")
    for r in df.where("array_contains(terms, 'a') and array_contains(terms, 'b') and array_contains(terms, 'c')").select("i", search.cover_density("wanted", "terms").alias("c")).collect():
        places = {}
        for at, w in enumerate(dict(rows)[r.i]):
            places.setdefault(w, []).append(at)
        assert r.c == pytest.approx(similarity.cover_density("abc", places))


def test_keyword_search_leaves_the_index_in_place(spark, monkeypatch):
    """Few hits come to the index, which is not dealt out; many meet it by id, with the same result."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} x{i % 5} y{i % 3}") for i in range(200)] + [(500, None)], "doc_id long, text string")
    asked = search.query_terms(spark.createDataFrame([(1, "common w3 x2 y1"), (2, "w1"), (3, "common"), (4, "w1 w2"), (5, "nowhere")], "query_id long, text string"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.cover) for r in df.collect())
    found = search.keyword_search(search.term_index(docs), asked, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = rows(found)
    assert {(q, d) for q, _, d, _ in got} == {(1, i) for i in range(200) if (i % 7, i % 5, i % 3) == (3, 2, 1)} | {(2, i) for i in range(1, 200, 7)} | {(3, i) for i in range(200)}
    monkeypatch.setattr(search, "BROADCAST_HITS", 0)
    monkeypatch.setattr(search, "PROBED", 1)
    assert rows(search.keyword_search(search.term_index(docs), asked, None)) == got


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "[0.1, 2]", "x")], "a array<float>, z array<float>, t string, bad string").select(
        vectors.normalize(F.col("a")).alias("n"), vectors.normalize(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.parse(F.col("t")).alias("p"), vectors.parse(F.col("bad")).alias("b"), vectors.render(F.col("a")).alias("r")
    ).first()
    assert (list(row.n), list(row.z), row.c, list(row.p), row.b, row.r) == ([0.6, 0.8], [0.0, 0.0], None, [0.1, 2.0], None, "[3.000000,4.000000]")
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (-0.3,)], "c double").select(vectors.weight_bucket(F.col("c")).alias("w")).collect()
    assert [r.w for r in got] == [1, 5, 10, -2]


def test_text_parsers(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert [tuple(r) for r in one("A | b | c | d\r\na|b|c\n a||c|d\n\n x|Y|z|W ", text.triplets)] == [("a", "b", "c", "d"), ("x", "y", "z", "w")]
    assert list(one(" \"Ada\" , 'Bob',, ", text.entity_names)) == ["ada", "bob"]
    assert tuple(one("Decision: YES\nResolved Name: N/A\nDecision: no\nConfidence: high\nReasoning: same", text.merge_decision)) == (False, "", "HIGH", "same")
    assert tuple(one("nothing said", text.merge_decision)) == (False, "", "LOW", "")
    assert one("\n a\t b @-@ c x @,@ y @.@ z <unk> “q” ’", text.normalize_text) == "a b - c x, y. z  \"q\" '"
    no = ["2023", "$10 million", "16:9", "10km", "May 2022", "  ", None, "3 bears", "25 percent", "3 hrs", "10 min", "12 oz", "5 gal", "5k", "2 b", "january 2022 report", "\t7 "]
    yes = ["barack obama", "april", "june", "may", "jan", "route 66", "7 seas", "$ sign"]
    got = spark.createDataFrame([(n,) for n in no + yes], "n string").select(text.mergeable(F.col("n")).alias("m")).collect()
    assert [r.m for r in got] == [False] * len(no) + [True] * len(yes)


def test_similarities():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs_length(a, b) == table[-1][-1]
    assert similarity.indel_ratio("", "") == 100 and similarity.indel_ratio("abcd", "abxd") == 75
    assert similarity.cover_density(["a", "b"], {"a": [0, 9], "b": [1, 12]}) == pytest.approx(1 + 1 / 8 + 1 / 3)
    assert similarity.cover_density(["a"], {"a": [1, 5, 7]}) == 3 and similarity.cover_density(["a", "b"], {"a": [1]}) == 0


def test_tables(spark):
    known = spark.createDataFrame([(4, "a"), (9, "b")], "entity_id long, entity_name string")
    new = spark.createDataFrame([("b",), ("d",), ("c",), ("d",), (None,)], "entity_name string")
    assert sorted(map(tuple, tables.upsert_names(known, new).collect())) == [(4, "a"), (9, "b"), (10, "c"), (11, "d")]
    first = tables.first_seen([known.select("entity_name", F.lit(1).alias("x")), new.dropna().select("entity_name", F.lit(2).alias("x"))], "entity_name")
    assert {tuple(r) for r in first.collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}
    assert tables.delete_where(known, F.col("entity_id") > 5).count() == 1 and tables.truncated(known).count() == 0
    assert tables.sampled(known, 1, "entity_id").collect() == tables.sampled(known.repartition(3), 1, "entity_id").collect()
    ids = tables.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7), ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in ids)


def test_prefix_sums(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s string, x int").repartition(5)
    got = {r.i: (r.before, r.n) for r in tables.prefix_sums(df, [F.col("s").isNull(), F.col("s"), F.col("i")], {"before": F.col("x"), "n": F.lit(1)}).collect()}
    total = 0
    for n, (i, _, x) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))):
        assert got[i] == (total, n)
        total += x
    assert tables.prefix_sums(df.limit(0), [F.col("i")], {"n": F.lit(1)}).count() == 0


def test_all_pairs_blocks_and_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 5)))] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted((r.u, r.v, round(r.sim, 9)) for r in pairs.all_pairs(df, 0.5).collect())
    assert one == sorted((r.u, r.v, round(r.sim, 9)) for r in pairs.all_pairs(df, 0.5, block=9).collect())
    near = {(r.u, r.v) for r in pairs.all_pairs_hashed(df, 0.8).collect()}
    want = {(u, v) for u, v, s in one if s >= 0.8}
    assert near <= want and len(near) >= 0.9 * len(want)
    v = np.array([r[1] for r in rows[:60]])
    sims = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    near = np.argsort(-sims, axis=1)[:, :3]
    assert {(r.u, r.v) for r in pairs.all_pairs(df, 0.0, 3, block=9).collect()} == {(u, int(v)) for u in range(60) for v in near[u] if u < v and sims[u, v] >= 0}


def test_hashed_pairs_by_blocks(spark):
    """Buckets are compared as matrices of bounded size, and each pair comes once."""
    rng = np.random.default_rng(4)
    rows = [(f"n{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 5)))] + [("none", None), ("zero", [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    found = pairs.all_pairs_hashed(df, 0.7)
    assert not any(join in found._jdf.queryExecution().executedPlan().toString() for join in ("SortMergeJoin", "ShuffledHashJoin"))
    one = [(r.u, r.v, round(r.sim, 9)) for r in found.collect()]
    assert len(one) == len({x[:2] for x in one}) > 50
    assert sorted(one) == sorted((r.u, r.v, round(r.sim, 9)) for r in pairs.all_pairs_hashed(df, 0.7, block=4).collect())


def test_cosines_of_relations_by_blocks(spark, monkeypatch):
    """Relations meet vectors without carrying them, and the result is that of joins."""
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)] + [(40, [0.0] * 3), (41, [1.0]), (42, None), (43, [2.0])], "entity_id long, embedding array<float>")
    ends = [(int(a), int(b)) for a, b in rng.integers(0, 32, (200, 2))] + [(40, 1), (41, 43), (41, 2), (42, 1), (5, 5), (None, 3)]
    rel = spark.createDataFrame([(i, a, b, 3 if i % 9 == 0 else None) for i, (a, b) in enumerate(ends)], "rel_id long, from_entity int, to_entity int, weight int")
    of = lambda c, v: e.select(F.col("entity_id").alias(c), F.col("embedding").alias(v))
    joined = rel.join(of("from_entity", "a"), "from_entity", "left").join(of("to_entity", "b"), "to_entity", "left")
    want = {r.rel_id: r.c for r in joined.select("rel_id", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    for block in (1_000, 4):
        got = {r.rel_id: r.c for r in pairs.with_cosines(rel, e, "c", block=block).collect()}
        assert got.keys() == want.keys()
        assert all(want[k] is None if c is None else c == pytest.approx(want[k], abs=1e-12) for k, c in got.items())
        assert {r.rel_id for r in pairs.with_cosines(rel, e, "c", inner=True, block=block).collect()} == {k for k, (a, b) in enumerate(ends) if {a, b} <= {*range(30), 40, 41, 42, 43}}
    rows = {r.rel_id: r.weight for r in graph.relation_weights(rel, e).collect()}
    assert rows == {k: 3 if k % 9 == 0 else None if c is None else 10 if ends[k][0] == ends[k][1] else 1 + math.floor(9 * c) for k, c in want.items()}  # equal vectors have exactly 1
    assert "Join" not in graph.relation_weights(rel, e)._jdf.queryExecution().executedPlan().toString()


def test_khop_and_deepening(spark):
    path = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "x", "y")], "rel_id int, from_entity string, to_entity string")
    seed = spark.createDataFrame([("a",)], "node string")
    for depth, want in ((1, {1}), (2, {1, 2}), (3, {1, 2, 3}), (4, {1, 2, 3})):
        assert {r.rel_id for r in graph.khop_edges(path, seed, depth).collect()} == want
    found, depth = graph.deepen(path, seed, lambda edges, d: edges.count() >= 2)
    assert depth == 2 and found.count() == 2


def test_refined_groups(spark):
    members = spark.createDataFrame([(n, c) for c, ns in ((1, (1, 2, 3)), (10, (10, 11, 12, 13)), (20, (20, 21))) for n in ns], "node long, component long")
    names = spark.createDataFrame([(1, "acme corporation"), (2, "acme corporatlon"), (3, "zebra"), (10, "north steel"), (11, "north steels"), (12, "upper foods"), (13, "upper foodss"), (20, "a"), (21, "zzz")], "entity_id long, entity_name string")
    got = {}
    for r in graph.refined_groups(members, names).collect():
        got.setdefault((r.component, r.subgroup), set()).add(r.node)
    assert got == {(1, 1): {1, 2, 3}, (10, 10): {10, 11}, (10, 12): {12, 13}, (20, 20): {20, 21}}


def test_large_groups_are_compared_by_blocks(spark):
    rng = random.Random(21)
    stem = ["north steel works", "upper food market", "zebra glass house"]
    rows = [(f"n{i:03}", "c", stem[i % 3][: rng.randrange(15, 18)] + rng.choice(["", "s"])) for i in range(90)] + [("n999", "c", "alone")]
    names = spark.createDataFrame(rows, "node string, component string, name string")
    for block in (8, 512):
        parts = {r.node: r.component for r in graph.connected_components(graph.alike_names(names, 90.0, block), "u", "v").collect()}
        assert parts == {n: f"n{int(n[1:]) % 3:03}" for n, _, _ in rows[:90]}


def test_resolution_of_text_ids(spark):
    pairs_ = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.93), ("d", "e", 0.99), ("f", "g", 0.97), ("h", "i", 0.2), ("j", "k", 0.96), ("x", "y", 0.99)], "u string, v string, sim double")
    names = spark.createDataFrame([("a", "acme corp"), ("b", "acme corps"), ("c", "acme corpse"), ("d", "2021"), ("e", "2022"), ("f", "oak"), ("g", "oaks"), ("j", "ash"), ("k", "elm")], "entity_id string, entity_name string")
    groups, members = graph.entity_groups(pairs_, 0.9, names)
    assert {(r.component, r.size, r.representative) for r in groups.collect()} == {("a", 3, "b"), ("f", 2, "f"), ("j", 2, "j")}
    assert graph.group_summary(groups).first().members == 7 and members.count() == 7
    decide = lambda n: F.when(F.array_contains(n, "oak"), "Decision: NO").when(F.array_contains(n, "acme corp"), "Decision: YES\nResolved Name: Acme\nConfidence: high")
    got = graph.resolved_entities(pairs_, names, decide)
    assert {tuple(r) for r in got.select("node", "representative", "resolved_name", "label").collect()} == {("a", "b", "Acme", "HIGH"), ("b", "b", "Acme", "HIGH"), ("c", "b", "Acme", "HIGH"), ("f", "f", None, None), ("g", "g", None, None), ("j", "j", None, None), ("k", "j", None, None)}
    assert {r.node: round(r.confidence, 3) for r in got.collect()} == {"a": 0.94, "b": 0.94, "c": 0.94, "f": 0.0, "g": 0.0, "j": 0.96, "k": 0.96}
    assert [tuple(r) for r in graph.decision_counts(got).collect()] == [("HIGH", 1)]
    kept = {tuple(r) for r in graph.merged_entities(names, got).collect()}
    assert kept == {("b", "Acme"), ("d", "2021"), ("e", "2022"), ("f", "oak"), ("g", "oaks"), ("j", "ash")}
    rel = spark.createDataFrame([(1, "a", "f", 2, "one"), (2, "c", "f", 9, "two"), (3, "a", "b", 1, "loop"), (4, "f", "zz", None, "far")], "rel_id int, from_entity string, to_entity string, weight int, line string")
    assert {tuple(r) for r in graph.apply_merges(rel, got).collect()} == {("b", "f", 1, 9, "one"), ("f", "zz", 4, None, "far")}
    links = spark.createDataFrame([("a", 1), ("c", 1), ("g", 2)], "entity_id string, document_id int")
    assert {tuple(r) for r in graph.merged_links(links, got, "entity_id", "document_id").collect()} == {("b", 1), ("g", 2)}
    lone = spark.createDataFrame([("p", "q", "p", 0.9), ("p", "p", "p", 0.9)], "group string, node string, representative string, confidence double")
    assert [r.representative for r in graph.validated_groups(lone, names, lambda n: F.lit("Decision: NO")).collect()] == ["p", "p"]  # no names, not asked


def test_graph_is_built_and_asked(spark):
    chunks = spark.createDataFrame([(1, 10, "a|b|is|of\nb|c|x|y"), (2, 10, "b|a|z|z\nnone"), (3, 11, None)], "chunk_id long, document_id long, content string")
    known = spark.createDataFrame([(7, "b")], "entity_id long, entity_name string")
    made = graph.built_graph(chunks, lambda c: c, known)
    assert {tuple(r) for r in made["entities"].collect()} == {(7, "b"), (8, "a"), (9, "c")}
    assert sorted(tuple(r) for r in made["relations"].collect()) == [(7, 8, "z", "z", 2, 10), (7, 9, "x", "y", 1, 10), (8, 7, "is", "of", 1, 10)]
    assert made["entity_chunks"].count() == 5 and made["entity_documents"].count() == 3
    assert tuple(graph.graph_counts(made["entities"], made["relations"]).first()) == (3, 3)
    rel = spark.createDataFrame([(1, "a", "b", 3, [1.0, 0.0]), (2, "b", "c", 4, [0.0, 1.0]), (3, "c", "d", 2, [1.0, 1.0]), (4, "x", "y", 1, None)], "rel_id int, from_entity string, to_entity string, tokens int, embedding array<double>")
    seed = spark.createDataFrame([("a",)], "node string")
    asked = []
    got = graph.graph_retrieval(rel, seed, [1.0, 0.2], 5, lambda context: asked.append(context.count()) or len(asked) == 3)
    assert asked == [1, 1, 2] and [(r.rel_id, r["rank"], r.running_tokens, r.depth) for r in got.orderBy("rank").collect()] == [(1, 1, 3, 3), (3, 2, 5, 3)]


def test_communities_without_edges_and_summaries(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    none = spark.createDataFrame([], "u string, v string, weight double")
    assert {(r.node, r.level, r.parent) for r in graph.communities(none, nodes=nodes).collect()} == {("a", 0, None), ("b", 0, None)}
    context = spark.createDataFrame([(1, False, "x"), (2, True, "y"), (3, False, "bad")], "community_id int, too_long boolean, context string")
    got = graph.summarised_communities(context, lambda c: F.when(c != "bad", F.upper(c)))
    assert [(r.community_id, r.summary) for r in got.collect()] == [(1, "X")]


def test_context_is_made_of_pieces(spark, monkeypatch):
    rows = [(r, 1, 2, 3, f"line {r}" if r % 5 else None) for r in range(40, 0, -1)] + [(7, 1, 2, None, "again"), (99, 5, 6, 1, None)]
    rel = spark.createDataFrame(rows, "rel_id long, from_entity long, to_entity long, tokens int, line string")
    members = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (5, 6), (8, 8)], "community_id long, node long")
    lines = sorted((r, x) for r, _, _, _, x in rows if x and r != 99)
    want = {1: (41, 120, True, "- " + "\n- ".join(x for _, x in lines)), 5: (1, 1, False, "- "), 8: (0, 0, False, graph.NO_EDGES)}
    found = lambda: {r.community_id: (r.n_edges, r.tokens, r.too_long, r.context) for r in graph.community_context(members, rel, 60).collect()}
    assert found() == want
    monkeypatch.setattr(graph, "PIECE", 20)
    assert found() == want


def test_leiden_invariants():
    rng = random.Random(5)
    edges = [(g * 20 + a, g * 20 + b, 1.0) for g in range(4) for a in range(20) for b in range(a) if rng.random() < 0.5] + [(0, 20, 1.0), (20, 40, 1.0), (40, 60, 1.0)]
    rows = leiden.hierarchy(edges, 10)
    assert rows == leiden.hierarchy(edges, 10)
    top = {}
    for node, level, cluster, parent in rows:
        if level == 0:
            top.setdefault(cluster, set()).add(node)
            assert parent is None
    assert sorted(map(min, top.values())) == [0, 20, 40, 60] and sum(map(len, top.values())) == 80
    of = {(level, node): cluster for node, level, cluster, _ in rows}
    assert all(of[level - 1, node] == parent for node, level, _, parent in rows if level)


def test_leiden_holds_links_as_arrays(monkeypatch):
    """Peak memory is a small multiple of the edges' arrays, and how sums are made changes nothing."""
    rng = np.random.default_rng(3)
    a, b = np.nonzero(np.triu(rng.random((700, 700)) < 0.4, 1))
    w = rng.random(len(a))
    monkeypatch.setattr(leiden, "FOLDED", 10_000)
    tracemalloc.start()
    whole = [(m.tolist(), *x) for m, *x in leiden.divided(a, b, w, 10, 1, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(a)
    monkeypatch.setattr(leiden, "FEW", 2)
    monkeypatch.setattr(leiden, "FOLDED", 4_000_000)
    assert whole == [(m.tolist(), *x) for m, *x in leiden.divided(a, b, w, 10, 1, 0)]


def test_relevance_and_metrics(spark):
    df = spark.createDataFrame([("b c", "a B c d"), ("b x", "a b c"), (None, "a")], "c string, d string")
    assert [r.relevant for r in evaluation.relevance(df, "c", "d").collect()] == [1, 0, 0]
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, doc_id int, rank int")
    truth = spark.createDataFrame([(1, 5), (1, 7)], "query_id int, doc_id int")
    rows = {(r.query_id, r.k): (r.precision, r.recall) for r in evaluation.precision_recall(asked, hits, truth, (1, 5)).collect()}
    assert rows == {(1, 1): (1.0, 0.5), (1, 5): (0.4, 1.0), (2, 1): (0.0, 0.0), (2, 5): (0.0, 0.0)}
    one = {r.query_id: (r.mrr, r.ap, r.hit) for r in evaluation.ranking_metrics(asked, hits, truth).collect()}
    assert one == {1: (1.0, pytest.approx((1 + 2 / 3) / 2), 1), 2: (0.0, 0.0, 0)}


def test_metrics_by_label_make_no_pairs(spark):
    items = spark.createDataFrame([(i, i % 3 if i < 9 else None) for i in range(11)] + [(20, 7)], "doc_id int, label int")
    asked = items.where("doc_id in (0, 4, 9, 20)").select(F.col("doc_id").alias("query_id"), "label")
    hits = spark.createDataFrame([(0, 3, 1), (0, 0, 2), (0, 1, 3), (4, 1, 2), (4, 7, 1), (9, 10, 1)], "query_id int, doc_id int, rank int")
    want = asked.join(items, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    rows = lambda df: sorted((r.query_id, r.k, r.precision, r.recall, r.f1) for r in df.collect())
    assert rows(evaluation.label_precision_recall(asked, hits, items, (1, 3))) == rows(evaluation.precision_recall(asked, hits, want, (1, 3)))


def test_lenient_relevance(spark):
    df = spark.createDataFrame([("a b x", "a b c d e f"), ("a y", "a b c d e f"), ("b c", "a b c d"), (None, "a")], "c string, d string")
    assert [(round(r.overlap, 3), r.relevant) for r in evaluation.lenient_relevance(df, "c", "d").collect()] == [(0.333, 1), (0.167, 0), (1.0, 1), (0.0, 0)]


def test_document_and_chunk_sinks(spark, tmp_path):
    new = spark.createDataFrame([("b", "x"), ("a", "y")], "path string, content string")
    got = files.write_documents(new, str(tmp_path / "d"))
    assert {(r.document_id, r.path) for r in got.collect()} == {(1, "a"), (2, "b")}
    again = files.write_documents(spark.createDataFrame([("c", "z")], "path string, content string"), str(tmp_path / "d"), 3)
    assert {(r.document_id, r.path) for r in again.collect()} == {(3, "c")}
    rows = spark.createDataFrame([(1, "t", 2, "token", 0, 4)], "document_id long, content string, tokens int, type string, start int, end int")
    files.write_chunks(rows, str(tmp_path / "c"))
    files.write_chunks(rows, str(tmp_path / "five"), positioned=False)
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["document_id", "content", "tokens", "is_processed", "start", "end", "type"]
    assert len(spark.read.parquet(str(tmp_path / "five")).columns) == 5


def test_intermediate_tables(spark, monkeypatch):
    from tessellon import session

    df, path = session.written(spark.range(3), "test")
    scratch = [path]
    assert df.count() == 3 and path.startswith(session.own_dir(spark))
    session.dropped(spark, scratch)
    assert not scratch and not spark._jvm.java.io.File(path.removeprefix("file://")).exists()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_sources(spark, tmp_path):
    (tmp_path / "corpora").mkdir()
    (tmp_path / "corpora" / "one two.md").write_text("# T\n\nbody")
    got = files.read_corpus(spark, str(tmp_path / "corpora")).first()
    assert (got.corpus_id, got.content) == ("one two", "# T\n\nbody")
    (tmp_path / "q.csv").write_text('question,references,corpus_id\n"what, now","[{""content"": ""x"", ""start_index"": 1, ""end_index"": 2}]",c\n')
    row = files.read_questions(spark, str(tmp_path / "q.csv")).first()
    assert row.question == "what, now" and row.references[0].end_index == 2
    assert files.read_questions(spark, str(tmp_path / "none.csv")).count() == 0
    assert files.html_to_text("<p>a&amp;b</p><script>x</script><div>c <b>d</b></div>") == "a&b\nc d"
    files.write_report(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    names = generators.synthetic_entities(spark, 2000)
    assert names.select("entity_name").distinct().count() == 2000
    assert generators.similar_entities(spark, 150).groupBy("family").count().where("count = 10").count() == 15


def test_embedding(spark):
    v = embedding.hash_embed(["a b", "", "a b"])
    assert np.allclose(v[0], v[2]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any()
    df = spark.createDataFrame([(1, "x y", None), (2, "z", [1.0]), (3, None, None)], "id int, t string, v array<double>")
    got = {r.id: r.v for r in embedding.embed_missing(df, "t", "v").collect()}
    assert len(got[1]) == 256 and got[2] == [1.0] and got[3] is None


def test_streaming_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d e f g h i " * i) for i in range(12)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest_chunks(ingest.arriving_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 4, 2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = chunking.token_chunks(docs, 4, 2)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
