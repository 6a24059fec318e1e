import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessellon.llm import fm, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = fm.Machine({}, 0.3, rng.normal(size=20), rng.normal(size=(20, 4)) * 0.3)
    sets = [[], [3], [0, 5, 7], list(range(20))]
    want = [0.3 + sum(machine.weights[i] for i in s) + sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(s, 2)) for s in sets]
    assert np.allclose(machine.scores(sets), 1 / (1 + np.exp(-np.array(want))))


def test_pairs_are_learned_that_no_weights_express():
    rng = random.Random(2)
    sets, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        names = [*(["left"] * a), *(["right"] * b), *rng.choices([f"n{i}" for i in range(30)], k=5)]
        sets.append(np.frombuffer(fm.packed(names), "<u4"))
        labels.append(int(a and b))
    machine = fm.trained(sets, labels, [1.0] * 600, sorted({int(b) for s in sets for b in s}))
    one, other, both = (float(machine.scores([machine.rows_of(x)])[0]) for x in (["left"], ["right"], ["left", "right"]))
    assert one < 0.2 and other < 0.2 and both > 0.8
    assert np.abs(machine.vectors).max() > 0.1


def test_one_label_or_none():
    assert fm.trained([], [], [], []).scores([[], []]).tolist() == [0.5, 0.5]
    assert fm.trained([np.array([1], "<u4")] * 4, [1] * 4, [1.0] * 4, []).scores([[]])[0] > 0.9


def test_features_are_those_of_the_largest_chi_square(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        y = int(i % 3 == 0)
        own = {int(b) for b in rng.integers(0, 60, 12)} | ({100} if y else set()) | ({101} if y and i % 2 else set()) | ({102} if not y else set())
        rows.append((y, np.array(sorted(own), "<u4").tobytes()))
    df = spark.createDataFrame([(y, bytearray(b)) for y, b in rows], "__y int, buckets binary").repartition(5)
    total, ones = len(rows), sum(y for y, _ in rows)
    chi = {}
    for b in range(110):
        n = sum(b in np.frombuffer(raw, "<u4") for _, raw in rows)
        o = sum(b in np.frombuffer(raw, "<u4") for y, raw in rows if y)
        if n >= fm.LEAST_ROWS and (c := total * (o * total - n * ones) ** 2 / max(n * (total - n) * ones * (total - ones), 1)) >= fm.LEAST_CHI:
            chi[b] = c
    assert fm.associated(df) == sorted(chi, key=lambda b: (-chi[b], b)) and {100, 101, 102} <= set(chi)
    assert fm.associated(df, 2) == sorted(chi, key=lambda b: (-chi[b], b))[:2]
    assert fm.associated(df.where("__y = 1")) == fm.associated(df.limit(0)) == []


def held_out(spark, query, label, parts, held):
    got = query(spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    return [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark):
    pairs = held_out(spark, queries.op4_quality, "quality", 3, 1)
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95


def test_toxicity_held_out(spark):
    pairs = held_out(spark, queries.op6_toxicity, "toxic", 5, 0)
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.93
    assert all(b == 0 for a, b in pairs if a == 0)


def test_toxicity_recall_with_the_bounded_sample(spark):
    """On the larger check table the sample is at its bound; the held-out fold there has not been looked into."""
    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.learn(docs, labels, fm.remainder(F.col("doc_id"), 5) != 0)
    held = labels.where((fm.remainder(F.col("doc_id"), 5) == 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic").distinct()
    got = toxicity.score(docs.join(F.broadcast(held.select("doc_id")), "doc_id", "left_semi"), machine).join(held, "doc_id").select("toxic", (F.col("score") >= 0.5).alias("said")).collect()
    toxic = [r.said for r in got if r.toxic]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) > 0.9
    assert sum(r.said for r in got if not r.toxic) / len(got) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, "x", 1.0), (2, "", "y", 2.0), (None, "word " * 100_000, None, None), (3, "you fool", "z", 0.0), (3, "you fool", "z", 0.0), (4, "calm", "z", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, None, 0), (None, 1, 1), (1, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (quality, toxicity):
        machine = model.learn(docs, labels, fm.remainder(F.col("doc_id"), 3) != 7)
        assert model.score(docs, machine).count() == len(rows)
        assert model.score(docs.limit(0), machine).count() == 0
