import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellon.llm import near_copies, shingles, simhash
from tessellon.session import own_dir
from tests.llm.test_shingles import corpus, plain


def kept(rows):
    """Brute force: the distance of fingerprints and the similarity of sets of every pair."""
    sets, prints = [plain(t) for _, t in rows], [simhash.fingerprint(t, near_copies.PAIR) & (2**64 - 1) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near_copies.DISTANCE and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


@pytest.mark.parametrize("cell", [shingles.CELL, 5_000])
def test_stage_links_near_fingerprints_of_similar_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(shingles, "CELL", cell)
    rows = corpus(7)
    rows += [(1_000, "a b " * 60), (1_001, "a b a b a a b b a a a b")]  # few shingles, other counts: similar sets need not be near
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == kept(rows)


def test_stage_gets_its_links_from_fingerprints(spark, monkeypatch):
    """Similar texts are linked through operator 5 alone: where it links no fingerprints, only copies fold."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text), (3, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()] == [1]
    monkeypatch.setattr(near_copies, "wide_links", lambda prints, distance: prints.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def components(prints, pairs):
    group = {p: p for p in prints}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {p: low if g == high else g for p, g in group.items()} if low != high else group
    return group


@pytest.mark.parametrize("blocks, cell", [(None, 4_096), (None, 8), (11, 4_096), (13, 8)])
def test_wide_links_connect_all_near_fingerprints(spark, blocks, cell):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 25)]
    prints = {0, -1, *base}
    for b in base + base[:1] * 80 + [0] * 40:
        prints.add(b ^ simhash._signed(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint").repartition(3)
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 10]
    found = [(r.a, r.b) for r in simhash.wide_links(df, 10, blocks, cell).collect()]
    assert components(prints, found) == components(prints, near)
    assert simhash.wide_links(df.limit(0), 10, blocks, cell).count() == 0


def test_a_dense_run_leaves_a_row_for_each_fingerprint():
    rng = np.random.default_rng(4)
    prints = np.unique((np.int64(77) ^ np.array([sum(1 << int(i) for i in rng.choice(32, 4, replace=False)) for _ in range(700)], np.int64)).view(np.uint64))
    masks = np.array(simhash.block_masks(12), np.int64).view(np.uint64)
    a, b = simhash.joined_pairs(prints, masks, 0b110000000000, 10, 2)
    assert len(a) < len(prints)
    every = [simhash.joined_pairs(prints, masks, 1 << i | 1 << j, 10, 2) for j in range(12) for i in range(j)]
    group = components(range(len(prints)), [(int(x), int(y)) for a, b in every for x, y in zip(a, b)])
    assert set(group.values()) == {0}


def test_layouts_of_more_blocks_for_more_fingerprints():
    assert [simhash.wide_layout(n, 10) for n in (0, 250_000, 3_000_000, 50_000_000)] == [12, 12, 12, 13]


def test_stage_writes_little_beside_its_rows(spark):
    """Tables of the stage hold fingerprints, not a share of every text's shingles (0.43 of this input before, in all)."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kinds = lambda: {os.path.join(d, f) for d, _, files in os.walk(own_dir(spark).removeprefix("file://")) for f in files}
    written, sizes = near_copies.written, []

    def weighed(frame, name, *scratch):
        before = kinds()
        out = written(frame, name, *scratch)
        sizes.append(sum(map(os.path.getsize, kinds() - before)))
        return out

    with pytest.MonkeyPatch.context() as patch:
        for module in (near_copies, shingles, simhash):
            patch.setattr(module, "written", weighed)
        assert corpus_pipeline.drop_near_copies(spark, df, "").count() == 400
    assert sizes and sum(sizes) < 0.1 * sum(len(t) for _, t in rows)
