import random

import numpy as np
import pytest

import corpus_pipeline
from tessellon.llm import shingles


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept(rows):
    sets = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def corpus(seed):
    """Edited copies around the least similarity, one large group of them, and texts of little but a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randrange(30, 200))] for _ in range(15)]
    texts = [None, "", "One", "one", "one two"]
    for i in range(150):
        words = list(bases[0] if i % 2 else rng.choice(bases))
        for _ in range(rng.randrange(1 + len(words) // 30)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(16))]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [2, 16, 10_000])
def test_groups_equal_brute_force(spark, crowd):
    rows = corpus(crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.deduplicated(df, crowd=crowd).collect()) == kept(rows)


def test_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CELL", 5_000)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.deduplicated(df, crowd=2).collect()) == kept(rows)


def test_stage_drops_planted_edited_copies(spark):
    """One changed word in 100 changes 5 of 96 shingles: similarity 0.9, in general more than 4 bits."""
    rng = random.Random(1)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t[:50], "changed", *t[51:]])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == list(range(30))


def test_a_pair_just_at_the_least_similarity():
    assert shingles.similar(80, 90, 90) and not shingles.similar(79, 90, 89)
    assert len(shingles.head(np.arange(10))) == 3 and len(shingles.head(np.arange(0))) == 0
