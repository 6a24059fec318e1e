import random

import pytest

from tessellon.operators import components
from tessellon.operators.components import connected_components


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_components_equal_union_find(spark, monkeypatch, broadcast):
    monkeypatch.setattr(components, "BROADCAST", broadcast)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    df = spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    want = {k: v for k, v in union_find(edges).items()}
    loops = {k for k in want if all(a == b for a, b in edges if k in (a, b))}
    assert got == {k: v for k, v in want.items() if k not in loops}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
