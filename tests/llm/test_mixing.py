import collections
import re

import duckdb
import pytest

from tessellon.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"a": 0, "b": 0}, {"é": 5, "z": 5, "A": 5, "b": 500, "": 3, None: 1}, {f"s{i}": i * i for i in range(40)}])
def test_targets_equal_the_loop(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_rows_copies_and_targets(spark):
    rows = [(i, " ".join("w" * (1 + i % 9) for _ in range(1 + i % 40)), f"s{i % 5}" if i % 6 else None, 1) for i in range(3_000)] + [(None, "a b", "s1", 1), (7, None, "s1", 1), (8, "", "s2", 1), (8, "", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    of = {(i, s): s for i, _, s, _ in rows}
    by_key = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, s, _ in rows}
    for r in got:
        s = by_key[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = plain_targets(sizes)
    assert of and all(abs(taken[s] - want[s]) < 0.15 * sizes[s] for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({k: n for k, n in sum((collections.Counter({r.doc_id: r.copies}) for r in got), collections.Counter()).items() if n})
    assert mixing.mix(df.limit(0)).count() == mixing.mixed_rows(df.limit(0)).count() == 0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, "a b c", f"s{i % 50}") for i in range(200)] + [(999, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix(df).collect())) == want


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want
