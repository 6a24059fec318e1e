import numpy as np
import pyarrow as pa

from tessellon.llm import vectors


def planted(seed=1, groups=6, size=12, lone=150, dim=64):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(lone)]
    for _ in range(groups):
        base = rng.normal(size=dim)
        out += [base + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3, 0.45]) for _ in range(size)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


def brute(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if vectors.unit(v) is not None]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    return links


def components(rows, links):
    low = [i for i in range(len(rows))]
    while True:
        new = [min([low[i], *(low[j] for j in links[i])]) for i in range(len(rows))]
        if new == low:
            return [rows[i][0] for i in low]
        low = new


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("cls", "cls").repartition(3)
    return {r.vec_id: (r.n_links, r.component, r.kept) for r in vectors.near_vectors(df, **more).collect()}


def test_links_and_components_equal_brute_force(spark):
    rows = planted() + [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] + [1.0] * 63), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [1e30] * 64), (1008, [1e30] * 64)]
    links = brute(rows)
    got = found(spark, rows)
    want = {k: (len(links[i]), c, c == k) for i, ((k, _), c) in enumerate(zip(rows, components(rows, links)))}
    assert len(got) == len(rows)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_cells_of_a_crowded_bucket_count_each_link_once(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + 0.02 * rng.normal(size=16)]) for i in range(60)]
    assert found(spark, rows, cell=7) == {i: (59, 0, i == 0) for i in range(60)}


def test_copies_null_keys_and_repeated_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0])] * 3 + [(2, [1.0, 2.0, 3.0]), (9, [3.0, -2.0, 1.0]), (None, [9.0, 9.0, -9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component), r.kept) for r in vectors.near_vectors(df).collect())
    assert got == sorted([("5", 3, "2", False)] * 3 + [("2", 3, "2", True), ("9", 0, "9", True), ("None", 0, "None", False)])


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(2)
    errors, inside = [], []
    for trial in range(1_500):
        units = rng.normal(size=(2, 64))
        units[1] = units[0] * rng.random() * 2 + units[1]
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        code, factor, planes, base, step = vectors.codes(units)
        met = sum(int(np.bitwise_count(code[0] & planes[1].reshape(vectors.LEVELS, -1)[p]).sum()) << p for p in range(vectors.LEVELS))
        all_ = sum(int(np.bitwise_count(planes[1].reshape(vectors.LEVELS, -1)[p]).sum()) << p for p in range(vectors.LEVELS))
        signs = 2 * int(np.bitwise_count(code[0]).sum()) - 64
        guess = (base[1] * signs + step[1] * (2 * met - all_)) / 8 / factor[0]
        errors.append(guess - units[0] @ units[1])
        inside.append(abs(errors[-1]) <= vectors.ERRORS * (np.sqrt(1 - factor[0] ** 2) / 63**0.5 + step[1] / 2) / factor[0])
    assert abs(np.mean(errors)) < 0.01 and np.mean(inside) > 0.998


def test_pairs_at_the_threshold_meet_as_often_as_promised():
    rng = np.random.default_rng(3)
    bits, count = vectors.tables(50_000)
    for dim in (8, 64):
        a = rng.normal(size=(1_500, dim))
        b = rng.normal(size=(1_500, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (b * a).sum(1, keepdims=True) * a
        b = 0.9 * a + (1 - 0.81) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
        assert (vectors.table_keys(a, bits, count) == vectors.table_keys(b, bits, count)).any(1).mean() > 0.96


def test_open_rows_hold_every_link():
    rows = [r for r in planted(seed=9) if r[0] < 400]
    units = np.array([vectors.unit(v) for _, v in rows])
    code, factor, planes, base, step = vectors.codes(units)
    n = len(units)
    raw = lambda w: pa.array([x.tobytes() for x in w], pa.binary())
    zeros = pa.array(np.zeros(n, np.int32))
    table = pa.table({"k": pa.array(np.zeros(n, np.int64)), "i": zeros, "j": zeros, "side": zeros, "other": zeros, "cls": raw(units), "dim": pa.array(np.full(n, 64, np.int32)), "code": raw(code), "factor": factor, "planes": raw(planes), "base": base, "step": step})
    open_ = vectors.open_rows(table, 0.9)
    sims = units @ units.T - np.eye(n)
    linked = (sims >= 0.9).any(1)
    assert open_[linked].all()
    by_eights = table.set_column(0, "k", pa.array(np.arange(n) // 8))
    assert vectors.open_rows(by_eights, 0.9)[:144].mean() < 0.1


def test_empty_table(spark):
    assert found(spark, []) == {}
