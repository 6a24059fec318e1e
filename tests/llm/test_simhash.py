import random

import numpy as np
import xxhash

from tessellon.llm import simhash


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    prints = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(k), f"{prints[i]:016x}", str(low[root(i)])) for i, (k, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two\x1cthree"), (6, "É A"), (None, "one"), (6, "É A"), (None, "none like it at all in here")]
    bases = [[word() for _ in range(rng.randrange(3, 400))] for _ in range(12)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, rng.choice([" ", "\n", "\r\n "]).join(words)))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp int").repartition(3)
    return sorted((str(r.doc_id), f"{r.fp & (2**64 - 1):016x}", str(r.component)) for r in simhash.near_duplicates(df, **more).collect())


def test_fingerprints_equal_the_definition():
    for _, text in corpus(1):
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)


def test_components_equal_brute_force(spark):
    rows = corpus(2)
    assert found(spark, rows) == brute(rows)


def test_dense_blocks_lose_no_link(spark):
    rows = corpus(3)
    assert found(spark, rows, dense=2) == brute(rows)


def test_links_of_random_close_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 20)
    prints = sorted({int(b) ^ simhash._signed(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 8), replace=False))) for b in base for _ in range(12)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for blocks in (6, 7, 8):
        got = [(r.a, r.b) for r in simhash.links(df, 4, blocks).collect()]
        assert set(got) == want and len(got) == len(want)
    for distance in (3, 4):
        close = {(a, b) for a, b in want if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links_by_centre(df, distance).collect()}
        assert got <= close and reach(got) == reach(close)


def reach(pairs):
    groups = {}
    for a, b in pairs:
        joined = groups.get(a, {a}) | groups.get(b, {b})
        for x in joined:
            groups[x] = joined
    return {x: min(g) for x, g in groups.items()}


def test_layout_grows_with_the_count():
    assert [simhash.layout(n, 4) for n in (0, 10**5, 10**8, 10**10)] == [6, 6, 7, 8]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_slices_of_a_long_text_hold_the_same_shingles():
    rng = random.Random(3)
    texts = ["", " ", "one", "one two three", "a" * 50, " a b ", *("".join(rng.choice("Ab \t\né") for _ in range(n)) for n in (5, 40, 400))]
    for text in texts:
        for words in (1, 2, 4, 5):
            whole = [h.tobytes() for part in simhash.shingle_hashes(text, words) for h in part]
            for size in (1, 2, 7, 33):
                assert [h.tobytes() for part in simhash.shingle_hashes(text, words, size) for h in part] == whole
