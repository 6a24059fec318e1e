import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessellon.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    own = bpe.loaded(PATH, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(packed):
    return list(memoryview(packed).cast("I"))


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC .,!?0123456789\n\t éèñ漢字🙂'sſ²½_-=<|>\x1c"
    yield from ("", " ", "<|endoftext|>", "a" * 30_000, "ab" * 20_000, " " * 9_000, "\n" * 3_000, "é" * 5_000)
    for n in range(1_500):
        yield "".join(rng.choice("ab e" if n % 4 == 0 else letters) for _ in range(rng.randrange(120)))


def test_ids_equal_the_public_encoder_and_decode_to_the_text(both):
    own, public = both
    for text in texts():
        packed = own.encode(text)
        assert ids(packed) == public.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_backtracking_equals_merging_on_a_small_vocabulary():
    rng = random.Random(9)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 290:
            a, b = rng.choices([t for t in ranks if set(t) <= set(b"abc")], k=2)
            ranks.setdefault(a + b, len(ranks))
        own = bpe.ByteBPE(ranks, r"\S+")
        for _ in range(60):
            piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 24)))
            assert own.encode_piece(piece) == own.merged(piece)


def test_memos_stay_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    own, public = both
    for text in ("one two three four five six seven eight nine ten eleven", "zqx vvkq jjxw"):
        assert ids(own.encode(text)) == public.encode_ordinary(text)


def test_operator_rows(spark, both):
    _, public = both
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", None), (1, "Hello world", 9), (None, "x" * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted(
        (str(i), len(t := public.encode_ordinary(x or "")), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in t)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
        for i, x, _ in rows
    )
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df, PATH, PATTERN).collect()) == want
    encoded = bpe.encode_texts(df, PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in bpe.decode_ids(encoded, PATH, PATTERN).collect()) == sorted((x or "").encode() for _, x, _ in rows)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_rank_file_is_read_whole(both):
    own, _ = both
    assert len(own.ranks) == sum(1 for _ in open(PATH, "rb")) and all(base64.b64encode(b) for b in list(own.ranks)[:5])
