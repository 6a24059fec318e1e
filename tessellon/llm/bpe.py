"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to the Latin-1 characters of the same code, so that the vocabulary can
be kept in the string trie of an Aho-Corasick library, which names the longest entry at
a position. From there the encoder walks right; where the next entry does not
fit its left neighbour it takes the next shorter one, and where none is left it steps
back over its last token. Two adjacent tokens fit when merging their joined bytes by
rank gives exactly these two; a sequence whose neighbours all fit is the merge result.
Fits are memoised, and positions found dead are never tried twice, so the work is linear
in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tessellon.llm.arrow import map_texts

#: Pieces and token pairs remembered in a worker; both memos are emptied when full.
MEMO = 400_000
#: Above every id.
FAR = 1 << 24
#: Stands to the left of the first token, which must itself come out of merging its bytes.
START = FAR - 1


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(possessive(pattern)).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.reach = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        #: The longest entry that begins each path of the automaton, and the next shorter one that begins an entry.
        self.longest: dict[str, int] = {}
        self.shorter: dict[int, int] = {}
        for token, i in ranks.items():
            name = token.decode("latin-1")
            self.automaton.add_word(name, i)
            under = [x for n in range(1, len(token)) if (x := ranks.get(token[:n])) is not None]
            self.shorter[i] = under[-1] if under else -1
            for n in range(1, len(token) + 1):
                self.longest[name[:n]] = next((x for m in range(n, 0, -1) if (x := ranks.get(token[:m])) is not None), -1)
        self.fits = _Fits(self)
        self.pieces = _Pieces(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """The plain merge loop; only ever run on the bytes of two tokens."""
        get, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        name, size, reach = piece.decode("latin-1"), len(piece), self.reach
        walk, longest, shorter, length, fits = self.automaton.longest_prefix, self.longest, self.shorter, self.length, self.fits
        tokens: list[int] = []
        dead: set[int] = set()  # starts from which nothing fits; the tokens before a start are always the same ones
        at, i = 0, longest[name[: walk(name[:reach])]]
        while True:
            if i < 0:
                if not tokens:
                    raise ValueError("the ranks do not cover all bytes")
                dead.add(at)
                last = tokens.pop()
                at -= length[last]
                i = shorter[last]
            elif (end := at + length[i]) not in dead and fits[(tokens[-1] if tokens else START) * FAR + i]:
                tokens.append(i)
                if end == size:
                    return tokens
                at, ahead = end, name[end : end + reach]
                i = longest[ahead[: walk(ahead)]]
            else:
                i = shorter[i]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        for memo in (self.pieces, self.fits):
            if len(memo) > MEMO:
                memo.clear()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def possessive(pattern: str) -> str:
    """The same pattern without useless backtracking: a greedy class that ends an alternative takes all it can."""
    return regex.sub(r"(?<=[\]}])\+(?=\||$)", "++", pattern)


class _Fits(dict):
    """Whether two tokens may stand side by side, by left * FAR + right."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) > MEMO:
            self.clear()
        left, right = divmod(pair, FAR)
        want = [right] if left == START else [left, right]
        self[pair] = fit = self.bpe.merged(b"".join(map(self.bpe.bytes_of.__getitem__, want))) == want
        return fit


class _Pieces(dict):
    """Packed ids by piece; long pieces are not kept."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = pack(self.bpe.encode_piece(piece.encode()))
        if len(piece) <= 64:
            if len(self) > MEMO:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE.from_file(path, pattern)


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids binary): each text's ids, packed as little-endian unsigned 32-bit.

    ``vocabulary`` is the path of a rank file that every executor has. A null text counts
    as empty and has no ids; repeated rows stay; other columns are ignored.
    """

    def batch(texts: list) -> list[list]:
        bpe = loaded(vocabulary, pattern)
        return [[bpe.encode(t or "") for t in texts]]

    return map_texts(df, key, text, "token_ids binary", batch)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, decoded binary): the bytes that packed ids stand for; null ids count as none."""

    def batch(packed: list) -> list[list]:
        bpe = loaded(vocabulary, pattern)
        return [[bpe.decode(x or b"") for x in packed]]

    return map_texts(df, key, ids, "decoded binary", batch)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, token_ids]): encode every text and decode its ids.

    The digests are of the packed ids and of the decoded bytes. Encoding and decoding
    share one pass, so neither ids nor texts travel between processes a second time.
    A null text counts as empty; repeated rows stay; other columns are ignored.
    """

    def batch(texts: list) -> list[list]:
        bpe = loaded(vocabulary, pattern)
        out: list[list] = [[], [], [], []]
        for t in texts:
            ids = bpe.encode(t or "")
            out[0].append(len(ids) // 4)
            out[1].append(hashlib.sha256(ids).hexdigest())
            out[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if keep_ids:
                out[3].append(ids)
        return out if keep_ids else out[:3]

    return map_texts(df, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * keep_ids, batch)
