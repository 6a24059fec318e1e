"""Chunkers: one document to many positioned chunks.

The token window is built in. The others need dynamic programming or text search and run
in Arrow batches, one document at a time. All give (doc_id, chunk_no, content, tokens,
type, start, end); ``start`` and ``end`` are code points of the document, end exclusive,
and -1 where a chunk has no place in it.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.functions.similarity import split_sentences
from tessellon.operators.embedding import hash_embed

SEPARATORS = ("\n\n", "\n", ".", "?", "!", " ", "")
#: Where source code and markup divide, coarse to fine, as regular expressions. The first that occurs divides, so order matters.
LANGUAGES = {
    "cpp": ("\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""),
    "js": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""),
    "markdown": ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", ""),
}
FIELDS = "chunk_no int, content string, tokens int, type string, start int, `end` int"


def check_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window needs a size of at least 1 and an overlap below it")


def token_chunks(df: DataFrame, size: int = 400, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, content, tokens, type, start_token, end_token): windows of whitespace tokens.

    Windows begin every ``size - overlap`` tokens and end with the one that reaches the
    end; a text without tokens has none. All of it runs in the JVM.
    """
    check_window(size, overlap)
    stride = size - overlap
    base = df.select(key, tx.tokens(F.col(text)).alias("__t")).withColumn("__n", F.size("__t")).where("__n > 0")
    last = F.when(F.col("__n") <= size, 0).otherwise(F.ceil((F.col("__n") - size) / stride).cast("int"))
    out = base.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    start = F.col("chunk_no") * stride
    part = F.slice("__t", start + 1, F.lit(size))
    return out.select(key, "chunk_no", F.array_join(part, " ").alias("content"), F.size(part).alias("tokens"), F.lit("token").alias("type"), start.alias("start_token"), F.least(start + size, F.col("__n")).alias("end_token"))


Piece = tuple[str, int, int]


def count_tokens(text: str) -> int:
    return len(text.split())


def window_pieces(text: str, size: int, overlap: int) -> Iterator[Piece]:
    """Token windows with their places in the text itself, whitespace as it stands there."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    at = 0
    while spans:
        part = spans[at : at + size]
        yield text[part[0][0] : part[-1][1]], part[0][0], part[-1][1]
        if at + size >= len(spans):
            return
        at += size - overlap


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, is_regex: bool = False, length: Callable[[str], int] = count_tokens) -> Iterator[Piece]:
    """Pieces of at most ``size`` where the separators allow it, by the coarsest separator there is.

    A separator stays at the start of the piece after it. Small pieces are joined with an
    overlap of whole pieces; large ones are divided by the next separator. Places are
    exact, because pieces are slices of the text.
    """

    def cut(start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        part = text[start:end]
        while level < len(separators) - 1 and not re.search(separators[level] if is_regex else re.escape(separators[level]), part):
            level += 1
        mark = separators[level]
        if mark == "":
            edges = [m.start() for m in re.finditer(r"\S\s*", part)] if length is count_tokens else list(range(len(part)))
            edges = [0, *edges[1:]] if edges else [0]
        else:
            edges = [0, *(m.start() for m in re.finditer(mark if is_regex else re.escape(mark), part) if m.start())]
        small: list[tuple[int, int]] = []
        for a, b in zip(edges, [*edges[1:], len(part)]):
            if length(part[a:b]) < size or mark == "":
                small.append((start + a, start + b))
            else:
                yield from joined(small)
                small = []
                yield from cut(start + a, start + b, level + 1) if level + 1 < len(separators) else [(start + a, start + b)]
        yield from joined(small)

    def joined(parts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        held: list[tuple[int, int]] = []
        sizes: list[int] = []
        for a, b in parts:
            n = length(text[a:b])
            if held and sum(sizes) + n > size:
                yield held[0][0], held[-1][1]
                while held and (sum(sizes) > overlap or sum(sizes) + n > size):
                    held.pop(0)
                    sizes.pop(0)
            held.append((a, b))
            sizes.append(n)
        if held:
            yield held[0][0], held[-1][1]

    for a, b in cut(0, len(text), 0):
        piece = text[a:b]
        if bare := piece.strip():
            a += len(piece) - len(piece.lstrip())
            yield bare, a, a + len(bare)


def mean_similarity(vectors: np.ndarray) -> float:
    """The mean inner product over all pairs of rows, by the square of their sum."""
    n, total = len(vectors), vectors.sum(0)
    return float((total @ total - (vectors**2).sum()) / (n * (n - 1))) if n > 1 else 0.0


def segments(vectors: np.ndarray, most: int, sizes: list[int] | None = None, budget: int | None = None, bonus: float = 0.0) -> list[tuple[int, int]]:
    """The division of rows into runs of at most ``most`` (or a token budget) with the largest sum of inner similarity.

    A pair's similarity is its inner product less the mean over all pairs. A run's sum is
    the square of its rows' sum without the rows' own squares, so prefix sums give it and
    no matrix of pairs is held. Every prefix's best value starts at minus infinity, so
    runs never pass the cap; a single item is always a run.
    """
    n, mean = len(vectors), mean_similarity(vectors)
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), vectors.cumsum(0)])
    squares = np.concatenate([[0.0], (vectors**2).sum(1).cumsum()])
    used = np.concatenate([[0], np.cumsum(sizes)]) if sizes else None
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    for end in range(1, n + 1):
        low = max(0, end - most)
        if budget is not None:
            low = min(max(low, int(np.searchsorted(used, used[end] - budget))), end - 1)
        starts = np.arange(low, end)
        length = end - starts
        inner = ((sums[end] - sums[low:end]) ** 2).sum(1) - (squares[end] - squares[low:end])
        value = best[low:end] + inner - mean * (length * (length - 1)) + bonus * np.log(length)
        at = len(value) - 1 - int(np.argmax(value[::-1]))
        best[end], back[end] = value[at], starts[at]
    out, end = [], n
    while end:
        out.append((int(back[end]), end))
        end = int(back[end])
    return out[::-1]


def merged_small(parts: list[Piece], most: int, least: int, text: str) -> Iterator[Piece]:
    """Neighbours joined where together they stay within ``most`` and one of them is below ``least`` tokens."""
    held: Piece | None = None
    for piece in parts:
        if held:
            a, b = count_tokens(held[0]), count_tokens(piece[0])
            if a + b <= most and min(a, b) < least:
                held = (f"{held[0]} {piece[0]}", held[1], piece[2])
                continue
            yield held
        held = piece
    if held:
        yield held


def cluster_pieces(text: str, most: int = 400, least: int = 50, join_below: int = 80, embed: Callable = hash_embed) -> Iterator[Piece]:
    """Small recursive pieces, grouped into runs of similar neighbours."""
    small = list(recursive_pieces(text, least, 0))
    if len(small) > 1:
        runs = segments(embed([p[0] for p in small]), max(1, most // least))
        small = [(" ".join(p[0] for p in small[a:b]), small[a][1], small[b - 1][2]) for a, b in runs]
    yield from merged_small(small, most, join_below, text)


def semantic_pieces(text: str, most: int = 400, join_below: int = 60, embed: Callable = hash_embed) -> Iterator[Piece]:
    """Sentences, grouped into runs of similar neighbours within a token budget; longer runs have a small bonus."""
    sentences = split_sentences(text)
    if not sentences:
        return
    runs = segments(embed(sentences), len(sentences), [count_tokens(s) for s in sentences], most, 0.2)
    parts = [(" ".join(sentences[a:b]), -1, -1) for a, b in runs]
    yield from merged_small(parts, most, join_below, text)


def _loose(words: list[str]) -> re.Pattern:
    return re.compile(r"\s+".join(map(re.escape, words)))


def _alike(a: str, b: str, least: float) -> float:
    """The similarity of two texts in lower case, 0 where it is below ``least``."""
    matcher = difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False)
    if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
        return 0.0
    score = matcher.ratio()
    return score if score >= least else 0.0


def _by_window(text: str, part: str, least: float) -> tuple[int, int] | None:
    """The likest window of the part's length, of those at the places where its rarest word stands."""
    rare = min(part.split(), key=lambda w: (text.count(w) or len(text), -len(w)))
    ahead, best = part.find(rare), (0.0, None)
    for m in re.finditer(re.escape(rare), text):
        a = max(0, m.start() - ahead)
        window = text[a : a + len(part)]
        if (score := _alike(part, window, max(least, best[0]))) > best[0]:
            best = (score, (a, a + len(window)))
    return best[1]


def _by_head(text: str, part: str, size: int = 50, least: float = 0.8) -> tuple[int, int] | None:
    """The part's first characters, carried on to the part's length or a tenth more or less."""
    if len(part) <= 2 * size or not (words := part[:size].split()) or not (m := _loose(words).search(text)):
        return None
    for share in (1.0, 1.1, 0.9):
        end = m.start() + int(len(part) * share)
        if end <= len(text) and _alike(part, text[m.start() : end], least):
            return m.start(), end
    return None


def _by_sentence(text: str, part: str, least: float = 0.85) -> tuple[int, int] | None:
    """The likest sentence or line."""
    best = (0.0, None)
    for m in re.finditer(r"[^.!?\n]+", text):
        sentence = m.group().strip()
        if sentence and (score := _alike(part, sentence, max(least, best[0]))) > best[0]:
            a = text.index(sentence, m.start())
            best = (score, (a, a + len(sentence)))
    return best[1]


def _by_pieces(text: str, part: str, size: int = 100, least: float = 0.75) -> tuple[int, int] | None:
    """Around the first piece of the part that stands in the text, where what is there is like the whole part."""
    if len(part) <= 2 * size:
        return None
    for at in range(0, len(part) - size, size // 2):
        if not (words := part[at : at + size].split()) or not (m := _loose(words).search(text)):
            continue
        a = max(0, m.start() - at)
        b = min(len(text), a + len(part))
        if _alike(part, text[a:b], least):
            return a, b
    return None


def locate(text: str | None, part: str | None, since: int = 0, least: float = 0.8) -> tuple[int, int] | None:
    """Where a part stands in a text, by the first way that finds it.

    The ways are: exactly; with other whitespace; with other case too; once marks of
    tokenised corpora are undone in both; the likest window; its first 50 characters; the
    likest sentence; a piece of 100 characters. Windows are compared only where one of the
    part's words stands. Null and blank parts stand nowhere.
    """
    if not text or not part or not part.strip():
        return None
    if (at := text.find(part, since)) >= 0:
        return at, at + len(part)
    words = part.split()
    if m := _loose(words).search(text, since) or re.compile(_loose(words).pattern, re.IGNORECASE).search(text, since):
        return m.span()
    if m := re.compile(r"\s*".join(map(re.escape, re.findall(r"\w+|[^\w\s]", _unmarked(part)))).replace("\\-", "(?:@?-@?)").replace(",", "(?:@?,@?)").replace("\\.", "(?:@?\\.@?)")).search(text, since):
        return m.span()
    return _by_window(text, part, least) or _by_head(text, part) or _by_sentence(text, part) or _by_pieces(text, part)


def _unmarked(part: str) -> str:
    for mark, plain in (("<unk>", ""), ("@-@", "-"), ("@,@", ","), ("@.@", ".")):
        part = part.replace(mark, plain)
    return part


def located(df: DataFrame, text: str, part: str) -> DataFrame:
    """``df`` with ``start`` and ``end`` of a part in a text, null where it is not found."""

    @F.pandas_udf("start int, end int")
    def run(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(t, p) or (None, None) for t, p in zip(texts, parts)], columns=["start", "end"]).astype("Int32")

    return df.withColumn("__at", run(F.col(text), F.col(part))).select(*df.columns, F.col("__at.start").alias("start"), F.col("__at.end").alias("end"))


def chunk_with(df: DataFrame, pieces: Callable[[str], Iterator[Piece]], kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks that a function finds in each text; null and blank texts have none."""
    base = df.select(key, text)
    names = [key, "chunk_no", "content", "tokens", "type", "start", "end"]
    key_kind = base.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (content, start, end) in enumerate(pieces(t or "")):
                    owner.append(i)
                    rows.append((n, content, count_tokens(content), kind, start, end))
            if rows:
                types = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return base.mapInArrow(run, f"{key} {key_kind}, {FIELDS}")


def chunk(df: DataFrame, kind: str, size: int = 400, overlap: int = 200, key: str = "doc_id", text: str = "text", language: str | None = None) -> DataFrame:
    """Chunks of a kind: token, recursive, cluster or semantic. An unknown kind is an error."""
    check_window(size, overlap)
    marks = LANGUAGES[language] if language else SEPARATORS
    ways = {
        "token": lambda t: window_pieces(t, size, overlap),
        "recursive": lambda t: recursive_pieces(t, size, overlap, marks, bool(language)),
        "cluster": lambda t: cluster_pieces(t, size),
        "semantic": lambda t: semantic_pieces(t, size),
    }
    if kind not in ways:
        raise ValueError(f"there are no chunks of kind {kind}")
    return chunk_with(df, ways[kind], kind, key, text)
