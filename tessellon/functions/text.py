"""Text column functions, all built in: tokens, terms, trigrams, parsers and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[^ \t\n\r\f\x0B]+"
TERM = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Whitespace tokens in order; empty for null or blank text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def terms(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of letters and digits, in order, without the stop words."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-cased word, padded by two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 where both are empty."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(trigrams(a), trigrams(b))


def combined_similarity(cosine: Column, trigram: Column) -> Column:
    return 0.7 * cosine + 0.3 * trigram


def normalize_text(text: Column) -> Column:
    """Whitespace collapsed and trimmed, then the marks of tokenised corpora undone; blanks that a dropped mark leaves stay."""
    out = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    for mark, plain in (("<unk>", ""), ("@-@", "-"), (" @,@ ", ", "), (" @.@ ", ". "), ("“", '"'), ("”", '"'), ("’", "'"), ("‘", "'")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def triplets(text: Column) -> Column:
    """Structs (source, target, description, summary) of the lines with exactly four filled parts between bars."""
    lines = F.split(text, r"\R")
    parts = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda p: F.lower(F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))))
    whole = F.filter(parts, lambda p: (F.size(p) == 4) & ~F.array_contains(p, ""))
    return F.transform(whole, lambda p: F.struct(p[0].alias("source"), p[1].alias("target"), p[2].alias("description"), p[3].alias("summary")))


def entity_names(text: Column) -> Column:
    """Names of a comma-separated answer, without quotes, in lower case; blank pieces are dropped."""
    pieces = F.filter(F.split(text, ","), lambda p: F.trim(p) != "")
    bare = lambda p, q: F.regexp_replace(p, f"^{q}+|{q}+$", "")
    return F.transform(pieces, lambda p: F.lower(bare(bare(F.trim(p), '"'), "'")))


def merge_decision(text: Column) -> Column:
    """Struct (decision, name, confidence, reasoning) of an answer's lines; the last line of a kind counts."""
    last = lambda name: F.try_element_at(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_extract(x, rf"(?i)^\s*{name}\s*:\s*(.*?)\s*$", 1)), lambda x: x != ""), F.lit(-1))
    blank = lambda c: F.when(F.upper(c) == "N/A", "").otherwise(F.coalesce(c, F.lit("")))
    return F.struct(
        (F.upper(F.coalesce(last("Decision"), F.lit("NO"))) == "YES").alias("merge"),
        blank(last("Resolved Name")).alias("name"),
        F.upper(F.coalesce(last("Confidence"), F.lit("LOW"))).alias("confidence"),
        F.coalesce(last("Reasoning"), F.lit("")).alias("reasoning"),
    )


#: Names that must not be merged, in lower case. Dates, money and shares need only begin a name.
NON_MERGEABLE = (
    r"^(january|february|march|april|may|june|july|august|september|october|november|december)(\s+\d{1,2}(,?\s+\d{4})?|\s+\d{4})",
    r"^(\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4})",
    r"^\d{4}$",
    r"^(\$?\d+(\.\d+)?\s*(million|billion|trillion|thousand|m|b|t|k)|\d+(\.\d+)?\s*(million|billion|trillion|thousand))",
    r"^(\d+(\.\d+)?\s*percent|\d+(\.\d+)?%)",
    r"^\d+$",
    r"^\d+\.\d+$",
    r"^\d+:\d+$",
    r"^\d+(\.\d+)?\s*(km|m|cm|mm|mi|ft|in|kg|g|mg|lb|oz|l|ml|gal|hrs?|min|sec)$",
)


def mergeable(name: Column) -> Column:
    """Whether a name may be merged with others; blank and null names may not."""
    low = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.coalesce((low != "") & ~low.rlike("|".join(f"(?:{p})" for p in NON_MERGEABLE)), F.lit(False))


def first_content(*columns: Column) -> Column:
    """The first of several columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def instructed(task: str, query: Column) -> Column:
    """A query with the task it serves, for models that take instructions."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), query)


def rerank_prompt(task: str, query: Column, document: Column) -> Column:
    return F.concat(F.lit(f"<Instruct>: {task}\n<Query>: "), query, F.lit("\n<Document>: "), document)


def edge_line(source: Column, target: Column, description: Column) -> Column:
    """'source -> target: description', with a stand-in where there is no description."""
    return F.concat(source, F.lit(" -> "), target, F.lit(": "), F.coalesce(description, F.lit("No description")))


def clipped(text: Column, most: int = 2000) -> Column:
    """The text, cut and marked where it is longer than ``most`` characters."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
