"""Operator 2: personal data.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
account numbers), and context words nearby raise or lower every span's score. Spans of the four base kinds stand on form
and checksum alone, so context moves their score but never drops one; account and social
security numbers, whose form proves less, are added only by score.

Every expression is written so that a long run of one class is read once: no repetition
can be re-entered from the middle of a run, and an e-mail is found from its at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
Span = tuple[int, int, str, float]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?i)(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", re.ASCII)
_BLOCK = re.compile(r"[A-Za-z0-9]+")
#: Characters of an account number by country.
LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words within ``NEAR`` characters that speak for or against a kind, in the languages of the corpus.
NEAR = 60
FOR = {
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|sozialversicherung|s[ée]curit[ée] sociale|seguridad social)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:example|sample|order|invoice|serial|part|isbn|version)\b")
#: Score of form and checksum alone, what a word for or against adds, and the least that counts.
START, UP, DOWN, LEAST = {"email": 1.0, "ip": 1.0, "card": 1.0, "phone": 1.0, "iban": 0.7, "ssn": 0.4}, 0.3, -0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last, "email", 1.0


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            yield *m.span(), "ip", 1.0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield *m.span(), "card", 1.0


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield *m.span(), "phone", 1.0


def scored(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
    return round(min(1.0, START[kind] + UP * bool(FOR[kind].search(around)) + DOWN * bool(AGAINST.search(around))), 3)


def accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers. A proposed span runs on over blanks into the words behind, so each end of a block in it is tried.

    A number in lower case must have its country's length, since so many words could be one.
    Of overlapping numbers those of the length that their country asks for come first, then the leftmost, then the longest.
    """
    held: list[tuple[bool, int, int]] = []
    at = 0
    while m := _IBAN.search(text, at):
        at, size = m.start() + 1, 0
        for block in _BLOCK.finditer(text, *m.span()):
            size += len(block.group())
            number, known = text[m.start() : block.end()].replace(" ", ""), LENGTHS.get(m.group()[:2].upper())
            if 15 <= size <= 34 and (size == known or number.isupper()) and mod97(number):
                held.append((size != known, m.start(), -block.end()))
    taken, out = bytearray(len(text) if held else 0), []
    for _, start, end in sorted(held):
        if taken.find(1, start, -end) < 0:
            taken[start:-end] = b"\1" * (-end - start)
            out.append((start, -end))
    return sorted(out)


def added(text: str) -> Iterator[Span]:
    """Kinds beyond the base ones, kept by score."""
    for start, end in accounts(text):
        if (score := scored(text, "iban", start, end)) >= LEAST:
            yield start, end, "iban", score
    for m in _SSN.finditer(text):
        if (score := scored(text, "ssn", *m.span())) >= LEAST:
            yield *m.span(), "ssn", score


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds with the score of form and checksum, before any context."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if any(map(text.__contains__, "0123456789")):
        found += ips(text)
        found += cards(text)
        if "+" in text:
            found += phones(text)
    return found


def spans(text: str | None) -> list[Span]:
    """All spans (start, end, kind, score) in code points, end exclusive, by start and then kind."""
    text = text or ""
    found = [(start, end, kind, scored(text, kind, start, end)) for start, end, kind, _ in base_spans(text)]
    if any(map(text.__contains__, "0123456789")):
        found += added(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in found)


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row.

    ``base_sha256`` digests the spans of the base kinds, ``spans`` lists all, and
    ``scores`` has one score for each. A null text counts as empty; repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """

    def batch(texts: list) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for t in texts:
            found = spans(t)
            base = [s for s in found if s[2] in BASE]
            for column, kind in zip(out, BASE):
                column.append(sum(s[2] == kind for s in base))
            out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out[5].append(joined(found))
            out[6].append(",".join(f"{s[3]:g}" for s in found))
        return out

    return map_texts(df, key, text, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string", batch)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first gives the name."""
    if text is None or not (found := spans(text)):
        return text
    out, at = [], 0
    for start, end, kind, _ in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with its personal data replaced, and the count of characters, where it has one, brought up to date.

    A null text stays null, a text without personal data stays as it is, and all other
    columns and all rows stay.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn(text, without(docs[text]))
    return out.withColumn(size, F.char_length(out[text]).cast(docs.schema[size].dataType)) if size in docs.columns else out
