import hashlib
import random
import re

from tessellon.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or doubled % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(a, b, k, 1.0) for a, _, b, k in sorted(out)]


def texts():
    yield from ("", "a@b.c", "a@b", "x@y.z@q.r", "..@a.b.c-d.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.3.255", "+1 (389) 555-5010", "4041894974608795", "4041 8949-7460 8795", "é a.b@c.de 漢 +49 (0) 30 1234567")
    rng = random.Random(7)
    for alphabet in ("0123456789 .-+()", "ab.@-_%+1", "0123456789.", "a@. 12+-()é\n", "01 -"):
        for _ in range(400):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(90)))
    for _ in range(200):
        digits = [rng.randrange(10) for _ in range(rng.randrange(13, 19))]
        for last in range(10):
            yield "no " + rng.choice(["", "-", " "]).join(map(str, [*digits, last])) + " x"


def test_base_spans_equal_the_plain_patterns():
    for t in texts():
        assert sorted(pii.base_spans(t), key=lambda s: (s[0], pii.KINDS.index(s[2]))) == plain(t), t


def test_added_kinds():
    assert [s[2] for s in pii.spans("Konto DE89 3704 0044 0532 0130 00 bitte")] == ["iban"]
    assert pii.spans("DE89370400440532013001") == []
    assert pii.spans("order 123-45-6789") == [] and [s[2] for s in pii.spans("my social security number is 123-45-6789.")] == ["ssn"]


def test_account_numbers_end_before_the_words_behind():
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"):
        for before in ("IBAN ", "CODE AB12 ", ""):
            for after in (" BIC COBADEFFXXX", " 2 days", " EUR 5 A", ". Then", ""):
                text = before + number + after
                assert [text[a:b] for a, b, kind, _ in pii.spans(text) if kind == "iban"] == [number], text
    two = "BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00"
    assert pii.redact(two) == "[IBAN] [IBAN]"
    assert pii.redact("IBAN DE89370400440532013000 BIC COBADEFFXXX") == "IBAN [IBAN] BIC COBADEFFXXX"


def test_blanks_between_blocks_are_read_once():
    pii.spans("AB12 " * 60_000)


def test_long_runs_are_read_once():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "+1" + "(" * 200_000, "a@" * 80_000, "AB12" * 60_000):
        pii.spans(t)


def test_operator_rows(spark):
    rows = [(1, "write a.b@c.de or 1.2.3.4", 0), (2, None, 0), (3, "", 0), (1, "write a.b@c.de or 1.2.3.4", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = [tuple(r) for r in pii.find_pii(df).orderBy("doc_id").collect()]
    spans = "email:6:14,ip:18:25"
    full = (1, 1, 1, 0, 0, hashlib.sha256(spans.encode()).hexdigest(), spans, "1,1")
    none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", "")
    assert got == [full, full, (2, *none), (3, *none)]
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["write [EMAIL] or [IP]"] * 2 + [None, ""]
    assert pii.find_pii(df.limit(0)).count() == pii.redacted(df.limit(0)).count() == 0


def test_accounts_with_words_behind_and_in_lower_case():
    for text, number in (
        ("IBAN GB82 WEST 1234 5698 7654 32 BIC NWBKGB2L", "GB82 WEST 1234 5698 7654 32"),
        ("IBAN GB82WEST12345698765432 AND MORE", "GB82WEST12345698765432"),
        ("account DE89370400440532013000 OK", "DE89370400440532013000"),
        ("IBAN DE89 3704 0044 0532 0130 00 IS VALID", "DE89 3704 0044 0532 0130 00"),
        ("pay to de89370400440532013000 today", "de89370400440532013000"),
        ("konto de89 3704 0044 0532 0130 00 bitte", "de89 3704 0044 0532 0130 00"),
    ):
        assert [text[a:b] for a, b, kind, _ in pii.spans(text) if kind == "iban"] == [number]
    assert not [s for s in pii.spans("ab12 some more words in lower case " * 50) if s[2] == "iban"]


def test_context_moves_scores_of_base_kinds_but_drops_none():
    far = " filler" * 20
    text = f"call +1 202 555 0143{far} order +1 202 555 0143{far} call order +1 202 555 0143{far} +1 202 555 0143"
    assert [s[3] for s in pii.spans(text) if s[2] == "phone"] == [1.0, 0.7, 1.0, 1.0]
