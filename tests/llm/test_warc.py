import duckdb
import pytest

from tessellon.llm import warc

SF = "/root/testdata/sf0.001"


def plain(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        last = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        first = len(payload) < least or page == last
        out.append((page, len(payload), warc.base32_sha1(payload), "response" if first else "revisit", None if first else last))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example/x y", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example/\r\nWARC/1.1", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (4, "", None),
    (5, "u", ""),
    (6, "u", "é漢🙂" * 9_000),
    (7, "u", "a\nb\r\n\r\nc\x00d"),
    (-8, "u", "<p>one</p>"),
    (6, "u", "é漢🙂" * 9_000),
    (None, "u", "lonely"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").repartition(2)
    got = sorted((tuple(r) for r in warc.convert(df, version).collect()), key=str)
    assert got == plain(ROWS)


def test_least_bytes(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.convert(df, least_bytes=20).collect()), key=str) == plain(ROWS, 20)


def test_large_archives_are_read_in_parts(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i % 300} " * 400 + "\r\n\r\nWARC/1.1\r\nWARC-X-Run: 0\r\n" * (i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200000")
    try:
        got = warc.convert(df, path=str(tmp_path / "a"))
        assert got.rdd.getNumPartitions() > 5
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
        assert sorted((tuple(r) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()), key=str) == plain(rows)
    finally:
        spark.conf.set(name, before)


def test_no_pages(spark):
    assert warc.convert(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_more_repeated_payloads_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 0)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.convert(df).collect()), key=str) == plain(ROWS)


def test_archive_bytes():
    one, two = (warc.arc_record(7, "u v", "x", v) for v in (1, 2))
    assert len(one.split(b"\n")[0].split(b" ")) == 5 and len(two.split(b"\n")[0].split(b" ")) == 10
    fields, body = next(warc.parse_arc(two, 2))
    data = (warc.warc_record(fields, body, None, "r") + warc.warc_record(fields, body, 9, "r")).encode()
    (first, block), (second, short) = warc.parse_warc(data)
    assert first["warc-date"] == "1970-01-01T00:00:00Z" and block == body and second["warc-type"] == "revisit" and short.endswith(b"\r\n\r\n")
    assert warc.page_of(second["warc-refers-to"]) == 9
    with pytest.raises(ValueError):
        list(warc.parse_arc(two, 1))
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-3], 1))


def test_ids_name_their_pages():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id("" if page is None else str(page), warc.base32_sha1(b"x"))) == page


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(warc.ORACLE).fetchall())
    assert sorted(tuple(r) for r in warc.convert(spark.read.parquet(f"{SF}/pages.parquet")).collect()) == want
