"""Operator 7: legacy web archives to WARC.

Pages are first laid out as legacy ARC records, whose one header line differs between
version 1 (address, IP, date, type, length) and version 2 (with result code, checksum,
place, offset and file name). The converter reads a version's own fields, takes exactly
the declared length as body and synthesises the WARC equivalents: a record id, an
ISO timestamp, a record type and SHA-1 digests. Records whose payload equals that of a
response become revisits of it, which carry the HTTP header alone.

Archives are written as plain text files whose records follow one another, through
Spark's writer, so any store that Spark reaches will do. An archive is as large as the
pages that its task reads. Every record begins with the version line and an extension
field that names the archive run; that pair of lines, which no page can foresee, is what
Spark's reader splits the files at, so large archives are read in parts, by many tasks. A
record that is split off is still checked against its declared length and its digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm.arrow import parts
from tessellon.session import shared_path, written

#: The payload size from which equal payloads are revisits.
LEAST_BYTES = 0
#: The extension field that names an archive run.
RUN = "WARC-X-Run"
#: Repeated payloads (about 60 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST = 50_000
#: Field names of each version's header line.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "place", "offset", "file", "length"),
}
DATE, IP = "19700101000000", "0.0.0.0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]+")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(page_id: int | None, url: str | None, html: str | None, version: int = 2) -> bytes:
    """One legacy record: a header line of the version, the HTTP response and a line feed."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    values = {"url": _SPACE.sub("%20", url or "") or "urn:none", "ip": IP, "date": DATE, "mime": "text/html", "code": "200", "checksum": hashlib.md5(payload).hexdigest(), "place": "-", "offset": "0", "file": "pages.arc", "length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def parse_arc(data: bytes, version: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of each legacy record, by the version's header line and its declared length."""
    at, names = 0, FIELDS[version]
    while at < len(data):
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogatepass").split(" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header line has {len(names)} fields, this one {len(values)}")
        fields = dict(zip(names, values))
        start, length = end + 1, int(fields["length"])
        if start + length > len(data):
            raise ValueError("a record is shorter than its declared length")
        yield fields, data[start : start + length]
        at = start + length
        at += data[at : at + 1] == b"\n"


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, header block, payload) of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + mark, payload


def record_id(page: str, digest: str) -> str:
    """A UUID of version 8 that names a page: 42 bits of its digest, then a presence bit and the 64 bits of its number."""
    number = int(page) & (1 << 64) - 1 if page else 0
    bits = (int.from_bytes(base64.b32decode(digest)[:8], "big") >> 7) << 65 | bool(page) << 64 | number  # 57 + 65 bits
    high, middle, low = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low)}>"


def page_of(name: str) -> int | None:
    """The page number that a record id names."""
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    bits = (value >> 64 & 0xFFF) << 62 | value & (1 << 62) - 1
    number = bits & (1 << 64) - 1
    return (number - (1 << 64) if number >> 63 else number) if bits >> 64 & 1 else None


def opening(run: str) -> str:
    """What every record of an archive run begins with."""
    return f"WARC/1.1\r\n{RUN}: {run}\r\n"


def warc_record(fields: dict[str, str], body: bytes, refers_to: int | None, run: str) -> str:
    """The WARC record of a legacy one; with ``refers_to`` a revisit of that page's response."""
    http, head, payload = split_http(body)
    digest, revisit = base32_sha1(payload), refers_to is not None
    block = head if revisit else body
    date = fields["date"]
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(http['x-page'], digest)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {fields['url']}",
        f"WARC-IP-Address: {fields['ip']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to), digest)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return opening(run) + "\r\n".join(lines) + "\r\n\r\n" + block.decode("utf-8", "surrogatepass") + "\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, by declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not begin where the one before it ends")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(fields["content-length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its declared length says")
        yield fields, data[start : start + length]
        at = start + length + 4


def described(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record that has been read, its digests checked."""
    if base32_sha1(block) != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError("a block does not have its digest")
    http, _, payload = split_http(block)
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError("a payload does not have its digest and length")
    return page_of(fields["warc-record-id"]), int(http["content-length"]), digest, kind, page_of(fields["warc-refers-to"]) if kind == "revisit" else None


def with_responses(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the largest page of equal payloads, null on that page itself.

    Digests are aggregated before they are shuffled, and only those of several pages go
    back to the pages: by broadcast while they are few, else by a join that adaptive
    execution may split where many pages share a payload.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    last = keyed.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    last, _ = written(last, "warc-payloads")
    last = F.broadcast(last) if last.count() <= BROADCAST else last
    small = F.octet_length(F.coalesce("html", F.lit(""))) < least_bytes
    refers = F.when(~small & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return keyed.join(last, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def to_records(pages: DataFrame, version: int, run_name: str) -> DataFrame:
    """(record string): the WARC record of each row (page_id, url, html, refers_to), by way of its legacy record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                out = [warc_record(*legacy, row["refers_to"], run_name) for row in part.to_pylist() for legacy in parse_arc(arc_record(row["page_id"], row["url"], row["html"], version), version)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "record string")


def write_archives(records: DataFrame, path: str) -> None:
    """Write archives, one for each task. The writer ends each value with a line feed, which is a record's last byte."""
    records.select(F.expr("substr(record, 1, length(record) - 1)")).write.option("lineSep", "\n").text(path)


def run_of(spark: SparkSession, path: str) -> str | None:
    """The name of the run that wrote the archives below ``path``, None where they hold nothing."""
    lines = spark.read.option("lineSep", "\r\n").text(path).where(F.col("value").startswith(f"{RUN}: ")).select("value").first()
    return lines["value"].partition(": ")[2] if lines else None


def read_archives(spark: SparkSession, path: str, run_name: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives of one run below ``path``."""
    begin = opening(run_name or run_of(spark, path) or "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                rows = []
                for content in part.column(0).to_pylist():
                    found = list(parse_warc((begin + content).encode("utf-8", "surrogatepass")))
                    if len(found) != 1:
                        raise ValueError("what lies between two openings is not one record")
                    rows.append(described(*found[0]))
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    records = spark.read.option("lineSep", begin).text(path).where("value <> ''")  # nothing comes before a file's first record
    return records.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def convert(pages: DataFrame, version: int = 2, least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Archive all pages and read the archives back: one row for each page.

    Page numbers are integers. A null page text is an empty payload, a null address is written as ``urn:none``, a
    null page number stays null and never names a response unless nothing else does;
    repeated rows of the largest page are all responses; an empty table gives no rows.
    """
    spark, path = pages.sparkSession, path or shared_path(pages.sparkSession, "warc")
    run_name = uuid.uuid4().hex
    write_archives(to_records(with_responses(pages, least_bytes), version, run_name), path)
    return read_archives(spark, path, run_name)


#: DuckDB SQL for the rows of ``convert`` over ``pages``: base32 is five hexadecimal digits to four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, h, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32 + 1)::INT, 1)), '') AS payload_digest FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN m USING (h)
"""
