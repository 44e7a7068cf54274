"""WARC archives: writing pages as records, one gzip member each, and reading them back in sequence.

Writer: a page becomes an HTTP response record, or, if a page with a larger id has the same payload of at least
`least_bytes` bytes, a revisit record that names that page. A record of 16 MB or more is followed by a small metadata record
that belongs to it, also a member of its own, as the file writer needs members that end with a zero byte. Reader: members are decompressed one at a time with an
incremental zlib object, a record is framed by its Content-Length, and block and payload digests are verified.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, cut, new_path
from millrace.llm.flat_files import FILE_BYTES, SCHEMA, numbered, read_files, write_records

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
READ = 1 << 16
EPOCH = "1970-01-01T00:00:00Z"


def page_urn(page_id: int | None) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = EPOCH) -> bytes:
    """An uncompressed record. The URL's control characters and spaces are percent-encoded, so that they end no header."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    uri = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "").encode())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{page_urn(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers_to)}>"]
    return "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def metadata(page_id: int | None, size: int, date: str = EPOCH) -> bytes:
    """An uncompressed metadata record about a page's record of `size` bytes."""
    block = b"uncompressed-length: %d\r\n" % size
    head = [
        "WARC/1.1", "WARC-Type: metadata", f"WARC-Record-ID: <{page_urn(page_id)}:length>", f"WARC-Date: {date}", f"WARC-Concurrent-To: <{page_urn(page_id)}>",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member. Its last byte is the length divided by 2^24: 0 in records under 16 MB."""
    return gzip.compress(raw, 6, mtime=0)


def page_members(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The member of a page's record, for long ones that of a metadata record too; without the last byte, which is 0."""
    raw = record(page_id, url, payload, digest, refers_to)
    out = member(raw)
    return (out + member(metadata(page_id, len(raw))) if out[-1] else out)[:-1]


def _members(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return numbered((page_members(*(v.as_py() for v in row)) for batch in batches for row in zip(*batch.columns, strict=True)), file_bytes)

    return run


def with_duplicates(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): only digests and ids are grouped, and only pages of payloads that occur
    more than once meet a group's largest id; null ids come last."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    groups = src.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written first: the planner then knows its size, broadcasts it if that is small, and can else split a digest that many rows have.
    groups = cut(groups.select("digest", "last"), "warc-groups")
    out = src.join(groups, "digest", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("payload") >= least_bytes), F.col("last"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    rows = with_duplicates(pages, least_bytes, id_col, url_col, html_col)
    bound_batches(pages.sparkSession)
    write_records(rows.mapInArrow(_members(file_bytes), SCHEMA), path)


def members(data: memoryview) -> Iterator[bytes]:
    """The decompressed members of a file in turn, each from an incremental decompressor fed READ bytes at a time."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = data[at : at + READ]
            if not len(piece):
                raise ValueError("the archive ends inside a member")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record framed by Content-Length; errors for bad frames and digests."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(head["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError(f"{head.get('warc-record-id')}: its block isn't {n} bytes long")
    if head["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ValueError(f"{head.get('warc-record-id')}: its block digest is wrong")
    return head, block


def _page(urn: str) -> int | None:
    n = urn.strip("<>").rpartition(":")[2]
    return None if n == "null" else int(n)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for raw in members(memoryview(content.as_buffer())):
                head, block = parse(raw)
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                digest = head["warc-payload-digest"].partition(":")[2]
                if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
                    raise ValueError(f"{head['warc-record-id']}: its payload digest is wrong")
                refers_to = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
                rows.append((_page(head["warc-record-id"]), int(head["x-payload-length"]), digest, head["warc-type"], refers_to, head["warc-target-uri"], payload))
                size += len(raw)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all records; revisits have no payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return read_files(spark, path).select("content").mapInArrow(_read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 1000, file_bytes: int = FILE_BYTES, **columns: str) -> DataFrame:
    """Write pages as archives to the shared folder and read them back.

    Null html is an empty payload and a null url an empty one. Rows with the group's largest id are all responses, also
    where that id repeats; a row with a null id revisits the largest id, and is a response where there is none. Payloads
    under least_bytes are always responses. An archive has file_bytes and a record at most. Empty tables give no rows. Other columns are ignored."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes, file_bytes, **columns)
    return read_warc(pages.sparkSession, path)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT p.*, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
