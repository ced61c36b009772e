"""WARC archives written by Spark and read back by a salvaging reader.

Writer. A record is one or more gzip members, ready bytes of a column; Spark's own text sink writes them, so a lost
task is repeated and any store that Spark knows will do. The sink ends each row with one byte; the last byte of a
gzip member below 16 MB is zero, so that byte is the row's end (larger records go on in further members).

Reader. It walks the members of a file. Where one fails its checks (header, deflate stream, CRC, WARC header, length,
payload digest) it searches for the next member or version line that holds a valid record, goes on from there, and
logs the bytes between as a quarantined gap. Plain, uncompressed archives are read by the same rules.

Edge cases. A null payload is the empty one, and empty payloads are equal payloads like any other. Of equal payloads
the record with the largest id is the response, of rows that share that id the last in the table's order (the table
is read twice, so that order must hold). A file of no valid record is one gap. An archive is held in memory by one task,
so Spark's limit for binary columns, 2 GB, holds for an archive and for a record. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least payload of which equal ones become revisits.
LEAST_REVISIT = 0
_MEMBER = 8 << 20  # bytes of a record in one gzip member
#: Records of an archive, so that one is some hundred MB for common pages; a reader's task holds an archive at a time.
FILE_RECORDS = 20_000
#: Most bytes that a gzip member may inflate to, the most that a row's column can hold; one beyond that is a gap.
MOST_INFLATED = (1 << 31) - (1 << 20)
_PIECE = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/[01]\.[0-9]\r\n")
RECORD_SCHEMA = "file string, offset long, length long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int) -> str:
    return f"<urn:veiltab:page:{page_id}>"


def gzipped(record: bytes, level: int = 4) -> bytes:
    out = []
    for a in range(0, max(len(record), 1), _MEMBER):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(z.compress(record[a : a + _MEMBER]) + z.flush())
    return b"".join(out)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, sha1: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {_DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> None:
    """Writes an archive per partition at path. Only digests and ids are shuffled to find equal payloads, and of
    them only the groups of two and more come back."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # rows may share an id: the last of them is the response
    groups = rows.where(F.octet_length("body") >= least).groupBy("sha1").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("copies")).where("copies > 1")
    groups = common.written(groups.select("sha1", F.col("top.id").alias("first"), F.col("top.row").alias("last")), "payloads")
    # One row per payload on the right, so Spark may split a payload that very many pages have.
    marked = rows.join(common.small(groups, row_bytes=120), "sha1", "left")

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for i, u, h, first, b in zip(*(part.column(k).to_pylist() for k in range(4)), part.column(4), strict=True):
                member = gzipped(record(i, u, b.as_py(), first, base64.b32encode(bytes.fromhex(h)).decode()))
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = common.mapped(marked.select("id", "url", "sha1", F.when(F.col("row") != F.col("last"), F.col("first")).alias("first"), "body"), of, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).mode("error").text(path)
    common.forget(groups)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """(contents, end) of the gzip member at `at`, or None if it fails its checks or inflates beyond MOST_INFLATED."""
    z, out, size, pos, more = zlib.decompressobj(31), [], 0, at, b""
    try:
        while not z.eof and (more or pos < len(data)):
            if not more:
                more, pos = data[pos : pos + _PIECE], min(pos + _PIECE, len(data))
            out.append(z.decompress(more, _PIECE))
            size, more = size + len(out[-1]), z.unconsumed_tail
            if size > MOST_INFLATED:
                return None
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data)) if z.eof else None


def _headers(data: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """(fields in lower case, start of the body) of a record at `at`."""
    if not _VERSION.match(data, at):
        return None
    fields: dict[str, str] = {}
    start = data.find(b"\r\n", at) + 2
    while (end := data.find(b"\r\n", start)) != start:  # of any length, but every line is a field
        name, colon, value = data[start : max(end, start)].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        start = end + 2
    return (fields, end + 2) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _checked(fields: dict[str, str], body: bytes) -> bool:
    """Whether a response's payload has the digest that its header states."""
    said = fields.get("warc-payload-digest", "")
    return fields["warc-type"] != "response" or not said.startswith("sha1:") or said[5:] == digest(body)


def _at_gzip(data: bytes, view: memoryview, at: int) -> tuple[dict[str, str], bytes, int] | None:
    got = _inflate(view, at)
    if not got:
        return None
    first, end = got
    while not (head := _headers(first)):  # a header may go on in further members
        if not _VERSION.match(first) or data[end : end + 3] != _MAGIC or not (got := _inflate(view, end)) or _VERSION.match(got[0]):
            return None
        first, end = first + got[0], got[1]
    fields, start = head
    held, need = [first[start:]], start + int(fields["content-length"]) + 4
    size = len(first)
    while size < need:
        if data[end : end + 3] != _MAGIC or not (got := _inflate(view, end)) or _VERSION.match(got[0]):
            return None
        held.append(got[0])
        size += len(got[0])
        end = got[1]
    body = b"".join(held)
    if size != need or body[-4:] != b"\r\n\r\n" or not _checked(fields, body[:-4]):
        return None
    return fields, body[:-4], end


def _at_plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    if not (head := _headers(data, at)):
        return None
    fields, start = head
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n" or not _checked(fields, data[start:end]):
        return None
    return fields, data[start:end], end + 4


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(offset, length, fields, body) of each valid record in order; fields are None for a quarantined gap."""
    at, gap, view = 0, 0, memoryview(data)
    while at < len(data):
        found = _at_gzip(data, view, at) if data[at : at + 3] == _MAGIC else _at_plain(data, at)
        if found:
            if gap < at:
                yield gap, at - gap, None, b""
            yield at, found[2] - at, found[0], found[1]
            at = gap = found[2]
            continue
        member, version = data.find(_MAGIC, at + 1), _VERSION.search(data, at + 1)
        at = min(x for x in (member if member >= 0 else len(data), version.start() if version else len(data)))
    if gap < len(data):
        yield gap, len(data) - gap, None, b""


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA: a row per record, and one per gap, with `gap` stating what was skipped and all but the place null.

    payload_bytes and payload_digest of a response are those of the payload that was read, of a revisit those that it states."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for part in parts:
            for name, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for at, length, fields, body in salvage(data.as_buffer().to_pybytes()):
                    if fields is None:
                        rows.append((name, at, length, None, None, None, None, None, None, None, f"no valid record in {length} bytes"))
                    else:
                        whole = fields["warc-type"] == "response"
                        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        stated = fields.get("warc-payload-length", "")
                        rows.append((name, at, length, fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest(body) if whole else said, len(body) if whole else int(stated) if stated.isdigit() else None, body if payloads else None, None))
                        size += len(body)
                    if len(rows) >= 2000 or size > 4 << 20 and payloads:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return common.mapped(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content"), of, RECORD_SCHEMA)


def page_of(column: str) -> Column:
    return F.regexp_extract(column, r"page:(-?\d+)>", 1).try_cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, payloads=False).where("gap is null").select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


#: SHA-1 of each payload; its 160 bits are spelt in base 32.
SQL = """
WITH said AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS first FROM said),
spelt AS (SELECT *, unhex(sha)::BIT::VARCHAR AS bits FROM hashed)
SELECT page_id, payload_bytes, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(generate_series(1, 5),
         lambda k: CASE WHEN substr(bits, (5 * i + k)::BIGINT, 1) = '1' THEN 1 << (5 - k)::INT ELSE 0 END))::BIGINT, 1)), '') AS payload_digest
FROM spelt
"""
