"""WARC archives: writing, reading and resolving revisits.

Every record is a gzip member of its own, so that archives can be read from any record's start. Spark has no binary sink;
its text sink writes the bytes of a column as they are, with an empty gzip member between records in place of the
line break. Archives are therefore written and read by Spark's own committers and readers, on any store it knows.

Deduplication reads the headers of an archive, sends them (never payloads) by payload digest, finds each digest's
response, and takes every archive file through once more next to its own decisions: responses go out as they are under
fresh headers, other records as revisits that name the response by its identifier, target and digest, without payload.
A digest that a large share of the records has is dealt over tasks by (digest, salt).

Defined cases: a null html is an empty payload; an empty payload counts like any other if the least size is 0; a null url
is the target ``about:blank``; repeated rows of one page are separate records, of which one at most is the response; a very
long payload is one record, and a file of its own length; an
empty table gives an empty archive; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, drop_at_exit, pages, scratch, shuffle_partitions, tidy

#: An empty gzip member, which parts the members of records.
_EMPTY = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
#: Compression of a record; bytes from which records written together are one row, and such rows in a file: that bounds what one
#: task holds of a file (64 MB, and a record for each row).
LEVEL, ROW_BYTES, ROWS = 5, 1 << 20, 64
#: The archives of a run have one date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _one_line(url: str | None) -> str:
    """A target that cannot break a header."""
    return " ".join(url.split()) or "about:blank" if url else "about:blank"


def response_headers(uri: str, target: str, digest: str) -> dict[str, str]:
    return {"WARC-Type": "response", "WARC-Record-ID": f"<{uri}>", "WARC-Date": DATE, "WARC-Target-URI": target,
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/html; charset=utf-8"}


def revisit_headers(uri: str, target: str, digest: str, size: int, to_uri: str, to_target: str) -> dict[str, str]:
    return {"WARC-Type": "revisit", "WARC-Record-ID": f"<{uri}>", "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Profile": _PROFILE,
            "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Refers-To": f"<{to_uri}>", "WARC-Refers-To-Target-URI": to_target,
            "WARC-Refers-To-Date": DATE, "X-Payload-Length": str(size)}


def rows_of(members: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Gzip members as rows of about ROW_BYTES, one row a batch."""
    made, size = [], 0
    for member in members:
        made.append(member)
        size += len(member)
        if size >= ROW_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["member"])
            made, size = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["member"])


def write_archive(members: DataFrame, path: str) -> None:
    """members: one binary column of gzip members, some records in a row."""
    column = F.col(members.columns[0]).cast("string").alias("value")
    writer = members.select(column).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1"))
    writer.option("maxRecordsPerFile", ROWS).text(path)


def archive_pages(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a response record for each row."""

    def run(batches):
        yield from rows_of(made(batches))

    def made(batches):
        for batch in tidy(batches):
            for i, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                yield record(response_headers(f"urn:page:{i}", _one_line(url), payload_digest(payload)), payload)

    write_archive(rows.select(id_col, url_col, html_col).mapInArrow(run, "member binary"), path)


def parse(content: bytes | pa.Buffer) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """number, headers and block of each record of an archive file, one in memory at a time."""
    at, number = 0, 0
    view = memoryview(content)
    while at < len(view):
        unpacker = zlib.decompressobj(31)
        parts = [unpacker.decompress(view[at : at + (1 << 16)])]
        used = at + (1 << 16)
        while not unpacker.eof and used < len(view):
            parts.append(unpacker.decompress(view[used : used + (1 << 20)]))
            used += 1 << 20
        at = min(used, len(view)) - len(unpacker.unused_data)
        out = b"".join(parts)
        if not out:
            continue
        head, _, rest = out.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield number, headers, rest[: int(headers["Content-Length"])]
        number += 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


_HEADERS = "file string, number int, page_id bigint, target string, type string, digest string, bytes bigint, refers_to bigint"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below path, without payloads; digests are taken from what was read."""

    def run(batches):
        for batch in tidy(batches, 1):
            rows: list[tuple] = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for number, h, block in parse(content.as_buffer()):
                    if h["WARC-Type"] == "response":
                        digest, size, to = payload_digest(block), len(block), None
                    else:
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size, to = int(h["X-Payload-Length"]), _page(h["WARC-Refers-To"])
                    rows.append((file, number, _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], digest, size, to))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _HEADERS.split(", ")])

    return _files(spark, path).mapInArrow(run, _HEADERS)


def _page(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return None if number == "None" else int(number)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers with to_page, to_target, first: the response of the digest, and whether this record is it.

    Of the records of a digest, the one of the largest page is the response (of repeated pages, the first by file and
    number). Payloads below least_bytes are all responses.
    """
    salts = max(64, shuffle_partitions(headers.sparkSession))
    salted = headers.withColumn("salt", F.pmod(F.xxhash64("file", "number"), F.lit(salts)))
    # Payloads that are not deduplicated never meet.
    counts = F.col("bytes") >= least_bytes
    best = F.max(F.struct(F.col("page_id"), F.xxhash64("file", "number").alias("tie"), "file", "number", "target")).alias("best")
    parts = salted.where(counts).groupBy("digest", "salt").agg(best)
    parts = parts.withColumn("best", F.max("best").over(Window.partitionBy("digest")))
    joined = salted.join(parts, ["digest", "salt"], "left")
    first = ~counts | ((F.col("best.file") == F.col("file")) & (F.col("best.number") == F.col("number")))
    return joined.select(
        *headers.columns, F.col("best.page_id").alias("to_page"), F.col("best.target").alias("to_target"), first.alias("first")
    )


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Reads the archives below source and writes archives of the same records, repeated payloads as revisits."""
    decided = resolve(read_headers(spark, source), least_bytes)
    # One row for each archive file meets the file's content.
    decision = F.struct("number", "first", "to_page", "to_target", "digest")
    by_file = decided.groupBy("file").agg(F.collect_list(decision).alias("decisions"))
    joined = _files(spark, source).join(by_file, F.col("path") == F.col("file")).select("content", "decisions")

    def run(batches):
        yield from rows_of(made(batches))

    def made(batches):
        for batch in tidy(batches, 1):
            known = {d["number"]: d for d in batch.column(1)[0].as_py()}
            for number, h, block in parse(batch.column(0)[0].as_buffer()):
                d = known[number]
                uri, target_ = h["WARC-Record-ID"].strip("<>"), h["WARC-Target-URI"]
                if d["first"]:
                    yield record(response_headers(uri, target_, d["digest"]), block)
                else:
                    to = f"urn:page:{d['to_page']}"
                    yield record(revisit_headers(uri, target_, d["digest"], len(block), to, d["to_target"]), b"")

    write_archive(joined.mapInArrow(run, "member binary"), target)


def op4_warc(spark, sf_dir):
    source, target = scratch(spark, "warc-in"), scratch(spark, "warc-out")
    archive_pages(pages(spark, sf_dir), source)
    deduplicate(spark, source, target)
    drop(spark, source)
    drop_at_exit(spark, target)
    read = read_headers(spark, target)
    return read.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


#: SQL cannot write archives; what they hold when read back, it can. Base 32 of SHA-1 goes by five bits a letter.
ORACLE = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (
  select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as h, max(page_id) over (partition by body) as last
  from p),
bits as (
  select *, list_reduce(list_transform(range(1, 41), lambda i: bin_nibble[instr('0123456789abcdef', h[i])]), lambda x, y: x || y) as b
  from d, (select ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'] as bin_nibble))
select page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + 16 * cast(b[5*k+1] as int) + 8 * cast(b[5*k+2] as int) + 4 * cast(b[5*k+3] as int) + 2 * cast(b[5*k+4] as int) + cast(b[5*k+5] as int)]),
    lambda x, y: x || y) as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from bits
"""
