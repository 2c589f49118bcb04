"""WARC archives: one gzip member per record, written through Spark's own sink and read sequentially.

Writing: records become complete gzip members inside tasks; Spark's text sink writes them, a row of up to some megabytes of
members a file, so any file system that Spark knows will do, and its commit protocol covers lost executors. The sink ends
every row with one separator byte; as the last byte of a gzip member is the top byte of its length, 0 for records
under 16 MiB, the separator is NUL and the row is its members without the last byte. Where that byte isn't 0 it stays, and
the NUL is padding, which gzip readers skip.

Reading: a file's bytes are inflated piece by piece; a member is one record, framed by its Content-Length, and its
block and payload digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize, name, new_path

DATE = "1970-01-01T00:00:00Z"


def _sha1_base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One uncompressed record. A revisit holds the HTTP head of its response, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split()) if url else 'urn:page'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1_base32(digest)}",
        f"WARC-Block-Digest: {_sha1_base32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflate_members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member in turn, inflated incrementally; NULs between members are skipped."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            out.append(z.decompress(view[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record; its framing and block digest must hold."""
    end = data.index(b"\r\n\r\n")
    first, *rest = data[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
    size = int(fields["content-length"])
    block, tail = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its Content-Length")
    if fields.get("warc-block-digest", _sha1_base32(hashlib.sha1(block).digest())) != _sha1_base32(hashlib.sha1(block).digest()):
        raise ValueError("the block digest doesn't match")
    return fields, block


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value else None


def read_record(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes | None]:
    """(page_id, url, payload_bytes, payload_digest in hex, record_type, refers_to, payload); a response's payload digest must hold."""
    fields, block = parse(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).digest() != told):
        raise ValueError("the payload doesn't match its digest or length")
    return _page(fields["warc-record-id"]), fields["warc-target-uri"], size, told.hex(), fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None, None if revisit else payload


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, hot: int = 20_000) -> DataFrame:
    """(id, url, payload, digest, response_id): response_id is the largest id among equal payloads of at least
    ``least_bytes`` bytes that occur more than once, else null.

    Only digests are grouped. Payloads of more than ``hot`` copies, of which a table of n rows has n / hot at most, are looked up in
    a broadcast table, so that their rows stay where they are; the rest are joined by digest.
    """
    base = pages.select(name(id_col).cast("long").alias("id"), name(url_col).cast("string").alias("url"), F.coalesce(name(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = base.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "copies")
    many = F.broadcast(shared.where(F.col("n") > hot).select("digest", F.col("last").alias("hot_last"), F.lit(True).alias("is_hot")))
    few = shared.where(F.col("n") <= hot).select(F.col("digest").alias("few_digest"), F.col("last").alias("few_last"))
    # A hot row looks for its own id's digest, which isn't there: it goes anywhere, not to one task.
    key = F.when(F.col("is_hot"), F.concat(F.unhex(F.sha1(F.coalesce(F.col("id").cast("string"), F.lit("")))), F.lit(b"\0"))).otherwise(F.col("digest"))
    joined = base.join(many, "digest", "left").withColumn("few_digest", key).join(few, "few_digest", "left")
    return joined.select("id", "url", "payload", "digest", F.coalesce("hot_last", "few_last").alias("response_id"))


def write_archives(records: DataFrame, path: str, max_bytes: int = 16 << 20) -> None:
    """Write the rows of plan_records as archives under ``path``. An archive is closed once it holds ``max_bytes`` bytes, so that no
    reader's memory depends on more than that and one record; every archive is one row of Spark's sink."""
    def run(batches):
        members, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for i, u, p, d, r in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    members.append(member(record(i, u, p, d, r, r is not None and r != i)))
                    held += len(members[-1])
                    if held >= max_bytes:
                        yield _row(members)
                        members, held = [], 0
        if members:
            yield _row(members)

    def _row(members):
        data = b"".join(members)
        return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data[-1] == 0 else data], pa.binary())], names=["archive"])

    records.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record under ``path``."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for data in inflate_members(content.as_py()):
                    found = read_record(data)
                    out.append(found if payloads else found[:-1])
                    if len(out) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record, then read the archives back; one row per page. Other columns are ignored.

    Null html is an empty payload. Rows that repeat the largest page_id of a payload are responses too. A null page_id revisits like any other,
    and is never a response that others refer to unless all are null, when all are responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(plan_records(pages, id_col, url_col, html_col), path)
    return read_archives(spark, path)
