"""WARC archives: a Spark sink with revisit records, and a sequential reader.

Writing.  Every row becomes one WARC/1.1 record in a gzip member of its own.  Of
rows with equal payloads of at least ``min_payload`` bytes those with the least id
are ``response`` records, the others are ``revisit`` records without payload that
name it.  Spark's text sink writes the members, so any file system, commit
protocol and task retry works: a gzip member ends in the top byte of its length,
which is 0 below 16 MiB, so that byte is left to the sink's one-byte line
separator (a larger member is followed by an empty one, which ends in 0 too).
The files are plain concatenations of gzip members.  Spark rebalances the members before
they are written, so an archive has about the advisory partition size in bytes, whatever the pages' sizes.

Reading.  ``read_warc`` walks each archive front to back: zlib inflates member by
member in small steps, the block is framed by Content-Length, and block and
payload digests are verified.  Revisits are resolved against their responses.

Defined results.  Null html: empty payload.  Null id: the record says so and the
row reads back with a null id, never chosen as the response of a group that has an
id; a group of null ids only is all response.  Rows that repeat the least id are
all responses.  Null url: an empty target.  Control characters and spaces in a url
are percent-encoded.  An empty table gives no records.  Other columns are ignored.
A record that is cut short, misframed or fails a digest raises ValueError.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, need, shared_dir

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
READ_STEP = 1 << 16
ROWS_OUT_BYTES = 8 << 20

RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def record_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as one gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def closed(member: bytes) -> bytes:
    """The member without its last byte, which the sink's separator (0) supplies."""
    if member[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += z.compress(b"") + z.flush()
    return member[:-1]


def with_revisits(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) plus payload_digest, payload_bytes and refers_to.

    Only (digest, id) pairs are grouped, combined before the shuffle; groups of one
    never reach the join, which Spark can split for a digest that very many share.
    """
    p = need(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.sha2("payload", 256).alias("payload_digest"),
                 F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = (p.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("payload_digest").alias("d"), "first_id"))
    return p.join(first, p["payload_digest"] == first["d"], "left").select(
        *p.columns, F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")),
                           F.col("first_id")).alias("refers_to"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in
                         ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
            out.append(closed(record_member(*(x.as_py() for x in row))))
            size += len(out[-1])
            if size > ROWS_OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, min_payload: int = 100, max_records: int = 20_000) -> None:
    """Write the rows of ``pages`` as WARC archives, of at most ``max_records`` records, in ``path``.

    A task writes what it read of the pages or got from the join with the repeated digests: its
    archives are bounded by the size of input splits and of adaptive partitions, of which Spark splits the skewed.
    """
    members = with_revisits(pages, min_payload).mapInArrow(_members, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", "\u0000").option("compression", "none")
     .option("maxRecordsPerFile", max_records).mode("overwrite").text(path))


def _inflated(archive: memoryview) -> Iterator[bytes]:
    """The inflated bytes of each gzip member in turn; empty members give nothing."""
    at, z, parts = 0, zlib.decompressobj(31), []
    while at < len(archive):
        step = bytes(archive[at:at + READ_STEP])
        at += len(step)
        while step:
            if z.eof:
                z, parts = zlib.decompressobj(31), []
            parts.append(z.decompress(step))
            step = z.unused_data
            if z.eof and (record := b"".join(parts)):
                yield record
    if not z.eof and len(archive):
        raise ValueError("the archive ends inside a gzip member")


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names), block and payload of one record, verified."""
    head, sep, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != CRLF + CRLF:
        raise ValueError(f"{fields.get('warc-record-id')}: the block is not framed by its Content-Length")
    if (want := fields.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{fields.get('warc-record-id')}: block digest differs")
    payload = block.partition(CRLF + CRLF)[2] if "application/http" in fields.get("content-type", "") else block
    want = fields.get("warc-payload-digest")
    if fields["warc-type"] != "revisit" and want and want != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"{fields.get('warc-record-id')}: payload digest differs")
    return fields | {"payload": payload}


def _records(batches: Iterator[pa.RecordBatch], payload: bool = True) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                        ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), *([("payload", pa.binary())] if payload else [])])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for raw in _inflated(memoryview(content.as_buffer())):
                r = parse_record(raw)
                revisit = r["warc-type"] == "revisit"
                rows.append({
                    "record_id": r["warc-record-id"], "record_type": r["warc-type"], "page_id": _page(r["warc-record-id"]),
                    "refers_to": _page(r.get("warc-refers-to")), "target_uri": r.get("warc-target-uri"),
                    "payload_digest": r.get("warc-payload-digest", "").removeprefix("sha256:"),
                    "payload_bytes": None if revisit else len(r["payload"]), **({"payload": None if revisit else r["payload"]} if payload else {}),
                })
                size += len(r["payload"]) * payload + 200
                if size > ROWS_OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row (schema ``RECORDS``) per record of the archives in ``path``; a revisit has no payload.

    Without ``payload`` that column is left out; all digests are verified all the same.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORDS if payload else T.StructType([x for x in RECORDS if x.name != "payload"])
    return files.mapInArrow(lambda batches: _records(batches, payload), schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records without payload, revisits with the payload length of the response they name.

    A revisit whose response is missing keeps a null length.
    """
    r = records.select("record_id", "record_type", "page_id", "refers_to", "payload_digest", "payload_bytes")
    original = (r.where("record_type = 'response'").groupBy("page_id", "payload_digest")
                .agg(F.max("payload_bytes").alias("_bytes"))
                .select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "_bytes"))
    return r.join(original, (r["refers_to"] == original["_page"]) & (r["payload_digest"] == original["_digest"]),
                  "left").select("record_id", "record_type", "page_id", "refers_to", "payload_digest",
                                 F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"))


def archive_round_trip(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back once, revisits resolved, and remove the archives."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_payload)
    records = cut(read_warc(spark, path, payload=False))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return resolve_revisits(records)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest AS g, min(page_id) AS first_id, count(*) AS n FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN n > 1 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON g = payload_digest
"""
