"""WARC archives: a writer and a sequential reader.

An archive holds one gzip member per record. The writer hands members to Spark's
text writer, so that archives are committed like any Spark output and may lie in
any store that Spark writes to. That writer ends each row with a separator; the
separator here is the zero byte that ends a gzip member anyway (the high byte of
its size), so the files are plain .warc.gz content, each of bounded size. A member of 16 MiB or more has
another last byte; an empty member follows it and ends in the zero.

The reader inflates member by member with an incremental zlib object, takes the
WARC header up to the blank line, frames the block by Content-Length and compares
the SHA-1 of payloads and blocks with the digests in the header.

Deduplication: of records with equal payloads of at least min_duplicate bytes, the
one with the largest id is the response and the others are revisits that refer to
it; rows that share the largest id are all responses, and so are rows with a null
id. A null payload is empty. Repeated rows give repeated records. Any other column
is ignored by the writer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._spark import scratch_path, split, written

#: Bytes of an archive, about (a single record may be larger); rows of revisits that are broadcast at most.
ARCHIVE_BYTES, FEW = 64 << 20, 200_000
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"
_ARROW = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])
_EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def _record_id(n: int | None) -> str:
    return "<urn:record:none>" if n is None else f"<urn:record:{n}>"


def _number(record_id: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:record:(-?\d+)>", record_id or b"")
    return int(m[1]) if m else None


def record(n: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one WARC record; a revisit keeps the HTTP head and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _record_id(n).encode(), b"WARC-Date: " + DATE.encode()]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], uri.encode()))
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _record_id(refers_to).encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"WARC-Payload-Digest: sha1:" + digest, b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as a gzip member, with the empty member after it where the last byte isn't zero."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if not out[-1] else out + _EMPTY_MEMBER


def members(archive: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """Inflate an archive member by member, a step of input at a time."""
    at = 0
    while at < len(archive):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = archive[at : at + step]
            if not len(piece):
                raise ValueError("the archive ends inside a member")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """One record: framed by Content-Length, its digests verified."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(head[b"content-length"])
    block = data[cut + 4 : cut + 4 + size]
    if len(block) != size or data[cut + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the block")
    at = block.index(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:at].split(b"\r\n")[1:])}
    payload, kind = block[at + 4 :], head[b"warc-type"].decode()
    sha1 = lambda x: b"sha1:" + base64.b32encode(hashlib.sha1(x).digest())
    good = sha1(block) == head[b"warc-block-digest"] and (kind == "revisit" or sha1(payload) == head[b"warc-payload-digest"])
    return {
        "id": _number(head.get(b"warc-record-id")), "uri": head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None, "record_type": kind, "refers_to": _number(head.get(b"warc-refers-to")),
        "payload_bytes": int(http[b"content-length"]), "payload_digest": base64.b32decode(head[b"warc-payload-digest"][5:]).hex(), "verified": good, "payload": payload,
    }


def mark_revisits(pages: DataFrame, key: str, payload: str, min_duplicate: int) -> DataFrame:
    """pages with _refers_to: the id of the response that a revisit refers to.

    Only ids and digests are compared, combined before the shuffle. Revisits that are few,
    once counted, are broadcast; of more, only the payloads move that may be one.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    ids = pages.where((F.octet_length(body) >= min_duplicate) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.sha2(body, 256).alias("_sha"))
    largest = ids.groupBy("_sha").agg(F.max("_id").alias("_refers_to"), F.min("_id").alias("_least")).where("_least < _refers_to").drop("_least")
    revisits = ids.join(largest, "_sha").where("_id < _refers_to").groupBy("_id", "_sha").agg(F.max("_refers_to").alias("_refers_to"))
    revisits = written(revisits, "revisits")
    whole = pages.withColumn("_id", F.col(key)).withColumn("_sha", F.when(F.octet_length(body) >= min_duplicate, F.sha2(body, 256)))
    if revisits.count() <= FEW:
        return whole.join(F.broadcast(revisits), ["_id", "_sha"], "left").drop("_id", "_sha")
    maybe, never = split(whole, "_id", revisits.select("_id"))
    return maybe.join(revisits, ["_id", "_sha"], "left").unionByName(never.withColumn("_refers_to", F.lit(None).cast("long"))).drop("_id", "_sha")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_duplicate: int = 1000, level: int = 4, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of pages to archives of about archive_bytes under path: a task fills one after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, places, size = [], [], 0

            def sent() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(places, pa.string())], ["value", "archive"])

            for n, u, p, r in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                held.append(member(record(n.as_py(), u.as_py(), p.as_py() or b"", r.as_py()), level)[:-1])
                places.append(f"{number}-{filled // archive_bytes}")
                filled += len(held[-1])
                size += len(held[-1])
                if size > 1 << 24:
                    yield sent()
                    held, places, size = [], [], 0
            if held:
                yield sent()

    marked = mark_revisits(pages.select(F.col(key).cast("long").alias(key), uri, payload), key, payload, min_duplicate)
    rows = marked.select(key, uri, F.col(payload).cast("binary").alias("body"), "_refers_to").mapInArrow(work, "value binary, archive string")
    rows.select(F.col("value").cast("string"), "archive").write.partitionBy("archive").option("lineSep", "\0").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path, one row each; payload is null for revisits, or where payloads is False."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for k in range(len(column)):
                held, size = [], 0
                for data in members(memoryview(column[k].as_buffer())):
                    if not data:
                        continue
                    row = parse(data)
                    if not payloads or row["record_type"] == "revisit":
                        row["payload"] = None
                    held.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(work, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archives(spark, path, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to,
       TRUE AS verified
FROM q
"""
