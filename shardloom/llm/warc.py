"""WARC archives as chunked record tables.

A payload is never one allocation on the way out or back: it becomes rows of
(record, chunk number, bytes), each with the SHA-1 of all bytes up to its end.
Each chunk is one WARC record: a first segment, or a ``continuation`` as WARC 1.1
provides for oversized payloads. Spark's text writer and reader move the records,
so archives can lie in any store that Spark reaches; a lost executor costs only
its files.

The reader cuts files at the line between two records. The writer never lets a
chunk hold that line: it ends the chunk within it.

Defined results: a null payload is an empty one; null page ids are larger than
others; rows that share the smallest id of their payload are all responses; URLs
and payloads may be of any length; columns besides page_id, url and payload are not
looked at, whatever they are called; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256 << 10
#: Bytes of payload in one archive file.
FILE_BYTES = 64 << 20
#: Output rows are handed over at this many bytes.
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_BETWEEN = b"\r\n\r\nWARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

_CHUNK = (
    "record_id string, page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, "
    "payload_digest string, chunk_no int, last boolean, prefix_digest string, chunk binary"
)
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks int, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload")
        digests, sizes = [], []
        for x in payloads:
            data = memoryview(x.as_buffer()) if x.is_valid else b""
            digests.append(base32(hashlib.sha1(data).digest()))
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            names=["page_id", "payload_bytes", "payload_digest"],
        )


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, first_id): first_id has the same payload and the smallest id.

    Payloads under ``least_bytes`` have themselves as first. ``pages``: page_id, payload.
    """
    from .store import bound_batches, materialize

    bound_batches(pages.sparkSession)
    digests = materialize(
        pages.select("page_id", "payload").mapInArrow(_digests, "page_id long, payload_bytes long, payload_digest string"), "digests"
    )
    firsts = digests.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    firsts = materialize(firsts, "firsts")
    first = F.when(F.col("payload_bytes") >= least_bytes, F.col("first_id")).otherwise(F.col("page_id"))
    return digests.join(firsts, ["payload_digest", "payload_bytes"]).select(
        "page_id", "payload_bytes", "payload_digest", first.alias("first_id")
    )


def _cuts(payload: memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most ``size`` bytes none of which, behind its header, holds the line between records."""
    at = 0
    while True:
        end = min(at + size, len(payload))
        found = (_BETWEEN[:4] + bytes(payload[at:end])).find(_BETWEEN)
        if found >= 0:
            end = at + found + 2  # between "WA" and "RC"
        yield at, end
        at = end
        if at >= len(payload):
            return


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "first_id"]
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for i, (page, url, length, digest, first) in enumerate(zip(*columns, strict=True)):
                payload = batch.column("payload")[i]
                revisit = first is not None and page != first
                kind = "revisit" if revisit else "response"
                head = (f"urn:page:{page}:{kind}", page, kind, first if revisit else None, url, length, digest)
                data = memoryview(payload.as_buffer()) if payload.is_valid and not revisit else memoryview(b"")
                running = hashlib.sha1()
                for k, (a, b) in enumerate(_cuts(data, size)):
                    running.update(data[a:b])
                    rows.append((*head, k, b >= len(data), base32(running.copy().digest()), bytes(data[a:b])))
                    held += b - a + 300
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    names = [c.split(" ")[0] for c in _CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def chunk_table(pages: DataFrame, plan: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of pages (page_id, url, payload). Chunks of a record are consecutive rows."""
    total = plan.agg(F.sum("payload_bytes")).first()[0] or 0
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    pages = pages.select("page_id", "url", "payload")
    plan = plan.distinct().withColumn("digest", F.col("payload_digest")).drop("payload_digest")
    # pages that share an id can differ in their payload, so the payload's own hash is part of the key
    keyed = pages.withColumn("hash", F.unhex(F.sha1(F.coalesce("payload", F.lit(b"")))))
    plan = plan.withColumn("hash", _from_base32(F.col("digest")))
    keyed = keyed.withColumn("pk", F.coalesce("page_id", F.lit(-1))).repartition(n, "pk")
    plan = plan.withColumn("pk", F.coalesce("page_id", F.lit(-1))).drop("page_id").repartition(n, "pk")
    both = keyed.join(plan.hint("shuffle_hash"), ["pk", "hash"])
    both = both.select("page_id", "url", "payload", "payload_bytes", F.col("digest").alias("payload_digest"), "first_id")
    return both.mapInArrow(_chunks(size), _CHUNK)


def _from_base32(column):
    """Bytes of a base32 string of 32 characters, with the alphabet of RFC 4648."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = F.translate(column, letters, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 4 * k, 4), 32, 16), 5, "0") for k in range(8)]
    return F.unhex(F.concat(*parts))


def _serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            revisit, segmented = r["record_type"] == "revisit", r["chunk_no"] or not r["last"]
            block = (_HTTP % r["payload_bytes"] if not r["chunk_no"] else b"") + r["chunk"]
            kind = "continuation" if r["chunk_no"] else r["record_type"]
            uri = r["target_uri"] if r["target_uri"] else f"urn:page:{r['page_id']}"
            name = r["record_id"] + (f":{r['chunk_no'] + 1}" if r["chunk_no"] else "")
            head = [
                f"WARC-Type: {kind}",
                f"WARC-Record-ID: <{name}>",
                f"WARC-Date: {DATE}",
                f"WARC-Target-URI: {quote(uri, safe=_URI)}",
                "Content-Type: application/http; msgtype=response",
                f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
                f"X-Page-ID: {'' if r['page_id'] is None else r['page_id']}",
                f"X-Payload-Length: {r['payload_bytes']}",
                f"X-Prefix-Digest: sha1:{r['prefix_digest']}",
            ]
            if revisit:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers_to']}:response>"]
            if segmented:
                head.append(f"WARC-Segment-Number: {r['chunk_no'] + 1}")
            if r["chunk_no"]:
                head.append(f"WARC-Segment-Origin-ID: <{r['record_id']}>")
                if r["last"]:
                    head.append(f"WARC-Segment-Total-Length: {len(_HTTP % r['payload_bytes']) + r['payload_bytes']}")
            head.append(f"Content-Length: {len(block)}")
            # the writer adds the last line feed
            out.append(b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


_URI = ":/?#[]@!$&'()*+,;=%~"


def write_archive(chunks: DataFrame, path: str) -> None:
    """Write a chunked record table as gzip WARC files below ``path``."""
    records = chunks.mapInArrow(_serialize, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("compression", "gzip").text(path)
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.endswith(".txt.gz"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(top, name[: -len(".txt.gz")] + ".warc.gz"))


def _blank_line(view: memoryview) -> int:
    """Where the first blank line begins, from as much of ``view`` as that needs; -1 if there is none."""
    size = 16 << 10
    while True:
        found = bytes(view[:size]).find(b"\r\n\r\n")
        if found >= 0 or size >= len(view):
            return found
        size *= 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for value in batch.column("value"):
            view = memoryview(value.as_buffer())
            end = _blank_line(view)
            if end < 0 and not bytes(view).strip():
                continue
            lines = bytes(view[:end]).decode().split("\r\n")
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines if not x.startswith("WARC/"))
            length = int(head["Content-Length"])
            block = view[end + 4 : end + 4 + length]
            if len(block) != length:
                raise ValueError(f"{head.get('WARC-Record-ID')}: {len(block)} of {length} bytes")
            kind, number = head["WARC-Type"], int(head.get("WARC-Segment-Number") or 1)
            if kind not in ("response", "revisit", "continuation"):
                continue
            if kind != "continuation":
                block = block[_blank_line(block) + 4 :] if bytes(block[:5]) == b"HTTP/" else block
            page = head.get("X-Page-ID")
            refers = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").partition(":")[0]
            last = "WARC-Segment-Total-Length" in head or "WARC-Segment-Number" not in head
            origin = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]).strip("<>")
            rows.append((origin, int(page) if page else None, kind, int(refers) if refers else None, head.get("WARC-Target-URI"), int(head.get("X-Payload-Length", len(block))), head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number - 1, last, head.get("X-Prefix-Digest", "").removeprefix("sha1:"), bytes(block)))
            held += len(block) + 300
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of an archive. Chunks of a record are consecutive rows."""
    raw = spark.read.option("lineSep", _BETWEEN.decode()).schema("value string").text(path)
    return raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, _CHUNK)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "last", "prefix_digest"]
    kind = refers = None
    running, size, intact = hashlib.sha1(), 0, True
    for batch in batches:
        rows = []
        columns = [batch.column(n).to_pylist() for n in names]
        for i, (record, page, what, ref, length, digest, no, last, prefix) in enumerate(zip(*columns, strict=True)):
            if no == 0:
                running, size, kind, refers, intact, expected = hashlib.sha1(), 0, what, ref, True, 0
            if no != expected:
                raise ValueError(f"{record}: chunk {no} where {expected} belongs")
            expected += 1
            data = memoryview(batch.column("chunk")[i].as_buffer())
            running.update(data)
            size += len(data)
            now = base32(running.copy().digest())
            intact &= not prefix or now == prefix
            if last:
                revisit = kind == "revisit"
                intact &= revisit or not digest or now == digest and size == length
                rows.append((page, length if revisit else size, digest if revisit else now, kind, refers, no + 1, intact))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        out = [c.split(" ")[0] for c in _RECORD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record, digested chunk by chunk; intact: every digest on the way agrees."""
    return chunks.mapInArrow(_records, _RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    from .store import new_path, table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = new_path(spark, "warc")
    write_archive(chunk_table(pages, plan_records(pages, least_bytes=0)), path)
    records = read_records(read_chunks(spark, path))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
q AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(x, 1 + 5 * k, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(v, lambda n:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM q"""
