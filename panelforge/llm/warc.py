"""Legacy archive converter: ARC files of version 1 and 2 to WARC 1.0.

ARC records are parsed by the header line of their file's version and their declared
lengths; WARC identifiers, timestamps, types and digests are synthesised.  Among records
of equal payload the one with the largest key is the response, the others revisit it.

Files are written and read by Spark's own ``text`` and ``binaryFile`` sources (a WARC
record ends with two line breaks, which is the writer's line separator), so archives may
lie in any store that Spark reaches.  A file holds a few times ``FILE_BYTES`` of payload at most, or
one record if that is longer; a reader holds one file at a time.

Defined cases: a null payload counts as empty; a null or odd url is percent-encoded
(null: empty); a null key is written as ``-`` and answers nothing but itself; repeated keys
stay separate records, each answered in the result; an empty table gives empty archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.store import new_path, small_batches

FILE_BYTES = 8 << 20
#: Header lines of the two published ARC versions (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ORIGIN = datetime(2000, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}/{digest}')}"


def arc_record(version: int, key: int | None, url: str | None, payload: bytes) -> bytes:
    """One ARC record: URL line, then an HTTP response whose header carries the key."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: {'-' if key is None else key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    date = (ORIGIN + timedelta(seconds=(key or 0) % (20 * 365 * 86400))).strftime("%Y%m%d%H%M%S")
    place = quote(url or "", safe=":/?#[]@!$&'()*+,;=-._~%") or "-"
    if version == 1:
        line = f"{place} 0.0.0.0 {date} text/html {len(block)}"
    else:
        line = f"{place} 0.0.0.0 {date} text/html 200 {payload_digest(payload)} - 0 - {len(block)}"
    return line.encode() + b"\n" + block


def arc_head(version: int) -> bytes:
    """The version block that begins an ARC file."""
    about = f"{version} 0 panelforge\n{ARC_FIELDS[version]}\n".encode()
    fields = "0.0.0.0 20000101000000 text/plain"
    if version == 2:
        fields += " 200 - - 0 -"
    return f"filedesc://part.arc {fields} {len(about)}\n".encode() + about


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, by its version's fields and the declared lengths."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"record at byte {at} declares {length} bytes, the file has {len(block)}")
        at = end + 1 + length
        if parts[0].startswith("filedesc://"):
            version = int(block.split(b" ", 1)[0])
            fields = ARC_FIELDS[version].split(" ")
            continue
        if fields is None or len(parts) != len(fields):
            raise ValueError(f"header line with {len(parts)} fields does not fit the file's version")
        yield dict(zip(fields, parts)) | {"block": block}


def _key(text: str) -> int | None:
    return None if text == "-" else int(text)


def converted(record: dict) -> tuple[int, str, str, bytes, bytes]:
    """(key, url, WARC date, HTTP header, payload) of an ARC record."""
    head, _, payload = record["block"].partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])
    date = datetime.strptime(record["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    url = record["URL"]
    return _key(lines["X-Record-Key"]), "" if url == "-" else url, date, head, payload


def warc_record(key: int, url: str, date: str, head: bytes, payload: bytes, answers: int) -> bytes:
    """A WARC record without its closing line breaks; ``answers`` is the response's key."""
    digest = payload_digest(payload)
    kind = "response" if answers == key else "revisit"
    block = head + b"\r\n\r\n" + (payload if kind == "response" else b"")
    fields = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(key, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(answers, digest)}>", f"X-Refers-To-Key: {answers}"]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, length = end + 4, int(fields["Content-Length"])
        yield fields, data[start : start + length]
        at = start + length + 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _inflate(data: bytes) -> bytes:
    return zlib.decompressobj(47).decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write rows as gzipped ARC files, versions 1 and 2 in turn by partition."""
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("bigint").alias("key"), pages[url_col].cast("string").alias("url"), pages[body_col].cast("binary").alias("body"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 300), F.lit(0)).alias("n")).first().n
    # The scan's own partitions serve as files unless they would be too long.
    if size > 4 * FILE_BYTES * rows.rdd.getNumPartitions():
        rows = rows.repartition(max(1, -(-size // FILE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        made, held = [arc_head(version)], 0
        for batch in batches:
            for key, url, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made.append(arc_record(version, key, url, body or b""))
                held += len(made[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
                    made, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """key, url, date, head, payload, digest of every ARC record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                made, held = [], 0
                for record in parse_arc(_inflate(content.as_py())):
                    key, url, date, head, payload = converted(record)
                    made.append((key, url, date, head, payload, payload_digest(payload)))
                    held += len(payload)
                    if held > 1 << 22:
                        yield _batch(made)
                        made, held = [], 0
                yield _batch(made)

    def _batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], ["key", "url", "date", "head", "payload", "digest"])

    return _files(spark, path).mapInArrow(run, "key bigint, url string, date string, head binary, payload binary, digest string")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert ARC files to gzipped WARC files.

    The response of each digest is found by an aggregate of keys alone; the payloads
    move once, to meet it.  A digest that many records share is split by the join.
    """
    records = read_arc(spark, arc_path)
    answers = records.groupBy("digest").agg(F.max("key").alias("answers"))
    joined = records.join(answers, "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [warc_record(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(6)))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    out = joined.select("key", "url", "date", "head", "payload", "answers").mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record.

    A response's digest and length are computed from its block, a revisit's are those of
    its header, as a revisit carries no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in parse_warc(_inflate(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    key = _key(dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])["X-Record-Key"])
                    if fields["WARC-Type"] == "response":
                        rows.append((key, fields["WARC-Target-URI"], len(payload), payload_digest(payload), "response", None))
                    else:
                        rows.append((key, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["X-Refers-To-Key"])))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows to ARC files, ARC to WARC files in the shared folder, and the WARC files read back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, body_col)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
