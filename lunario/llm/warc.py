"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key. Every task writes its range to gzip files, one member for each
record, and begins a new file when the compressed size reaches a limit. All headers are made anew
from the row (lengths, SHA-1 digests, record ids that depend on key and payload), so equal input
gives equal bytes wherever a task runs. A file appears under its name only when complete; the rows
that tasks return are the manifest, and readers open only what it lists.

Of records with equal large payloads the one with the largest key is a response; the others are
revisit records that refer to it. Which those are is decided on digests alone; a mark for each is
sorted in just before its record, so pages are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.common import scratch, written
from lunario.llm.files import Folder

#: Payloads of at least this many bytes are stored once.
SHARED_BYTES = 1000
#: Compressed bytes after which a file is closed.
FILE_BYTES = 256 << 20
#: Stands for the capture time, which the tables do not have.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lunario:warc")
_MANIFEST = "file string, first_key long, records long, bytes long, sha1 string"
_RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "record_id string, refers_to_id string"
)


# --- one record -----------------------------------------------------------------------------------


def record_id(key: int | None, digest: str, nth: int = 0) -> str:
    """Id of the nth record with this key and payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}' + (f':{nth}' if nth else ''))}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(pairs: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{name}: {value}\r\n".encode() for name, value in pairs)


def _uri(url: str | None, key: int | None) -> str:
    """The URL without characters that end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{key}")


def record(
    key: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers: str | None
) -> bytes:
    """A response record, or with ``refers`` a revisit of that record, as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\n" + _fields(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    ) + b"\r\n"
    block = http if refers else http + payload
    head = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(key, digest, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, key)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", _digest(block)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)] if refers else []),
        ("WARC-Page-ID", "" if key is None else str(key)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return member(b"WARC/1.1\r\n" + _fields(head) + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def opening() -> bytes:
    """The record that opens every file."""
    block = _fields([("software", "lunario"), ("format", "WARC File Format 1.1")])
    head = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, 'warcinfo')}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(block))),
    ]
    return member(b"WARC/1.1\r\n" + _fields(head) + b"\r\n" + block + b"\r\n\r\n")


# --- writing --------------------------------------------------------------------------------------


def _revisits(slim: DataFrame) -> DataFrame:
    """``_key``, ``_sha`` and ``_refers`` of the records that repeat a larger key's payload."""
    large = slim.filter(F.col("_bytes") >= SHARED_BYTES)
    groups = written(
        large.groupBy("_sha", "_bytes")
        .agg(F.max("_key").alias("_refers"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_sha", "_bytes", "_refers"),
        "payload-groups",
    )
    return written(
        large.join(groups, ["_sha", "_bytes"])
        .filter(~F.col("_key").eqNullSafe(F.col("_refers")))
        .select("_key", "_sha", "_refers"),
        "revisits",
    )


def write(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
    html: str = "html", file_bytes: int = FILE_BYTES,
) -> tuple[str, DataFrame]:
    """Write one record for each row; returns the folder and the manifest.

    A NULL payload is empty. NULL keys come first, and a NULL or empty URL becomes a URN of the key.
    Of rows that repeat key and large payload, the first is the response that the others revisit.
    Further columns of ``pages`` are not read. An empty table gives an empty manifest.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("_key"),
        F.sha1(body).alias("_sha"),
        F.octet_length(body).cast("long").alias("_bytes"),
        F.col(url).alias("_url"),
        body.alias("_body"),
    )
    marks = _revisits(rows.select("_key", "_sha", "_bytes"))
    both = rows.select(
        "_key", "_sha", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_refers"), "_url",
        "_body",
    ).unionByName(
        marks.select("_key", "_sha", F.lit(0).alias("_kind"), "_refers"), allowMissingColumns=True
    )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, part, number = Folder(folder), TaskContext.get().partitionId(), 0
        out = first = check = None
        count, mark, last, nth, done = 0, None, None, 0, []

        def close():
            nonlocal out, count, number
            out.commit()
            done.append((out.name, first, count, out.size, check.hexdigest()))
            out, count, number = None, 0, number + 1

        def put(data: bytes) -> None:
            out.write(data)
            check.update(data)

        for batch in batches:
            for k, sha, kind, refers, link, payload in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                if kind == 0:
                    mark = (k, sha, refers)
                    continue
                nth = nth + 1 if last == (k, sha) else 0
                last, of = (k, sha), None
                if mark is not None and mark[:2] == last:
                    of = record_id(mark[2], sha)
                elif nth and len(payload) >= SHARED_BYTES:
                    of = record_id(k, sha)
                if out is None:
                    name = f"pages-{part:06d}-{number:06d}.warc.gz"
                    out, first, check = target.create(name), k, hashlib.sha1()
                    put(opening())
                put(record(k, link, payload, sha, nth, of))
                count += 1
                if out.size >= file_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*done, strict=True),
                    (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["file", "first_key", "records", "bytes", "sha1"],
            )

    manifest = (
        both.repartitionByRange("_key", "_sha")
        .sortWithinPartitions("_key", "_sha", "_kind")
        .mapInArrow(store, _MANIFEST)
    )
    return folder, written(manifest, "warc-manifest")


# --- reading --------------------------------------------------------------------------------------


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one by one."""
    rest, unpack, parts = b"", None, []
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if unpack is not None:
                raise OSError("the archive ends inside a record")
            return
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        parts.append(unpack.decompress(data))
        if unpack.eof:
            rest, unpack = unpack.unused_data, None
            yield b"".join(parts)


def _split(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {n.lower(): v for n, _, v in (x.partition(": ") for x in lines)}, body


def parsed(data: bytes) -> tuple | None:
    """A row of the reader from one record; None for other types. Digests are computed again."""
    head, rest = _split(data)
    block = rest[: int(head["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise OSError("a record has not the length it states")
    if head["warc-type"] not in ("response", "revisit"):
        return None
    if head["warc-block-digest"] != _digest(block):
        raise OSError("a block has not the digest it states")
    http, payload = _split(block)
    length, digest = int(http["content-length"]), head["warc-payload-digest"]
    if head["warc-type"] == "response" and (len(payload) != length or _digest(payload) != digest):
        raise OSError("a payload has not the length and digest it states")
    page = head["warc-page-id"]
    return (
        int(page) if page else None,
        head["warc-target-uri"],
        length,
        base64.b32decode(digest.removeprefix("sha1:")).hex(),
        head["warc-type"],
        head["warc-record-id"],
        head.get("warc-refers-to"),
    )


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of all files in a manifest; damaged ones are an error.

    Columns: ``page_id``, ``url``, ``payload_bytes`` and ``payload_digest`` (of the whole payload,
    also for revisits), ``record_type``, ``record_id`` and ``refers_to_id``.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Folder(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            for name, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, seen = [], 0
                with source.stream(name) as stream:
                    for data in members(stream):
                        if (row := parsed(data)) is not None:
                            rows.append(row)
                            seen += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names
                            )
                            rows = []
                if seen != records:
                    raise OSError(f"{name} has {seen} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names
                    )

    files = manifest.select("file", "records")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(load, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Add ``refers_to``: the key of the response that a revisit names; None for responses."""
    stored = written(records, "warc-records")
    target = stored.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    revisits = stored.filter("record_type = 'revisit'").join(target, "refers_to_id", "left")
    return stored.filter("record_type = 'response'").withColumn(
        "refers_to", F.lit(None).cast("long")
    ).unionByName(revisits)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return resolved(read(*write(pages))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d
  FROM pages
), g AS (
  SELECT d, n, max(page_id) AS top FROM p WHERE n >= {SHARED_BYTES} GROUP BY d, n
)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
