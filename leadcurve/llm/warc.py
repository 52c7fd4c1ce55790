"""WARC archives: writing, reading back, and revisit records for equal payloads.

Payloads are never joined into one value. A row's payload is cut into chunks of
``chunk_bytes`` where it is read: rows of record id, chunk number and bytes. Digests are
carried from chunk to chunk as the rows stream by. In an archive, a payload of several
chunks is a segmented record (WARC-Segment-Number, a ``continuation`` record for each
further chunk), so a record in a file is never larger than a chunk and its headers.

A file is written by Spark's text sink, one WARC record per row with the blank lines that
end a record as the separator, and holds a bounded number of rows; it is read as one
binary file of bounded size. On reading, a record that is whole in its file is
finished there. Chunks of segmented records go to their record id, are sorted by
number there, and stream through one digest.

A null payload is empty. Record ids number the rows of the written table; equal rows,
repeated or null page ids are separate records. Of records with equal payloads of at
least ``least_bytes``, those with the smallest page_id are responses and the others
revisit that page_id; a null page_id counts as larger than any.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.frames import own_columns, partitions, staged, tidy
from leadcurve.session import shared_folder

CHUNK_BYTES = 1 << 16
FILE_ROWS = 512  # so a file holds at most FILE_ROWS * (CHUNK_BYTES + headers)
FLUSH_BYTES = 4 << 20

_CRLF = "\r\n"
_DATE = "2000-01-01T00:00:00Z"  # the tables hold no fetch time, and a file should not change between runs
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DIGEST = re.compile(rb"sha1:([A-Z2-7]{32})")

_READ = (
    "record_id string, page_id long, chunk int, last boolean, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """record_id, page_id, url, chunk (from 0), last and data, in the order of the rows; ``pages`` has payload."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    last = F.greatest(F.expr(f"(length(payload) - 1) DIV {chunk_bytes}"), F.lit(0)).cast("int")
    rows = pages.withColumn("payload", payload)
    rows = rows.select("record_id", "page_id", "url", "payload", last.alias("_last"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return rows.select(
        "record_id", "page_id", "url", "chunk", (F.col("chunk") == F.col("_last")).alias("last"),
        F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
    )


_CHUNK = pa.schema(
    [
        ("record_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()),
        ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)


def with_digests(chunks: DataFrame) -> DataFrame:
    """``chunks`` with payload_bytes and payload_digest on each record's last row.

    A record's rows follow one another in a task, as ``chunked`` leaves them.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, shas = [], []
            data = batch.column("data")
            for i, last in enumerate(batch.column("last").to_pylist()):
                part = data[i].as_buffer()
                sha.update(part)
                size += part.size
                sizes.append(size if last else None)
                shas.append(base32(sha.digest()) if last else None)
                if last:
                    sha, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], _CHUNK.names
            )

    return chunks.select(*_CHUNK.names[:6]).mapInArrow(
        digest,
        "record_id long, page_id long, url string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string",
    )


def decided(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``digests`` with record_type and refers_to."""
    same = digests.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    groups = staged(same.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"), "payload-groups")
    joined = digests.join(groups.drop("n"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "record_id", "page_id", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _uri(name: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), name.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF)), F.lit(""))


def record_rows(chunks: DataFrame) -> DataFrame:
    """record_id, chunk and ``value``: a WARC record for each row of ``chunks`` (with its decision)."""
    first = F.col("chunk") == 0
    whole = first & F.col("last")
    revisit = F.col("record_type") == "revisit"
    kind = F.when(first, F.col("record_type")).otherwise("continuation")
    head = F.when(first, F.lit(_HTTP)).otherwise("")
    data = F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string"))
    segmented = ~whole & ~revisit
    own_id = F.when(first, F.col("record_id").cast("string")).otherwise(F.concat_ws("-", "record_id", "chunk"))
    size = F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("data"))
    value = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _uri(own_id)),
        _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\r\n]", " "))),
        _line("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _line("WARC-Segment-Number", F.when(segmented, F.col("chunk") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(segmented & ~first, _uri(F.col("record_id")))),
        _line("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("payload_bytes") + len(_HTTP))),
        _line("X-Page-ID", F.when(first, F.col("page_id"))),
        _line("X-Payload-Length", F.when(first, F.col("payload_bytes"))),
        _line("Content-Length", size),
        F.lit(_CRLF),
        head,
        data,
    )
    return chunks.filter(first | ~revisit).select("record_id", "chunk", value.alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes gzip archives of ``pages`` (page_id, url, payload) under ``path``."""
    numbered = pages.withColumn("record_id", F.monotonically_increasing_id())
    chunks = staged(with_digests(chunked(numbered, chunk_bytes)), "chunks")  # fixes the record ids
    digests = chunks.filter("last").select("record_id", "page_id", "payload_bytes", "payload_digest")
    verdict = decided(digests, least_bytes).drop("page_id")
    rows = record_rows(chunks.drop("payload_bytes", "payload_digest").join(verdict.hint("merge"), "record_id"))
    ordered = rows.sortWithinPartitions("record_id", "chunk").select("value")
    with tidy(pages.sparkSession):
        ordered.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


class _Reader:
    """Splits the bytes of one archive into records as they are inflated."""

    def __init__(self, name: str):
        self.name, self.held, self.need = name, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def records(self, data: memoryview) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        for at in range(0, len(data), FLUSH_BYTES):
            self.held += self.inflate.decompress(data[at : at + FLUSH_BYTES])
            yield from self._whole()
        self.held += self.inflate.flush()
        yield from self._whole()
        if self.held.strip():
            raise ValueError(f"{self.name} ends inside a record")

    def _whole(self) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        at = 0
        while len(self.held) - at >= self.need:
            head = self.held.find(b"\r\n\r\n", at)
            if head < 0:
                break
            lines = bytes(self.held[at:head]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError(f"{self.name} holds no record at a record's place")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            end = head + 4 + int(fields[b"content-length"])
            if len(self.held) < end + 4:
                self.need = end + 4 - at
                break
            yield fields, bytes(self.held[head + 4 : end])
            at, self.need = end + 4, 0
        del self.held[:at]


def _read_row(fields: dict[bytes, bytes], block: bytes) -> dict:
    number = lambda k: int(fields[k]) if k in fields else None
    last_id = lambda k: fields[k].rpartition(b":")[2].rstrip(b">").decode() if k in fields else None
    kind = fields[b"warc-type"].decode()
    segment = number(b"warc-segment-number")
    first = kind != "continuation"
    digest = _DIGEST.fullmatch(fields.get(b"warc-payload-digest", b""))
    refers = last_id(b"warc-refers-to")
    payload = block.partition(b"\r\n\r\n")[2] if first else block
    row = {
        "record_id": last_id(b"warc-record-id") if first else last_id(b"warc-segment-origin-id"),
        "page_id": number(b"x-page-id"), "chunk": (segment or 1) - 1,
        "last": segment is None or b"warc-segment-total-length" in fields,
        "record_type": kind if first else None,
        "payload_bytes": number(b"x-payload-length"), "payload_digest": digest[1].decode() if digest else None,
        "refers_to": int(refers) if refers else None, "data": payload,
    }
    if segment is None:  # all of it is here
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": base32(hashlib.sha1(payload).digest())}
        row["data"] = None
    return row


def read_archives(spark, path: str) -> DataFrame:
    """Rows of records and of the chunks of segmented records; whole records have their digest and no data."""
    schema = pa.schema(
        [
            ("record_id", pa.string()), ("page_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()),
            ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("refers_to", pa.int64()), ("data", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for fields, block in _Reader(name.as_py()).records(memoryview(content.as_buffer())):
                    rows.append(_read_row(fields, block))
                    size += len(rows[-1]["data"] or b"") + 200
                    if size >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(read, _READ)


def assembled(read: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size, head, next_ = hashlib.sha1(), 0, None, 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("record_id", "chunk", "last", "page_id", "record_type")}
                part = batch.column("data")[i].as_buffer()
                if row["chunk"] == 0:
                    sha, size, head, next_ = hashlib.sha1(), 0, row, 0
                if head is None or head["record_id"] != row["record_id"] or row["chunk"] != next_:
                    raise ValueError(f"a segment of record {row['record_id']} is missing")
                sha.update(part)
                size, next_ = size + part.size, next_ + 1
                if row["last"]:
                    rows.append(
                        {"page_id": head["page_id"], "payload_bytes": size, "payload_digest": base32(sha.digest()),
                         "record_type": head["record_type"], "refers_to": None}
                    )
                    head = None
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64())]
            ))

    whole = read.filter("data IS NULL").select(*columns)
    parts = read.filter("data IS NOT NULL").repartition(partitions(read.sparkSession), "record_id")
    joined = parts.sortWithinPartitions("record_id", "chunk").mapInArrow(
        join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(own_columns(pages, page_id="page_id", url="url", payload="html"), path, least_bytes, chunk_bytes)
    read = staged(read_archives(spark, path), "warc-records")  # read once for whole and for segmented records
    return assembled(read)
