"""WARC archives: written by Spark, read back record by record.

Writing. Each page becomes one record in a gzip member of its own. Pages with
equal payloads of at least `min_bytes` bytes are one group: the smallest page
id keeps the payload as a `response`, the others are `revisit` records that
name it. Archives are files of Spark's own writer, so its commit protocol holds
and any file system works: the last byte of a gzip member is the top byte of a
length below 16 MiB, that is 0, and serves as the writer's record separator. A
longer record is followed by an empty member, which ends in 0 too.

Reading. A task takes an archive, decompresses member after member with an
incremental zlib object, frames each record by its Content-Length, and checks
block and payload digests.

Defined results: a null html is an empty payload, a null url an empty target.
Rows that agree in id and payload are numbered; the first is the response. A
null id sorts after all others. A broken archive stops the reader with an error
naming the file. An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import map_rows, text_bytes
from newsloom.session import checkpoint_dir, cut

MOST_RECORDS = 20_000        # of an archive; its bytes follow from the size of a shuffle partition
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_LARGEST = 1 << 24           # records below this end their member in a 0 byte


class Record(NamedTuple):
    kind: str
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def pack(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """One record as a gzip member that ends in a 0 byte."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http if refers_to else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(*refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + _END
    data = head + block + _END
    return _member(data) if len(data) < _LARGEST else _member(data) + _member(b"")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive, given its bytes in pieces of any size."""
    packed, plain = zlib.decompressobj(31), bytearray()
    open_member = False
    for piece in pieces:
        while piece:
            plain += packed.decompress(piece)
            open_member = True
            piece = packed.unused_data
            if packed.eof:
                if plain:
                    yield parse(bytes(plain))
                packed, plain, open_member = zlib.decompressobj(31), bytearray(), False
    if open_member:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> Record:
    """A record from its plain bytes, with its digests checked."""
    head, found, rest = data.partition(_END)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != _END:
        raise ValueError(f"{headers.get('warc-record-id')}: content length {size} does not frame the block")
    if f"sha1:{digest(block)}" != headers["warc-block-digest"]:
        raise ValueError(f"{headers.get('warc-record-id')}: block digest differs")
    return Record(headers["warc-type"], headers, block)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = MIN_BYTES, most_records: int = MOST_RECORDS) -> None:
    """Write `pages` as archives into the folder `path`."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    # per payload its smallest id; per id and payload, how often: only narrow rows are shuffled
    times = rows.groupBy("sha1", "page_id").agg(F.count("*").alias("times"), F.max(F.octet_length("payload")).alias("bytes"))
    groups = times.groupBy("sha1").agg(F.min(order).alias("first"), F.sum("times").alias("members"),
                                       F.max("times").alias("times"), F.max("bytes").alias("bytes"))
    shared = cut(groups.filter("members > 1").select(
        "sha1", F.col("first.page_id").alias("first_id"), (F.col("bytes") >= min_bytes).alias("shared"), (F.col("times") > 1).alias("again")))
    # the only shuffle of payloads; its partitions become the archives, and a
    # group of copies too large for one is split by the skew join
    joined = rows.join(shared, "sha1", "left").withColumn("copy", F.lit(0))
    if not shared.filter("again").isEmpty():
        # repeated rows are numbered; only groups that hold some meet in a window
        again = rows.join(shared.filter("again"), "sha1").withColumn(
            "copy", F.row_number().over(Window.partitionBy("sha1", "page_id").orderBy("url")) - 1)
        joined = joined.filter(~F.coalesce("again", F.lit(False))).unionByName(again)
    rows = joined.select("page_id", "copy", "url", "payload", "first_id", F.coalesce("shared", F.lit(False)).alias("shared"))

    def make(batch: pa.RecordBatch) -> dict:
        out = []
        for p, copy, u, text, first, is_shared in zip(*(c.to_pylist() for c in batch.columns)):
            revisit = is_shared and (p, copy) != (first, 0)
            out.append(pack(p, copy, u, text_bytes(text), (first, 0) if revisit else None)[:-1])
        return {"record": pa.array(out, pa.binary())}

    packed = map_rows(rows, make, "record binary")
    packed.select(F.col("record").cast("string")).write.option("lineSep", "\0").option("compression", "none").option(
        "maxRecordsPerFile", most_records).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, the payload's digest verified where it is held."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "copy", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                rows, held = [], 0
                try:
                    for record in records(bytes(data[i:i + (1 << 16)]) for i in range(0, len(data), 1 << 16)):
                        rows.append(_row(record))
                        held += len(record.block)
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as error:
                    raise ValueError(f"{name}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.mapInArrow(make, "page_id long, copy long, record_type string, url string, payload binary, "
                                     "payload_bytes long, payload_digest string, refers_to long")


def _page(name: str) -> tuple[int | None, int]:
    page, copy = name.removeprefix("<urn:page:").removesuffix(">").split(":")
    return int(page) if page else None, int(copy)


def _row(record: Record) -> tuple:
    http, _, payload = record.block.partition(_END)
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    named = record.headers["warc-payload-digest"].removeprefix("sha1:")
    if record.kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"{record.headers['warc-record-id']}: payload digest differs")
    page, copy = _page(record.headers["warc-record-id"])
    refers = _page(record.headers["warc-refers-to"])[0] if record.kind == "revisit" else None
    return page, copy, record.kind, record.headers["warc-target-uri"], payload if record.kind == "response" else None, size, named, refers


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write `pages` to `path` (a new folder in the shared place by default) and
    read the archives back."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return read(spark, path)
