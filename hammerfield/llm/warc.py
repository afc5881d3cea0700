"""WARC archives: written as whole-file gzip streams, normalised to one gzip member for each record with a sidecar
offset index, and read back through that index.

Archives are real .warc.gz files in a shared folder, of about `rotate` uncompressed bytes. A task holds one archive
at a time. Tasks name their files by partition, so a task that runs again writes the same files again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_file, write_file
from .workspace import new_dir, stage, text_batches

ROTATE = 32 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<{URN}{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id; None for a record without one."""
    value = (record or "").strip("<>").removeprefix(URN)
    return None if value in ("", "none") else int(value)


def safe_uri(url: str | None, page_id: int | None) -> str:
    """A header-safe target URI: control characters and spaces are percent-encoded, a missing one is the record's own."""
    if not url:
        return record_id(page_id).strip("<>")
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the payload's digest and length but not the payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisit_of is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    block = HTTP % len(payload)
    if revisit_of is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {record_id(revisit_of)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate_records(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, inflated once from start to end whatever its members are.

    The buffer holds one record and one inflated piece. A stream cut short, or bytes after the last record, raise.
    """
    buffer, at, view = bytearray(), 0, memoryview(data)
    inflater = zlib.decompressobj(31)
    need = 0  # bytes of the record at the start of the buffer, once its head is there
    while True:
        while True:
            if not need and (end := buffer.find(b"\r\n\r\n")) >= 0:
                need = end + 4 + int(parse_head(bytes(buffer[:end]))["content-length"]) + 4
            if not need or len(buffer) < need:
                break
            if buffer[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
        if inflater.eof:
            view, at = memoryview(inflater.unused_data + bytes(view[at:])), 0
            if not view:
                break
            inflater = zlib.decompressobj(31)
        tail = inflater.unconsumed_tail
        if not tail:
            if at >= len(view):
                raise ValueError("gzip stream is cut short")
            tail, at = view[at : at + piece], at + piece
        buffer += inflater.decompress(tail, piece)
    if buffer:
        raise ValueError("bytes after the last record")


def normalise(data: bytes, level: int = LEVEL) -> tuple[bytes, list[dict]]:
    """Each record of a gzip file as a member of its own, and the index of their places."""
    out, index = bytearray(), []
    for record in inflate_records(data):
        head = parse_head(record[: record.index(b"\r\n\r\n")])
        deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = deflater.compress(record) + deflater.flush()
        index.append({"id": head["warc-record-id"], "uri": head["warc-target-uri"], "type": head["warc-type"], "offset": len(out), "length": len(member)})
        out += member
    return bytes(out), index


def read_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); the payload's digest is checked."""
    end = record.index(b"\r\n\r\n")
    head = parse_head(record[:end])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if head["warc-type"] == "revisit":
        return page_of(head["warc-record-id"]), int(head["x-payload-length"]), digest, "revisit", page_of(head["warc-refers-to"])
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {head['warc-record-id']} does not match")
    return page_of(head["warc-record-id"]), len(payload), digest, "response", None


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, revisit_of of each page row.

    Only digests and page ids are grouped; the one row of a digest is joined back, so a payload that a third of the
    rows share is only a skewed join key. A null payload is empty. Rows that share both payload and largest page_id
    are all responses; a null page_id counts as smaller than any other.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("revisit_of"))


def write_monolithic(records: DataFrame, folder: str, rotate: int = ROTATE, level: int = LEVEL) -> DataFrame:
    """Write archives that are one gzip stream each; returns the staged list (name, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, made = TaskContext.get().partitionId(), 0, []
        state: dict = {}

        def close() -> None:
            nonlocal number
            data = state["out"] + state["z"].flush()
            name = f"part-{part:05d}-{number:04d}.warc.gz"
            write_file(f"{folder}/{name}", bytes(data))
            made.append((name, state["n"], len(data)))
            number += 1
            state.clear()

        for batch in batches:
            for page_id, url, payload, digest, revisit_of in zip(*(c.to_pylist() for c in batch.columns)):
                if not state:
                    state |= {"z": zlib.compressobj(level, zlib.DEFLATED, 31), "out": bytearray(), "n": 0, "raw": 0}
                record = make_record(page_id, url, payload, digest, revisit_of)
                state["out"] += state["z"].compress(record)
                state["n"] += 1
                state["raw"] += len(record)
                if state["raw"] >= rotate:
                    close()
        if state:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["name", "records", "bytes"])

    return stage(records.mapInArrow(write, "name string, records long, bytes long"), "warc-list")


def normalise_archives(spark: SparkSession, source: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every archive of source with one member for each record, each with its index file <name>.idx beside it."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = path.rpartition("/")[2]
                data, index = normalise(content.as_py(), level)
                write_file(f"{folder}/{name}", data)
                write_file(f"{folder}/{name}.idx", "".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([len(data)], pa.int64())], ["name", "records", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select("path", "content")
    return stage(files.mapInArrow(rewrite, "name string, records long, bytes long"), "warc-list")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, each member inflated on its own at the place its index names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_py())
                index = read_file(f"{folder}/{path.rpartition('/')[2]}.idx").splitlines()
                rows = []
                for x in map(json.loads, index):
                    rows.append(read_record(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], READ_SCHEMA.replace(",", "").split()[::2])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, least: int = 1000, rotate: int = ROTATE) -> DataFrame:
    """Write all pages (page_id, url, html) as archives, normalise them, and return what reading them gives.

    An empty table gives no archive and an empty result; extra columns are ignored.
    """
    spark = pages.sparkSession
    text_batches(spark)
    whole, split = new_dir(spark, "warc-whole"), new_dir(spark, "warc")
    if write_monolithic(with_revisits(pages, least), whole, rotate).isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    normalise_archives(spark, whole, split)
    return read_archives(spark, split)
