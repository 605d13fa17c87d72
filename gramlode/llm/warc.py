"""WARC archives: written with one gzip member per record, read back in byte ranges.

A record whose payload is a copy of an earlier one is a revisit that points to the response and carries no payload.
The reader splits every file into byte ranges. A task looks for the gzip magic in its range, takes a place for the
start of a member if it decodes to a WARC header there, and owns the records that start in its range, to their end.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.session import scratch_path, stored

#: A payload shorter than this is always stored.
LEAST_REVISIT = 100
SPLIT = 4 << 20
#: Tasks that ranges are dealt to at most.
RANGE_TASKS = 10_000
#: Read at once while looking for members.
WINDOW = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
READ = "path string, offset long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record before compression; a revisit if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id} {digest}")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to} {digest}')}>"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        final = f"{root}/part-{task.partitionId():05d}.warc.gz"
        # an attempt writes beside the others and takes the final name when it is whole
        draft = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        size = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    packed = _member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                    out.write(packed)
                    size += len(packed)
        if size:
            store.move(draft, final)
            yield pa.record_batch([pa.array([f"{folder}/{final.rsplit('/', 1)[1]}"]), pa.array([size], pa.int64())], ["path", "length"])
        else:
            store.delete_file(draft)

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` and return ``path, length`` of the files.

    Among rows with equal payloads of at least ``LEAST_REVISIT`` bytes those with the smallest page id are responses,
    the others revisit them; a row without id revisits too, unless none of its copies has an id. A null html is an empty
    payload. No rows give no files. ``folder`` must be one that all executors reach, by a scheme that pyarrow opens.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # one row per payload that occurs more than once; equal payloads meet as counts, not as texts
    copies = (
        rows.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    own = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    typed = rows.join(copies, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~own, F.col("first")).alias("refers_to")
    )
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    return stored(typed.mapInArrow(_write(folder), "path string, length long"), "warc-files")


def decoded(read, start: int, length: int) -> tuple[bytes, int] | None:
    """The member that starts at ``start`` and its size in the file, or None if none does. ``read(at, n)`` reads a file."""
    unpack = zlib.decompressobj(31)
    at, parts = start, []
    while not unpack.eof and at < length:
        raw = read(at, 64 << 10)
        if not raw:
            return None
        try:
            parts.append(unpack.decompress(raw))
        except zlib.error:
            return None
        if len(parts) == 1 and not parts[0].startswith(b"WARC/"):
            return None
        at += len(raw)
    return (b"".join(parts), at - len(unpack.unused_data) - start) if unpack.eof else None


def members(read, begin: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records that start in ``[begin, end)`` of a file of ``length`` bytes."""
    at = begin
    while at < end:
        window = read(at, min(WINDOW, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += WINDOW
            continue
        if at + found >= end:
            return
        whole = decoded(read, at + found, length)
        if whole is None:
            at += found + 1
            continue
        yield at + found, whole[0]
        at += found + whole[1]


def parsed(content: bytes) -> dict:
    """The fields of one record. A response's size and digest are taken from the payload itself."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_type": kind,
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2] if payload is None else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": number("X-Payload-Length") if payload is None else len(payload),
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload,
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for part in batch.to_pylist():
            store, root = fs.FileSystem.from_uri(part["path"])
            rows, held = [], 0
            with store.open_input_file(root) as file:
                read = lambda at, n: file.read_at(n, at)  # noqa: E731, B023
                for offset, content in members(read, part["begin"], part["end"], part["length"]):
                    rows.append({"path": part["path"], "offset": offset, **parsed(content)})
                    held += len(content)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of ``files`` (``path, length``), each read by the task in whose byte range it starts."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    ranges = (
        files.where("length > 0")
        .select("path", "length", begin.alias("begin"))
        .withColumn("end", F.least(F.col("begin") + split, F.col("length")))
    )
    # a fixed number of partitions: ranges are tiny rows, and joining them by their size would leave all reading to one task
    most = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, min(int(most), RANGE_TASKS)), "path", "begin").mapInArrow(_scan, READ)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the scratch folder and read them back."""
    return read_warc(write_warc(pages, scratch_path(spark, "warc")))
