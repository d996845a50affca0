"""WARC archives: a distributed writer and a splittable reader of gzip members.

The writer makes one file per task, one gzip member per record. The reader cuts
files into byte ranges; a task scans its range for the gzip magic, takes a
candidate for a record if the whole member decodes (its checksum included), its
text starts with a WARC version line and what follows is the end of the file or
another magic, and then owns every record that starts inside its range, reading
on past the range's end to finish the last one.

Payloads of at least LEAST_BYTES that repeat are written once, as a response with
the largest page_id; the others are revisit records that refer to it.

Defined results: a null html is an empty payload; a null page_id is written as such
and is never the one referred to while others are there; rows that repeat a page_id
and payload are all responses if theirs is the largest; an empty table writes no
file and reads no rows; a very long payload is one record, which its range's task
reads past the range's end; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common

LEAST_BYTES = 1000
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
#: Bytes handed to the decoder at once: a small member copies no more.
FEED = 1 << 14
MAGIC = b"\x1f\x8b\x08"
DATE = "2026-01-01T00:00:00Z"


#: What stores are called by Hadoop and by pyarrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"} | {x: x for x in ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")}


def _file_system(uri: str):
    """(pyarrow file system, path) of a local, HDFS or object store address."""
    from pyarrow import fs

    scheme, there, rest = uri.partition("://")
    if not there:
        scheme, rest = "file", uri.removeprefix("file:")
    if scheme not in _SCHEMES:
        raise ValueError(f"archives cannot be kept under {uri}: tasks reach {', '.join(sorted(_SCHEMES))} only; name such a folder in spark.checkpoint.dir")
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}://{rest}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed as a member of its own."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every page; refers_to is null for responses.

    Repeats are found among digests alone. Payloads of at least ``least_bytes`` then
    meet what was found by page and digest, so equal pages are dealt evenly; smaller
    ones are not shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= least_bytes
    digests = common.settle(rows.filter(large).select("page_id", F.sha1("payload").alias("digest")), "digests")
    again = digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    revisits = digests.join(again, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    met = rows.filter(large).join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")
    return met.unionByName(rows.filter(~large).withColumn("refers_to", F.lit(None).cast("long")))


def write(rows: DataFrame, folder: str) -> list[str]:
    """Write the records under ``folder`` and return the files. A task that runs again replaces its own file as a whole."""

    def run(batches):
        fs, path = _file_system(folder)
        context, out, name = TaskContext.get(), None, None
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                    out = fs.open_output_stream(name, compression=None)
                out.write(record(page_id, url, payload, digest, refers_to, refers_to is not None))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]])], names=["name"])

    # only the attempts that Spark counts as done are named; what others left is not read
    made = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "name string")
    return sorted(f"{folder.rstrip('/')}/{r['name']}" for r in made.collect())  # a name for each task


def splits(files: list[str], split_bytes: int) -> list[tuple[str, int, int]]:
    """(file, start, end) of the byte ranges that tasks own."""
    out = []
    for f in files:
        fs, path = _file_system(f)
        size = fs.get_file_info(path).size
        out += [(f, s, min(size, s + split_bytes)) for s in range(0, size, split_bytes)]
    return out


class Range:
    """Bytes of a file from some place on, read as needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.data = file, size, start, bytearray()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        self.data += self.file.read(min(CHUNK, self.size - at))
        return True

    def drop(self, to: int) -> None:
        """Forget what lies before the place ``to``."""
        del self.data[: to - self.base]
        self.base = to


def member(source: Range) -> tuple[bytes, int] | None:
    """(text, end) of the gzip member at the range's first byte, if it is a whole WARC record's."""
    unpack, parts, at, told = zlib.decompressobj(31), [], 0, False
    while not unpack.eof:
        if at == len(source.data) and not source.more():
            return None
        piece = bytes(source.data[at : at + FEED])
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        at += len(piece) - len(unpack.unused_data)
        if not told and sum(map(len, parts)) >= 5:
            parts, told = [b"".join(parts)], True
            if not parts[0].startswith(b"WARC/"):
                return None
    while len(source.data) - at < len(MAGIC) and source.more():
        pass
    follows = source.data[at : at + len(MAGIC)]
    if follows and follows != MAGIC:
        return None
    text = b"".join(parts)
    return (text, source.base + at) if text.startswith(b"WARC/") else None


def records(uri: str, start: int, end: int):
    """The records that start in [start, end) of the file: (place, headers, block)."""
    fs, path = _file_system(uri)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as file:
        source, at = Range(file, size, start), start
        while at < end:
            source.drop(at)
            while len(source.data) < len(MAGIC) and source.more():
                pass
            found = source.data.find(MAGIC)
            while found < 0 and source.base + len(source.data) < min(size, end + len(MAGIC)):
                keep = max(0, len(source.data) - len(MAGIC) + 1)
                source.drop(source.base + keep)
                source.more()
                found = source.data.find(MAGIC)
            if found < 0 or source.base + found >= end:
                return
            at = source.base + found
            source.drop(at)
            got = member(source)
            if got is None:
                at += 1
                continue
            text, after = got
            head, _, rest = text.partition(b"\r\n\r\n")
            headers = {}
            for line in head.split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
            yield at, headers, rest[: int(headers.get("content-length", "0"))]
            at = after


def page_of(identifier: str) -> int | None:
    """The page_id in a record's identifier."""
    found = identifier.strip("<>").removeprefix("urn:page:")
    return int(found) if found.lstrip("-").isdigit() else None


def read(spark: SparkSession, files: list[str], split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record in the files."""
    ranges = splits(files, split_bytes)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    if not ranges:
        return spark.createDataFrame([], schema)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches):
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for _, headers, block in records(uri, start, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["warc-type"]
                    told = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != told:
                        raise ValueError(f"{uri}: a payload differs from its digest")
                    rows.append((page_of(headers["warc-record-id"]), size, told, kind, page_of(headers.get("warc-refers-to", "")), payload)[: len(types)])
                    held += len(payload)
                    if len(rows) >= 1000 or held > 1 << 23:
                        yield _batch(rows, types, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, types, schema)

    plan = spark.createDataFrame(ranges, "uri string, start long, stop long").repartition(len(ranges))
    return plan.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_batches(spark)
    files = write(planned(common.table(spark, sf_dir, "pages")), common.fresh_path(spark, "warc"))
    return read(spark, files)
