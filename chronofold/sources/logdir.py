"""Spark data sources over a directory of framed log files, and a writer that rotates them.

``spark.read.format("framed_log").option("path", dir)`` gives file, offset, commit_ts
and payload; ``spark.readStream`` with the same name follows the directory, file by
file. Files whose range of timestamps cannot meet the asked one (options ``start_ts``
and ``end_ts``) are not read. Where files' names tell their first timestamps, the
driver chooses; else each task looks at its own file and the next. A task reads one
file in chunks; segments are as long as a task should read. A range is an option and not
a pushed filter: Spark keeps what one plan pushed to a Python source for the next.

The record's first eight bytes are its commit_ts (little-endian). Options:
``value_log`` picks the other layout; ``start_ts`` and ``end_ts`` a range, inclusive on
both ends (no end if it is 0); ``file`` and ``offset`` a pointer from which on to read.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from chronofold.shipping import ship
from chronofold.sources import frames

SCHEMA = "file string, offset long, commit_ts long, payload binary"
#: Bytes of a file after which the writer begins another: one task's reading.
SEGMENT_BYTES = 128 << 20
CHUNK = 4 << 20
#: The date in the names of written files.
STAMP = "20260101000000"


def with_ts(commit_ts: int, payload: bytes) -> bytes:
    return struct.pack("<q", commit_ts) + payload


def ts_of(record: bytes) -> int:
    return struct.unpack_from("<q", record)[0]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def first_ts(uri: str, value_log: bool = False) -> int:
    """From the file's name, else from its first record; 0 for a file without any."""
    ts = frames.parse_name(uri.rpartition("/")[2])[1]
    return ts or next((ts_of(record) for _, record in stream(uri, value_log)), 0)


def max_ts(uri: str) -> int:
    """A value log's largest timestamp: from its footer, or by a scan where it was not finished."""
    fs, path = _file_system(uri)
    with fs.open_input_file(path) as f:
        f.seek(max(0, f.size() - 12))
        told = frames.footer_ts(f.read())
    return told if told is not None else max((ts_of(r) for _, r in stream(uri, True)), default=0)


def listed(folder: str) -> list[str]:
    """The log files in a folder, sorted by name."""
    from pyarrow import fs as pafs

    fs, path = _file_system(folder)
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file]
    return [f"{folder.rstrip('/')}/{n}" for n in frames.log_names(names)]


def stream(uri: str, value_log: bool = False, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a file's frames from an offset on, read in chunks; only one chunk, or a longer frame, is held."""
    fs, path = _file_system(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        if value_log and size >= 12:
            f.seek(size - 12)
            size -= 12 if frames.footer_ts(f.read()) is not None else 0
        held, base = bytearray(), at
        f.seek(at)
        while base + len(held) < size:
            need = max(CHUNK, len(held))  # a long frame doubles what is held
            held += f.read(min(need, size - base - len(held)))
            go_on = 0
            for place, record in frames.scan(bytes(held), 0, value_log, None, size - base):
                if record is None:
                    go_on = place
                else:
                    yield base + place, record
            del held[:go_on]
            base += go_on


class FileRange(InputPartition):
    """A file, its follower where a task is to look at both, and an offset."""

    def __init__(self, uri: str, following: str | None = None, look: bool = False, offset: int = 0):
        super().__init__((uri, following, look, offset))


class _Files:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.value_log = str(options.get("value_log", "false")).lower() == "true"
        self.start, self.stop = int(options.get("start_ts", 0)), int(options.get("end_ts", 0))
        self.file, self.offset = options.get("file"), int(options.get("offset", 0))

    def read(self, partition):
        uri, following, look, offset = partition.value
        if look:  # what pruned() does, by this file's and the next one's first timestamps
            if following and first_ts(following, self.value_log) <= self.start:
                return
            own = first_ts(uri, self.value_log)
            if own > self.start and self.stop and own > self.stop:
                return
        rows: list[tuple] = []
        for place, record in stream(uri, self.value_log, offset):
            ts = ts_of(record)
            if ts >= self.start and (not self.stop or ts <= self.stop):
                rows.append((uri, place, ts, record[8:]))
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class LogReader(_Files, DataSourceReader):
    def partitions(self):
        found = listed(self.folder)
        if self.file:
            found = [f for f in found if f.rpartition("/")[2] >= self.file]
        told = [frames.parse_name(f.rpartition("/")[2])[1] for f in found]
        ranged = bool(self.start or self.stop)
        look = ranged and not all(told)
        if ranged and not look:
            found = frames.pruned(list(zip(found, told, strict=True)), self.start, self.stop)
        following = [*found[1:], None]
        return [FileRange(f, n, look, self.offset if f.rpartition("/")[2] == self.file else 0) for f, n in zip(found, following, strict=True)]


class LogStreamReader(_Files, DataSourceStreamReader):
    """Follows a directory: the offset is the last file's name. Files appear whole and under rising names."""

    def initialOffset(self):
        return {"file": self.file or ""}

    def latestOffset(self):
        return {"file": max((f.rpartition("/")[2] for f in listed(self.folder)), default=self.file or "")}

    def partitions(self, start, end):
        return [FileRange(f) for f in listed(self.folder) if start["file"] < f.rpartition("/")[2] <= end["file"]]

    def commit(self, end):
        pass


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "offset", "commit_ts", "payload"])


class FramedLog(DataSource):
    @classmethod
    def name(cls):
        return "framed_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(dict(self.options))

    def streamReader(self, schema):
        return LogStreamReader(dict(self.options))


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FramedLog)


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    _ready(spark)
    return spark.read.format("framed_log").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def follow(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The directory as a stream: a batch takes the files that came since the last; Spark's checkpoint keeps the place."""
    _ready(spark)
    return spark.readStream.format("framed_log").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def write(records: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, partitions: int | None = None) -> list[str]:
    """Write (commit_ts, payload) in order of commit_ts as files that each begin another when full; returns them.

    Rows are ranged by commit_ts, so each task writes a stretch of the log and the
    first timestamp in a file's name lets readers choose. Tasks write under names of
    their own attempt; when all are done, the files of the attempts that count get
    suffixes without gaps, after those that are there, and so appear whole.
    """
    spark = records.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.select("commit_ts", "payload").repartitionByRange(n, "commit_ts").sortWithinPartitions("commit_ts")
    folder = folder.rstrip("/")
    apart = f"{folder}/_{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        fs, path = _file_system(apart)
        context, made, out, size = TaskContext.get(), [], None, 0
        for batch in batches:
            stamps, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(stamps):
                if out is None or size >= segment_bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(path, recursive=True)
                    made.append((context.partitionId(), len(made), f"{context.partitionId()}-{context.taskAttemptId()}-{len(made)}", stamps[at]))
                    out, size = fs.open_output_stream(f"{path}/{made[-1][2]}", compression=None), 0
                end, held = at, size
                while end < len(stamps) and (end == at or held < segment_bytes):
                    held += len(payloads[end] or b"") + 24
                    end += 1
                data = frames.encode_many([with_ts(ts, p or b"") for ts, p in zip(stamps[at:end], payloads[at:end], strict=True)])
                out.write(data)
                size, at = size + len(data), end
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["part", "nth", "name", "first_ts"])

    made = sorted(map(tuple, ranged.mapInArrow(run, "part long, nth long, name string, first_ts long").collect()))  # a row for each file
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    last = max((frames.parse_name(f.rpartition("/")[2])[0] for f in listed(folder)), default=0)
    moves = [(f"{apart}/{name}", f"{folder}/{frames.file_name(last + k, STAMP, ts)}") for k, (_, _, name, ts) in enumerate(made, 1)]
    for old, new in moves:
        fs.move(_file_system(old)[1], _file_system(new)[1])
    if made:
        fs.delete_dir(_file_system(apart)[1])
    return [new for _, new in moves]


def collect_garbage(folder: str, before: float | None = None, upto_suffix: int | None = None) -> list[str]:
    """Remove files by age (seconds since 1970) or position, never the newest; returns what went."""
    fs, _ = _file_system(folder)
    gone = []
    for f in listed(folder)[:-1]:
        path = _file_system(f)[1]
        old = before is not None and fs.get_file_info(path).mtime.timestamp() < before
        if old or (upto_suffix is not None and frames.parse_name(f.rpartition("/")[2])[0] < upto_suffix):
            fs.delete_file(path)
            gone.append(f)
    return gone
