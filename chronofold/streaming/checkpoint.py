"""Where a replication stands: an audit table beside Spark's own checkpoint, and when to save it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronofold.functions import tso

#: Milliseconds of log time between saves without a reason.
SAVE_EVERY_MS = 3000
#: Seconds without an applied transaction after which everything counts as synced.
SYNCED_AFTER_S = 300


@dataclass
class Point:
    commit_ts: int = 0
    schema_version: int = 0
    consistent: bool = False
    primary_ts: int = 0
    secondary_ts: int = 0


class Checkpoint:
    """The last point, kept by a backend. The schema version never goes back."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.point = self._load()

    def _load(self) -> Point:
        raise TypeError(f"{type(self).__name__} does not say how to load")

    def _store(self, point: Point) -> None:
        raise TypeError(f"{type(self).__name__} does not say how to store")

    def save(self, point: Point) -> None:
        point.schema_version = max(point.schema_version, self.point.schema_version)
        self._store(point)
        self.point = point

    def due(self, commit_ts: int, is_ddl: bool = False, applied: bool = False) -> bool:
        """At once after a DDL or an applied timestamp; else when the log moved on far enough."""
        moved = (commit_ts >> tso.LOGICAL_BITS) - (self.point.commit_ts >> tso.LOGICAL_BITS)
        return is_ddl or applied or moved > SAVE_EVERY_MS

    def success(self, commit_ts: int, schema_version: int = 0, is_ddl: bool = False, applied: bool = False) -> bool:
        if commit_ts <= self.point.commit_ts or not self.due(commit_ts, is_ddl, applied):
            return False
        self.save(Point(commit_ts, schema_version, False, self.point.primary_ts, self.point.secondary_ts))
        return True

    def close(self, commit_ts: int, clean: bool) -> None:
        """The last save; it is consistent only after a clean end."""
        self.save(Point(max(commit_ts, self.point.commit_ts), self.point.schema_version, clean, self.point.primary_ts, self.point.secondary_ts))


class FileCheckpoint(Checkpoint):
    """A JSON file in any file system Spark knows.

    A point is written whole beside the old one, which then makes way: after an end at
    any step one of the two is there, and the next start takes it.
    """

    def _paths(self):
        jvm = self.spark.sparkContext._jvm
        at, new = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(self.path + ".tmp")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at, new

    def _load(self) -> Point:
        fs, at, new = self._paths()
        if not fs.exists(at):
            if not fs.exists(new):
                return Point()
            fs.rename(new, at)  # the end came between the two steps of _store()
        stream = fs.open(at)
        try:
            return Point(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _store(self, point: Point) -> None:
        fs, at, new = self._paths()
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(point)).encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(new, at)


class TableCheckpoint(Checkpoint):
    """A row for each save in an audit table (parquet): the last save counts. Rows are only ever added."""

    _SCHEMA = "nth long, commit_ts long, schema_version long, consistent boolean, primary_ts long, secondary_ts long"

    def _load(self) -> Point:
        from pyspark.errors import AnalysisException

        try:
            last = self.spark.read.schema(self._SCHEMA).parquet(self.path).orderBy(F.desc("nth")).first()
        except AnalysisException:  # no such table yet
            last = None
        self.nth = last["nth"] if last else 0
        return Point(**{k: v for k, v in last.asDict().items() if k != "nth"}) if last else Point()

    def _store(self, point: Point) -> None:
        self.nth += 1
        self.spark.createDataFrame([(self.nth, *asdict(point).values())], self._SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


#: Backends by name.
BACKENDS = {"file": FileCheckpoint, "table": TableCheckpoint}


def make(backend: str, spark: SparkSession, path: str) -> Checkpoint:
    if backend not in BACKENDS:
        raise ValueError(f"no checkpoint backend named {backend!r}: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](spark, path)


def synced(now_s: float, last_success_s: float, after_s: float = SYNCED_AFTER_S) -> bool:
    return now_s - last_success_s > after_s
