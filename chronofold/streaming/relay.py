"""A relay log: what is to be applied is written to framed log files first, so that it can be applied again after a failure.

A record is a change row as JSON. Recovery reads the records after the checkpoint and
applies them in safe mode (replacing, so that what was applied already does no harm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronofold.sources import logdir


class Relay:
    """Relay log files of batches, a folder for each."""

    def __init__(self, path: str, schema: StructType, segment_bytes: int = logdir.SEGMENT_BYTES):
        """``schema``: of the change rows, with commit_ts."""
        self.path, self.schema, self.segment_bytes = path.rstrip("/"), schema, segment_bytes

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id:012d}"

    def _batches(self) -> list[int]:
        from pyarrow import fs as pafs

        fs, path = logdir._file_system(self.path)
        if fs.get_file_info(path).type.name != "Directory":
            return []
        names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in names)

    def record(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; one that comes again replaces its folder."""
        folder = self._folder(batch_id)
        fs, path = logdir._file_system(folder)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)
        rows = batch.select(F.col("commit_ts").cast("long").alias("commit_ts"), F.to_json(F.struct(*self.schema.names)).cast("binary").alias("payload"))
        logdir.write(rows, folder, self.segment_bytes)

    def sync(self, batch: DataFrame, batch_id: int, sink) -> None:
        """Write a batch, apply it, and give up the batches before it."""
        self.record(batch, batch_id)
        sink.sync(batch, batch_id)
        self.collect_garbage(batch_id)

    def scan(self, spark: SparkSession, after_ts: int = 0) -> DataFrame:
        """The change rows after a timestamp."""
        found = [logdir.read(spark, self._folder(n), start_ts=after_ts + 1) for n in self._batches()]
        if not found:
            return spark.createDataFrame([], self.schema)
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows.select(F.from_json(F.col("payload").cast("string"), self.schema).alias("r")).select("r.*")

    def recover(self, spark: SparkSession, sink, checkpoint_ts: int, batch_id: int) -> None:
        """Apply what the log holds after the checkpoint, in safe mode, as the batch ``batch_id``."""
        sink.set_safe_mode(True)
        sink.sync(self.scan(spark, checkpoint_ts), batch_id)
        sink.set_safe_mode(False)
        self.collect_garbage(batch_id + 1)

    def collect_garbage(self, before_batch: int) -> list[int]:
        """Remove the batches before one; returns what went."""
        gone = [n for n in self._batches() if n < before_batch]
        for n in gone:
            fs, path = logdir._file_system(self._folder(n))
            fs.delete_dir(path)
        return gone
