"""Sinks of change batches: one contract, and a factory by name.

Every sink takes whole micro-batches with their number and may see a number again
after a failure: applying it twice leaves the same result. What was applied is told by
``successes``, what failed by ``error``; in safe mode a sink may be given what it has
applied before.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import ddl
from chronofold.operators import apply, collapse
from chronofold.sources import logdir


class Sink(Protocol):
    #: Numbers of the batches that were applied, in order, and what ended the last one.
    successes: list[int]
    error: Exception | None
    safe_mode: bool

    def sync(self, batch: DataFrame, batch_id: int) -> None: ...

    def set_safe_mode(self, on: bool) -> None: ...

    def close(self) -> None: ...


class BaseSink:
    """The contract around ``write``: successes, the error that ends all, safe mode."""

    def __init__(self) -> None:
        self.successes: list[int] = []
        self.error: Exception | None = None
        self.safe_mode = self.closed = False

    def sync(self, batch: DataFrame, batch_id: int) -> None:
        if self.closed or self.error is not None:
            raise RuntimeError("the sink was closed" if self.closed else f"the sink ended: {self.error}")
        try:
            self.write(batch, batch_id)
        except Exception as e:
            self.error = e
            raise
        self.successes.append(batch_id)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        raise TypeError(f"{type(self).__name__} does not say how to write")

    def set_safe_mode(self, on: bool) -> None:
        self.safe_mode = on

    def close(self) -> None:
        """No more batches; what failed is raised again."""
        self.closed = True
        if self.error is not None:
            raise self.error


class MemorySink(BaseSink):
    """Keeps batches as rows, for tests."""

    def __init__(self, **_):
        super().__init__()
        self.batches: dict[int, list] = {}

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.batches[batch_id] = batch.collect()


class FileSink(BaseSink):
    """Framed log files (commit_ts, payload); a batch has a folder, which is written anew if the batch comes again."""

    def __init__(self, path: str, segment_bytes: int = logdir.SEGMENT_BYTES, **_):
        super().__init__()
        self.path, self.segment_bytes = path.rstrip("/"), segment_bytes

    def write(self, batch: DataFrame, batch_id: int) -> None:
        folder = f"{self.path}/batch={batch_id:012d}"
        fs, path = logdir._file_system(folder)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)
        logdir.write(batch, folder, self.segment_bytes)


class ParquetSink(BaseSink):
    """Parquet by batch, in one order of commit_ts, for a broker that is not here: a batch replaces its own folder."""

    def __init__(self, path: str, **_):
        super().__init__()
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.orderBy("commit_ts") if "commit_ts" in batch.columns else batch
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id:012d}")


class TableSink(BaseSink):
    """A table in buckets by key: a batch's changes are collapsed by key and applied to the buckets that they touch.

    After batch n a manifest names the version of each bucket; buckets that the batch
    does not touch keep theirs. A batch that comes again starts from the manifest before
    it. Versions that neither of the last two manifests names are removed. Changes have
    the table's columns, op and an order.
    """

    def __init__(self, path: str, keys: list[str], columns: list[str], order: list[str], buckets: int = 64, **_):
        super().__init__()
        self.path, self.keys, self.columns, self.order, self.buckets = path.rstrip("/"), keys, columns, order, buckets

    def _manifest(self, before: int | None = None) -> tuple[int, dict[str, int]]:
        """(batch, bucket -> version) of the last manifest (before a batch)."""
        fs, path = logdir._file_system(self.path)
        found = [n for n in self._manifests() if before is None or n < before]
        if not found:
            return -1, {}
        with fs.open_input_file(f"{path}/manifest={found[-1]:012d}") as f:
            return found[-1], json.loads(f.read())

    def _manifests(self) -> list[int]:
        from pyarrow import fs as pafs

        fs, path = logdir._file_system(self.path)
        if fs.get_file_info(path).type.name != "Directory":
            return []
        names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path))]
        return sorted(int(n.removeprefix("manifest=")) for n in names if n.startswith("manifest=") and not n.endswith(".tmp"))

    def _rows(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.path}/version={v:012d}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.parquet(*paths) if paths else None

    def read(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch."""
        rows = self._rows(spark, {b: v for b, v in self._manifest()[1].items() if v >= 0})
        if rows is None:
            raise LookupError("the table has no rows yet")
        return rows.select(*self.columns)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self._apply(batch, batch_id, self._manifest(batch_id)[1])

    def _apply(self, batch: DataFrame, batch_id: int, versions: dict[str, int]) -> None:
        spark, values = batch.sparkSession, [c for c in self.columns if c not in self.keys]
        last = batch.groupBy(*self.keys).agg(F.max_by(F.struct("op", *values), F.struct(*self.order)).alias("l")).select(*self.keys, "l.*")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        touched = [str(r[0]) for r in last.select(bucket).distinct().collect()]  # a number for each bucket
        base = self._rows(spark, {b: versions[b] for b in touched if versions.get(b, -1) >= 0})
        out = last.filter("op <> 'D'").select(*self.columns) if base is None else apply.applied(base.select(*self.columns), last, self.keys)
        folder = f"{self.path}/version={batch_id:012d}"
        out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        fs, path = logdir._file_system(folder)
        made = {b for b in touched if fs.get_file_info(f"{path}/bucket={b}").type.name == "Directory"}
        versions |= {b: batch_id if b in made else -1 for b in touched}  # a bucket may be left without rows
        self._commit(versions, batch_id)

    def _commit(self, versions: dict[str, int], batch_id: int) -> None:
        fs, path = logdir._file_system(self.path)
        name = f"{path}/manifest={batch_id:012d}"
        with fs.open_output_stream(name + ".tmp") as f:
            f.write(json.dumps(versions).encode())
        if fs.get_file_info(name).type.name == "File":
            fs.delete_file(name)
        fs.move(name + ".tmp", name)
        manifests = self._manifests()
        named = set()
        for n in manifests[-2:]:
            with fs.open_input_file(f"{path}/manifest={n:012d}") as f:
                named |= {v for v in json.loads(f.read()).values()} | {n}
        from pyarrow import fs as pafs

        for x in fs.get_file_info(pafs.FileSelector(path)):
            kind, _, n = x.base_name.partition("=")
            if kind == "version" and int(n) not in named and int(n) < batch_id:
                fs.delete_dir(x.path)
        for n in manifests[:-2]:
            fs.delete_file(f"{path}/manifest={n:012d}")


def mysql_statements(db, sql):
    """What is run for a statement on a target of the log's own dialect: the use of its database, then the statement.

    Placement options go and row expiry is turned off; nothing is run where nothing is left.
    """
    own = F.filter(F.array(F.when((db != "") & ~ddl.is_create_database(sql), F.concat(F.lit("use `"), F.replace(db, F.lit("`"), F.lit("``")), F.lit("`;"))), ddl.without_placement(sql)), lambda x: x.isNotNull())
    return F.when(F.trim(ddl.without_placement(sql)) == "", F.array().cast("array<string>")).otherwise(own)


def oracle_statements(db, tbl, sql):
    """The other dialect runs truncations only, through a procedure of the target's schema."""
    call = F.concat(F.lit("BEGIN "), db, F.lit(".do_truncate('"), db, F.lit("."), tbl, F.lit("','');END;"))
    return F.when(ddl.is_truncate(sql), F.array(call)).otherwise(F.array().cast("array<string>"))


class UnsupportedStatement(ValueError):
    """A statement that the target cannot run."""


class OracleSink(TableSink):
    """A table of the other dialect: of statements (rows with ddl_query) only truncations are let through; they empty the table."""

    def write(self, batch: DataFrame, batch_id: int) -> None:
        versions = self._manifest(batch_id)[1]
        if "ddl_query" in batch.columns:
            statements = batch.filter("ddl_query is not null")
            refused = statements.filter(~ddl.is_truncate(F.col("ddl_query"))).select("ddl_query", "commit_ts").first()
            if refused:
                raise UnsupportedStatement(f"unsupported ddl {refused['ddl_query']}, you should skip commit ts {refused['commit_ts']}")
            cut = statements.agg(F.max("commit_ts")).first()[0]
            batch = batch.filter("ddl_query is null")
            if cut is not None:  # what came before the truncation is gone
                batch, versions = batch.filter(F.col("commit_ts") > cut), dict.fromkeys(versions, -1)
        self._apply(batch.select(*self.columns, "op", *[c for c in self.order if c not in self.columns]), batch_id, versions)


#: Sinks by name; ``pb`` is an older name of ``file``. Brokers and databases without a connector here are written as parquet.
SINKS = {"memory": MemorySink, "file": FileSink, "pb": FileSink, "kafka": ParquetSink, "mysql": TableSink, "oracle": OracleSink, "_intercept": MemorySink}


def make(name: str, **options) -> Sink:
    if name not in SINKS:
        raise ValueError(f"no sink named {name!r}: {', '.join(sorted(SINKS))}")
    return SINKS[name](**options)


def run(stream: DataFrame, sink: Sink, checkpoint: str, **trigger):
    """Write a stream through a sink; ``trigger`` as writeStream.trigger takes it."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: sink.sync(batch, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def folded(batch: DataFrame, keys: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """A batch's changes, one for each key, with the rank in which kinds are applied."""
    return collapse.collapsed(batch, keys, order, before, after).withColumn("rank", apply.apply_rank(F.col("op")))
