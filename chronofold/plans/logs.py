"""Queries over framed log files: each writes a log from the events, in the shared folder, and reads it back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.plans import views
from chronofold.plans.queries import _MIDDLE, _middle, query
from chronofold.plans.views import CHANGES, TRANSACTIONS
from chronofold.shipping import shared_folder, ship
from chronofold.sources import frames, logdir
from chronofold.streaming import relay, sinks


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.changes(spark, sf_dir).select("source_id", "event_id", "commit_ts", F.col("event_id").cast("string").cast("binary").alias("payload"))


def _event(column: str = "payload"):
    return F.col(column).cast("string").cast("long").alias("event_id")


@query("s13_read_all", "SELECT txn, tp, start_ts FROM txl", TRANSACTIONS)
def s13(spark, sf_dir):
    """All of a log of transactions, from the first file on."""
    folder, log = fresh(spark, "log"), views.transactions(spark, sf_dir)
    text = F.concat_ws(",", F.col("txn").cast("string"), "tp", F.col("start_ts").cast("string"))
    logdir.write(log.select(F.coalesce("commit_ts", "start_ts").alias("commit_ts"), text.cast("binary").alias("payload")), folder, segment_bytes=1 << 16)
    parts = F.split(F.col("payload").cast("string"), ",")
    return logdir.read(spark, folder).select(F.get(parts, F.lit(0)).cast("long").alias("txn"), F.get(parts, F.lit(1)).alias("tp"), F.get(parts, F.lit(2)).cast("long").alias("start_ts"))


@query("k5_written_log", "SELECT event_id, commit_ts FROM chg", CHANGES)
def k5(spark, sf_dir):
    folder = fresh(spark, "log")
    logdir.write(_records(spark, sf_dir), folder, segment_bytes=1 << 16)
    return logdir.read(spark, folder).select(_event(), "commit_ts")


@query("s5_framed_replay", "SELECT event_id, commit_ts FROM chg, rng WHERE commit_ts BETWEEN a AND b", CHANGES, _MIDDLE)
def s5_framed(spark, sf_dir):
    """A range of a log in many files, those outside of it not read (also S7, S9 and S11)."""
    folder, (a, b) = fresh(spark, "log"), _middle(spark, sf_dir)
    logdir.write(_records(spark, sf_dir), folder, segment_bytes=1 << 14)
    return logdir.read(spark, folder, start_ts=a, end_ts=b).select(_event(), "commit_ts")


@query("s8_first_timestamps", "SELECT source_id, min(commit_ts) AS first_ts FROM chg GROUP BY source_id", CHANGES)
def s8(spark, sf_dir):
    """The first timestamp of each source's file, whose name does not tell it, from its first record, in tasks."""
    folder, log = fresh(spark, "log"), _records(spark, sf_dir)
    files = []
    for source in range(3):
        (made,) = logdir.write(log.filter(F.col("source_id") == source), f"{folder}/{source}", partitions=1)
        fs, path = logdir._file_system(made)
        plain = path.rpartition("-")[0]
        fs.move(path, plain)
        files.append((source, made.rpartition("/")[0] + "/" + plain.rpartition("/")[2]))
    ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([logdir.first_ts(f) for f in batch.column(1).to_pylist()], pa.int64())], names=["source_id", "first_ts"])

    return spark.createDataFrame(files, "source_id long, file string").repartition(3).mapInArrow(run, "source_id long, first_ts long")


def _in_groups(spark, sf_dir, run, schema: str) -> DataFrame:
    """``run`` over the records of each fifty events, in order: (group, event ids, timestamps) to rows."""
    ship(spark)
    names = [x.split()[0] for x in schema.split(", ")]

    def of(group: pa.Table) -> pa.Table:
        t = group.sort_by("event_id")
        rows = run(t.column("g")[0].as_py(), t.column("event_id").to_pylist(), t.column("commit_ts").to_pylist())
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    rows = views.changes(spark, sf_dir).select(F.expr("event_id div 50").alias("g"), "event_id", "commit_ts")
    return rows.groupBy("g").applyInArrow(of, schema)


def _id(payload: bytes) -> int:
    return int(payload[8:])


def _damaged(value_log: bool):
    encode = frames.encode_value if value_log else frames.encode

    def run(group, ids, stamps):
        data = bytearray()
        for i, ts in zip(ids, stamps, strict=True):
            frame = bytearray(encode(logdir.with_ts(ts, str(i).encode())))
            if i % 10 == 3:
                frame[-1] ^= 1  # a wrong checksum, or a wrong payload
            if i % 10 == 7:
                frame[0] ^= 1  # a wrong magic
            data += frame
        return [(_id(p),) for _, p in frames.walk(bytes(data), 0, value_log)]

    return run


@query("s14_walk_over_damage", "SELECT event_id FROM events WHERE event_id % 10 NOT IN (3, 7)")
def s14(spark, sf_dir):
    """Log frames with wrong checksums and magics: all others are found (also C1, C2 and S11)."""
    return _in_groups(spark, sf_dir, _damaged(False), "event_id long")


@query("c3_value_log_over_damage", "SELECT event_id FROM events WHERE event_id % 10 NOT IN (3, 7)")
def c3(spark, sf_dir):
    """The same over value log records (also C5)."""
    return _in_groups(spark, sf_dir, _damaged(True), "event_id long")


@query("s17_from_pointer", "SELECT event_id FROM events WHERE event_id % 50 >= 20")
def s17(spark, sf_dir):
    """Each value log from the pointer to its twentieth record on (also C7)."""

    def run(group, ids, stamps):
        records = [frames.encode_value(logdir.with_ts(ts, str(i).encode())) for i, ts in zip(ids, stamps, strict=True)]
        at = sum(map(len, [r for r, i in zip(records, ids, strict=True) if i % 50 < 20]))
        _, offset = frames.from_pointer(frames.pointer(group, at))
        return [(_id(p),) for _, p in frames.walk(b"".join(records), offset, True)]

    return _in_groups(spark, sf_dir, run, "event_id long")


@query("c4_footers", "SELECT event_id // 50 AS g, max(commit_ts) AS max_ts FROM chg GROUP BY 1", CHANGES)
def c4(spark, sf_dir):
    """Each value log's largest timestamp: from its footer, or from its records where it was not finished (every second)."""

    def run(group, ids, stamps):
        data = b"".join(frames.encode_value(logdir.with_ts(ts, str(i).encode())) for i, ts in zip(ids, stamps, strict=True))
        return [(group, frames.recovered_ts(data + (frames.footer(max(stamps)) if group % 2 else b""), logdir.ts_of))]

    return _in_groups(spark, sf_dir, run, "g long, max_ts long")


@query("s2_followed_log", "SELECT event_id, commit_ts FROM chg", CHANGES)
def s2(spark, sf_dir):
    """The log as a stream, in two parts: the second goes on where the first ended (also S3 and, with other records, S16)."""
    folder, log, (middle, _) = fresh(spark, "log"), _records(spark, sf_dir), _middle(spark, sf_dir)
    out, checkpoint = fresh(spark, "followed"), fresh(spark, "checkpoint")
    for part in (F.col("commit_ts") <= middle, F.col("commit_ts") > middle):
        logdir.write(log.filter(part), folder, segment_bytes=1 << 16)
        stream = logdir.follow(spark, folder).select(_event(), "commit_ts")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("k7_relay", ", f AS (SELECT pk, max_by(op, commit_ts) AS op, max_by(value, commit_ts) AS value FROM chg GROUP BY pk) SELECT pk, value FROM f WHERE op <> 'D'", CHANGES)
def k7(spark, sf_dir):
    """Batches go to the relay log before they are applied; the last is lost, and comes back from the log (also S15, M12, K1)."""
    c, (middle, _) = views.changes(spark, sf_dir).select("commit_ts", "pk", "op", "value"), _middle(spark, sf_dir)
    table = sinks.TableSink(fresh(spark, "table"), ["pk"], ["pk", "value"], ["commit_ts"], buckets=4)
    log = relay.Relay(fresh(spark, "relay"), c.schema)
    log.sync(c.filter(F.col("commit_ts") <= middle), 0, table)
    log.record(c.filter(F.col("commit_ts") > middle), 1)  # written, but the end came before it was applied
    log.recover(spark, table, checkpoint_ts=middle, batch_id=1)
    return table.read(spark)
