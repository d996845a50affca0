"""Merging sources into one ordered log, and dealing it into batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import tso
from chronofold.operators import ordering


def deduplicated(log: DataFrame) -> DataFrame:
    """One row for each commit_ts: of the smallest source. A partial aggregate goes before the shuffle."""
    others = [c for c in log.columns if c != "commit_ts"]
    first = log.groupBy("commit_ts").agg(F.min_by(F.struct(*others), "source_id").alias("r"))
    return first.select("commit_ts", "r.*").select(*log.columns)


def ordered_merge(sources: list[DataFrame], checkpoint_ts: int = 0) -> DataFrame:
    """All sources' rows after the checkpoint, by commit_ts, each timestamp once."""
    rows = reduce(DataFrame.unionByName, sources).filter(F.col("commit_ts") > checkpoint_ts)
    return deduplicated(rows).orderBy("commit_ts")


def horizon(log: DataFrame) -> DataFrame:
    """One row: the least of the sources' largest commit_ts. What lies at or below it is complete."""
    return log.groupBy("source_id").agg(F.max("commit_ts").alias("m")).agg(F.min("m").alias("horizon"))


def released(log: DataFrame) -> DataFrame:
    """Rows at or below the horizon."""
    return log.join(F.broadcast(horizon(log)), F.col("commit_ts") <= F.col("horizon")).drop("horizon")  # one row


def timestamp_map(log: DataFrame, minutes: int = 1) -> DataFrame:
    """minute, primary_ts, secondary_ts: how far both sides had come in each stretch of time that has records."""
    stretch = F.floor(tso.physical(F.col("commit_ts")) / (60_000 * minutes))
    return log.groupBy(stretch.alias("minute")).agg(F.max("start_ts").alias("primary_ts"), F.max("commit_ts").alias("secondary_ts"))


def numbered_batches(log: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``log`` with ``batch``: every ``size`` rows of a key, in order (the first column of it a long)."""
    return ordering.numbered(log, keys, F.col(order[0]), order[1:], "__place").withColumn("batch", F.floor(F.col("__place") / size).cast("long")).drop("__place")


def ddl_epochs(log: DataFrame, is_ddl: Column) -> DataFrame:
    """``log`` with ``epoch``: rows between two DDLs share one; a DDL has its own (odd) epoch."""
    ddl = F.when(is_ddl, 1).otherwise(0)
    out = ordering.running(log, F.col("commit_ts"), [], ddl, "__before", "sum")
    return out.withColumn("epoch", (2 * F.col("__before") + ddl).cast("long")).drop("__before")


def flush_batches(log: DataFrame, is_ddl: Column, most: int) -> DataFrame:
    """``log`` with ``epoch`` and ``batch``: a flush comes at a DDL, and after ``most`` rows of an epoch."""
    rows = ddl_epochs(log, is_ddl)
    return numbered_batches(rows, ["epoch"], ["commit_ts"], most)


def not_repeated(log: DataFrame, order: Column, ties: list[str]) -> DataFrame:
    """Rows whose commit_ts is above all before them in arrival order."""
    return ordering.running(log, order, ties, F.col("commit_ts"), "__seen").filter(F.col("__seen").isNull() | (F.col("commit_ts") > F.col("__seen"))).drop("__seen")


def idle_heartbeats(log: DataFrame, idle_ms: int = 3000) -> DataFrame:
    """A heartbeat (start_ts = commit_ts) of each source that is behind the log by more than ``idle_ms``, at the log's end."""
    last = log.groupBy("source_id").agg(F.max("commit_ts").alias("ts"))
    top = last.agg(F.max("ts").alias("top"))
    idle = last.join(F.broadcast(top), tso.physical(F.col("top")) - tso.physical(F.col("ts")) > idle_ms)  # one row
    return idle.select("source_id", F.col("top").alias("start_ts"), F.col("top").alias("commit_ts"))


def thinned_heartbeats(beats: DataFrame, gap_ms: int = 3000) -> DataFrame:
    """Of each source's heartbeats, each that comes more than ``gap_ms`` after the last one kept.

    The rule looks at what was kept before, so each source is folded in order;
    a task reads its sources' rows as a stream and holds one timestamp.
    """
    from chronofold.shipping import ship

    ship(beats.sparkSession)
    rows = beats.select("source_id", "commit_ts").repartition("source_id").sortWithinPartitions("source_id", "commit_ts")

    def run(batches):
        source, last = None, None
        for pdf in batches:
            keep = []
            for s, ts in zip(pdf["source_id"], pdf["commit_ts"], strict=True):
                ms = int(ts) >> tso.LOGICAL_BITS
                fresh = s != source or ms - last > gap_ms
                if fresh:
                    source, last = s, ms
                keep.append(fresh)
            yield pdf[keep]

    return rows.mapInPandas(run, rows.schema)
