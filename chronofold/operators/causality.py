"""Which changes may run side by side: those that share no key, directly or through others."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import names
from chronofold.shipping import checkpoint_folder, ship


def conflict_keys(table: Column, unique_keys: list[list[str]], columns: list[str], is_update: Column, after: str = "", before: str = "old_") -> Column:
    """Keys of a change: each unique key of the new row and, for updates, of the old one; without any, a hash of all columns."""

    def of(prefix: str) -> Column:
        found = F.filter(F.array(*[names.key_text(k, prefix) for k in unique_keys]), lambda x: x != "") if unique_keys else F.array().cast("array<string>")
        whole = F.crc32(F.concat(names.key_text(columns, prefix), table).cast("binary")).cast("string")
        return F.when(F.size(found) > 0, F.transform(found, lambda x: F.concat(x, table))).otherwise(F.array(whole))

    return F.when(is_update, F.concat(of(after), of(before))).otherwise(of(after))


class Relations:
    """Keys and their tokens, until a change would join two tokens: then all starts anew."""

    def __init__(self):
        self.token: dict[str, str] = {}
        self.epoch = 0

    def add(self, keys: list[str]) -> tuple[int, str]:
        """The (epoch, token) of a change with these keys."""
        held = list(dict.fromkeys(self.token[k] for k in keys if k in self.token))
        if len(held) > 1:
            self.token, held = {}, []
            self.epoch += 1
        chosen = held[0] if held else keys[0]
        for k in keys:
            self.token.setdefault(k, chosen)
        return self.epoch, self.token[keys[0]]


def ordered_tokens(changes: DataFrame, workers: int, group: str = "tbl") -> DataFrame:
    """Changes (group, commit_ts, txn_seq, keys) with the epoch in which they may run, their token and worker.

    The rule depends on all changes before (a conflict anywhere in a table starts a new
    epoch for all of it), so a table's are read in order as a stream, one task for each
    table; a task holds the keys of its present epoch. ``group`` may be any column that
    parts changes which never share a key, such as linked_groups() gives.
    """
    ship(changes.sparkSession)
    rows = changes.select(group, "commit_ts", "txn_seq", "keys").repartition(group).sortWithinPartitions(group, "commit_ts", "txn_seq")

    def run(batches):
        now, relations, workers_of = None, Relations(), {}
        for batch in batches:
            out = []
            for g, keys in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if g != now:
                    now, relations, workers_of = g, Relations(), {}
                epoch, token = relations.add(keys)
                if token not in workers_of:
                    if len(workers_of) > 1_000_000:
                        workers_of.clear()
                    workers_of[token] = zlib.crc32(token.encode()) % workers
                out.append((epoch, token, workers_of[token]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[group, "commit_ts", "txn_seq", "epoch", "token", "worker"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{group} {kind[group]}, commit_ts long, txn_seq {kind['txn_seq']}, epoch int, token string, worker int")


def linked_groups(changes: DataFrame, id_column: str = "id", rounds: int = 50) -> DataFrame:
    """(id, group) of changes linked by common keys, whatever their order: each takes the least id it reaches.

    Labels spread over key-to-change links by minima, with a jump to the label's own
    label in each round; every round cuts its lineage in the shared folder. Each round
    at least halves what is left of a chain, so ``rounds`` allow 2^50 links in a row;
    beyond that it is an error.
    """
    checkpoint_folder(changes.sparkSession)
    links = changes.select(F.col(id_column).alias("id"), F.explode("keys").alias("key")).distinct()
    labels = changes.select(F.col(id_column).alias("id")).distinct().withColumn("group", F.col("id"))
    for _ in range(rounds):
        by_key = links.join(labels, "id").groupBy("key").agg(F.min("group").alias("m"))
        near = links.join(by_key, "key").groupBy("id").agg(F.min("m").alias("m"))
        new = labels.join(near, "id", "left").select("id", F.least("group", "m").alias("group"), F.col("group").alias("old"))
        jump = new.select(F.col("id").alias("j"), F.col("group").alias("further"))
        moved = new.join(jump, F.col("group") == F.col("j"), "left").select("id", F.least("group", "further").alias("group"), "old").checkpoint()
        changed = moved.filter("group <> old").limit(1).count()
        labels = moved.select("id", "group")
        if not changed:
            return labels
    raise RuntimeError("the groups did not settle")
