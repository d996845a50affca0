"""Collapsing the changes of a key, and the table that changes leave behind.

Changes have db, tbl, a key, op (I, U, D), an order (commit_ts, txn_seq), and the
images before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_key_changes(changes: DataFrame, old_key: Column, new_key: Column) -> DataFrame:
    """Updates that change the key as a delete of the old and an insert of the new, in that order (``part`` 0 and 1)."""
    one = F.array(F.struct(F.col("op").alias("op"), F.lit(0).alias("part"), new_key.alias("key")))
    two = F.array(F.struct(F.lit("D").alias("op"), F.lit(0).alias("part"), old_key.alias("key")), F.struct(F.lit("I").alias("op"), F.lit(1).alias("part"), new_key.alias("key")))
    moved = (F.col("op") == "U") & ~old_key.eqNullSafe(new_key)
    kept = F.when(F.col("op") == "D", F.array(F.struct(F.col("op").alias("op"), F.lit(0).alias("part"), old_key.alias("key")))).otherwise(one)
    rest = [c for c in changes.columns if c != "op"]
    return changes.withColumn("__p", F.explode(F.when(moved, two).otherwise(kept))).select(*rest, "__p.op", "__p.part", "__p.key")


def collapsed(changes: DataFrame, keys: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """One change for each key with the effect of all its changes in order: keys, op, before, after.

    With ``last`` the key's last op: unless it is U, it is the result. Else let the
    anchor be the last op that is not U: after an insert the result is an insert, else
    an update whose image before is that of the first U after the anchor.

    Two aggregates and a join on the key, not a window: partial aggregation takes
    hot keys before the shuffle, and the join splits them.
    """
    rows = changes.withColumn("__at", F.struct(*order))
    ends = rows.groupBy(*keys).agg(
        F.max_by("op", "__at").alias("__last"),
        F.max_by(F.struct(F.col(after).alias("a")), "__at").alias("__after"),
        F.max_by(F.struct(F.col(before).alias("b")), "__at").alias("__last_before"),
        F.max(F.when(F.col("op") != "U", F.col("__at"))).alias("__anchor"),
        F.max_by(F.when(F.col("op") != "U", F.col("op")), F.when(F.col("op") != "U", F.col("__at"))).alias("__anchor_op"),
    )
    tails = rows.select(*keys, "op", "__at", before).join(ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "__anchor"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    first = tails.filter((F.col("op") == "U") & (F.col("__anchor").isNull() | (F.col("__at") > F.col("__anchor")))).groupBy(*keys).agg(F.min_by(F.struct(F.col(before).alias("b")), "__at").alias("__first_before"))
    first = first.select(*[F.col(k).alias(f"__{k}") for k in keys], "__first_before")
    out = ends.join(first, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    op = F.when(F.col("__last") != "U", F.col("__last")).when(F.col("__anchor_op") == "I", F.lit("I")).otherwise(F.lit("U"))
    image = F.when(op == "U", F.col("__first_before.b")).when(op == "D", F.col("__last_before.b"))
    return out.select(*keys, op.alias("op"), image.alias(before), F.when(op != "D", F.col("__after.a")).alias(after))


def final_state(changes: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The table after all changes: of each key the last, unless it is a delete."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *values), F.struct(*order)).alias("__l"))
    return last.filter("__l.op <> 'D'").select(*keys, *[F.col(f"__l.{v}").alias(v) for v in values])


def counted(changes: DataFrame) -> DataFrame:
    """Changes of each kind."""
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, start: float, factor: float, buckets: int) -> DataFrame:
    """bucket, upto, n: cumulative counts of values at or below start * factor^bucket, as metrics keep them.

    Rows are counted by their first bucket before the (few) bounds are met.
    """
    bounds = rows.sparkSession.createDataFrame([(k, start * factor**k) for k in range(buckets)], "bucket long, upto double")
    first = F.lit(buckets)
    for k in range(buckets - 1, -1, -1):
        first = F.when(value <= start * factor**k, F.lit(k)).otherwise(first)
    counts = rows.groupBy(first.alias("__k")).agg(F.count(value).alias("__n"))
    both = bounds.join(F.broadcast(counts), F.col("__k") <= F.col("bucket"), "left")  # buckets + 1 rows
    return both.groupBy("bucket", "upto").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))


def grouped(changes: DataFrame, has_key: Column, merges: bool = True) -> DataFrame:
    """Rows of each table, and whether they can be applied in bulk by key."""
    return changes.groupBy("db", "tbl").agg(F.count("*").alias("n"), (F.min(has_key.cast("int")) == F.lit(1)).alias("__k")).select("db", "tbl", "n", (F.col("__k") & F.lit(merges)).alias("bulk"))
