"""Applying changes to a table, comparing tables, and applying safely again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which a batch's collapsed changes are applied: deletes, inserts, updates (the last two as replacements).
APPLY_ORDER = {"D": 0, "I": 1, "U": 2}


def apply_rank(op: Column) -> Column:
    return F.when(op == "D", 0).when(op == "I", 1).otherwise(2)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def applied(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` after the collapsed changes ``delta`` (the table's columns and op): deleted and replaced rows go, new ones come."""
    left = base.join(delta.select(*keys), _same(base, delta, keys), "left_anti")
    return left.unionByName(delta.filter("op <> 'D'").select(*base.columns))


def difference(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state of rows that differ: missing (in target), extra or changed."""
    values = [c for c in source.columns if c not in keys]
    a = source.select(*[F.col(k).alias(k) for k in keys], F.struct(*values).alias("__a"), F.lit(True).alias("__in_a"))
    b = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*values).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "full_outer")
    state = F.when(F.col("__in_b").isNull(), "missing").when(F.col("__in_a").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], state.alias("state")).filter("state is not null")


def checksum(table: DataFrame) -> DataFrame:
    """One row: rows and an order-free checksum of a table."""
    return table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("sum"))


def same_structure(source: DataFrame, target: DataFrame) -> bool:
    return [(f.name, f.dataType) for f in source.schema] == [(f.name, f.dataType) for f in target.schema]


def repeatable(changes: DataFrame, oracle: bool = False) -> DataFrame:
    """Steps that may be applied twice: an insert replaces; an update deletes the old row and replaces the new.

    The other dialect has no replace: it deletes the old, deletes the new, then inserts.
    """

    def steps(*items):
        return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(v).alias("verb"), F.lit(w).alias("image")) for i, (v, w) in enumerate(items)])

    if oracle:
        plan = F.when(F.col("op") == "I", steps(("delete", "after"), ("insert", "after"))).when(F.col("op") == "U", steps(("delete", "before"), ("delete", "after"), ("insert", "after"))).otherwise(steps(("delete", "before")))
    else:
        plan = F.when(F.col("op") == "I", steps(("replace", "after"))).when(F.col("op") == "U", steps(("delete", "before"), ("replace", "after"))).otherwise(steps(("delete", "before")))
    return changes.withColumn("__s", F.explode(plan)).select(*changes.columns, "__s.step", "__s.verb", "__s.image")
