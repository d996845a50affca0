"""Order over a whole log without a window over all of it: ranges first, then rows inside each range.

Ranges are quantiles of the order key, found by one aggregate over the rows before the
plan is made, so each holds about as many rows as the next however the key is spread:
one far timestamp does not fill a range. Rows of one key lie in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 1024


#: Rows that a range should hold: a small log has fewer ranges.
RANGE_ROWS = 20_000


def bounds(df: DataFrame, order: Column, ranges: int = RANGES, range_rows: int = 1) -> list[int]:
    """Quantiles of a long key that cut the rows into ``ranges`` parts at most, of ``range_rows`` at least, each once, in order."""
    if ranges < 2:
        return []
    n, found = df.agg(F.count("*"), F.percentile_approx(order.cast("long"), [k / ranges for k in range(1, ranges)], 4 * ranges)).first()
    step = max(1, ranges * range_rows // max(n, 1))
    return sorted(set((found or [])[step - 1 :: step]))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts lie at or below the key, by bisection; null keys come first."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])

    def step(at, size):
        fits = F.coalesce((at + size <= len(cuts)) & (F.try_element_at(array, at + size) <= key), F.lit(False))
        return F.when(fits, at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _ranged(df: DataFrame, order: Column, ranges: int) -> DataFrame:
    """``df`` with __o (the order key, a long) and __r (its range)."""
    keyed = df.withColumn("__o", order.cast("long"))
    return keyed.withColumn("__r", range_of(F.col("__o"), bounds(keyed, F.col("__o"), ranges, RANGE_ROWS)))


def running(df: DataFrame, order: Column, ties: list[str], value: Column, into: str, how: str = "max", inclusive: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with the max or sum of ``value`` over all rows before (and including) each, by ``order`` and ``ties``.

    A window over the ranges' totals has ``ranges`` rows; a window inside a range has that range's rows.
    """
    rows = _ranged(df.withColumn("__v", value), order, ranges)
    fold = F.max if how == "max" else F.sum
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__r").agg(fold("__v").alias("__t")).withColumn("__b", fold("__t").over(before)).select("__r", "__b")
    inside = Window.partitionBy("__r").orderBy("__o", *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumn("__i", fold("__v").over(inside)).join(F.broadcast(totals), "__r", "left")  # as many rows as ranges
    both = F.greatest("__b", "__i") if how == "max" else F.coalesce("__b", F.lit(0)) + F.coalesce("__i", F.lit(0))
    return out.withColumn(into, both).drop("__o", "__r", "__v", "__i", "__b")


def numbered(df: DataFrame, keys: list[str], order: Column, ties: list[str], into: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with the place of each row, from 0, among those of its key.

    A key's rows are counted by range first, so a key that holds nearly all rows is many tasks' work.
    """
    rows = _ranged(df, order, ranges)
    counts = rows.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__r").alias("__s"), "__b")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__r") == F.col("__s"))
    inside = Window.partitionBy(*keys, "__r").orderBy("__o", *ties)
    placed = rows.withColumn("__i", F.row_number().over(inside) - 1).join(before, same)
    return placed.withColumn(into, F.col("__b") + F.col("__i")).drop("__o", "__r", "__i", "__s", "__b", *[f"__{k}" for k in keys])
