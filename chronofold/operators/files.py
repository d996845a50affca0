"""What is known of log files without opening them, as DataFrames: names, gaps, and which files a range needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parsed_names(names: DataFrame, column: str) -> DataFrame:
    """Log files among names: name, suffix, first_ts (0 unless the name has four parts). Other names go."""
    parts, ts = F.split(column, "-"), F.lit(0).cast("long")
    ts = F.when(F.size(parts) == 4, F.substring_index(F.get(parts, F.lit(3)), ".", 1).try_cast("long")).otherwise(ts)
    good = names.filter(F.col(column).rlike(r"^binlog-\d+(-[^-]*(-\d+(\..*)?)?)?$"))
    return good.select(F.col(column).alias("name"), F.get(parts, F.lit(1)).cast("long").alias("suffix"), ts.alias("first_ts"))


def pruned(files: DataFrame, order: str, first_ts: str, start: int, stop: int) -> DataFrame:
    """Of the files of a folder, in order, those that may hold timestamps in [start, stop]; no stop if it is 0.

    A file goes if the next one begins at or before the start, or if it begins after
    the stop. A folder's files are few enough for one task's window.
    """
    following = F.lead(first_ts).over(Window.orderBy(order))
    rows = files.withColumn("__next", following).filter(F.col("__next").isNull() | (F.col("__next") > start)).drop("__next")
    return rows.filter((F.col(first_ts) <= stop) | (F.col(first_ts) <= start)) if stop else rows


def first_from(records: DataFrame, place: Column, start: int, n: int) -> DataFrame:
    """The first ``n`` records from a place on, in order."""
    return records.filter(place >= start).orderBy(place).limit(n)


def gaps(files: DataFrame, suffix: str = "suffix") -> DataFrame:
    """suffix and how many are missing before it (null for the first): one window over a folder's files."""
    return files.select(suffix, (F.col(suffix) - F.lag(suffix).over(Window.orderBy(suffix)) - 1).alias("gap"))
