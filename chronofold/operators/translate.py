"""From the log's nested records to change rows, and between record forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def unnested(mutations: DataFrame) -> DataFrame:
    """Rows of each mutation (commit_ts, table_id, sequence, inserted, updated, deleted) in the order of its sequence.

    ``sequence`` names the list (I, U, D) of each next row, so the places of each name
    are paired with that list in order; nothing leaves its row on the way.
    """
    at = F.transform("sequence", lambda op, i: F.struct(op.alias("op"), i.alias("pos")))

    def placed(op: str, rows: str) -> Column:
        places = F.filter(at, lambda x: x["op"] == op)
        return F.zip_with(places, F.slice(rows, F.lit(1), F.size(places)), lambda p, r: F.struct(p["pos"].alias("pos"), p["op"].alias("op"), r.alias("row")))

    rows = F.concat(placed("I", "inserted"), placed("U", "updated"), placed("D", "deleted"))
    return mutations.select("commit_ts", "table_id", F.explode(rows).alias("e")).select("commit_ts", "table_id", "e.pos", "e.op", "e.row")


def writable(columns: Column) -> Column:
    """Names of the public columns that are not generated."""
    return F.transform(F.filter(columns, lambda c: (c["state"] == "public") & ~c["generated"]), lambda c: c["name"])


def old_and_new(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new value of each column of an update, from (pos, column, value) pairs: the first is old, the second new.

    A column that occurs another number of times than two is corrupt.
    """
    out = pairs.groupBy(*keys, "column").agg(F.count("*").alias("times"), F.min_by("value", "pos").alias("old"), F.max_by("value", "pos").alias("new"))
    return out.withColumn("corrupt", F.col("times") != 2).drop("times")


def argument(union: Column, kind: Column) -> Column:
    """struct(text, bytes) of the one value that a tagged union holds: bytes for binary values, else text.

    Bytes of a JSON column are its text, and those of a bit column an unsigned number. Nothing set is an empty text,
    unless the union says that it is null.
    """
    raw = union["bytes_value"]
    bits = F.conv(F.hex(raw), 16, 10)
    text = F.coalesce(
        *[union[c].cast("string") for c in ("int_value", "uint_value", "double_value")],
        F.when(raw.isNotNull() & (kind == "json"), raw.cast("string")).when(raw.isNotNull() & (kind == "bit"), bits),
    )
    binary = F.when(text.isNull() & raw.isNotNull(), raw)
    text = F.when(binary.isNull(), F.coalesce(text, union["string_value"], F.lit("")))
    null = F.coalesce(union["is_null"], F.lit(False))
    return F.struct(F.when(~null, text).alias("text"), F.when(~null, binary).alias("bytes"))


def without_columns(values: Column, known: Column) -> Column:
    """The values of known columns: generated ones and those the target lacks go."""
    return F.map_filter(values, lambda k, v: F.array_contains(known, k))


def without_unknown(dmls: DataFrame, known: Column) -> DataFrame:
    """``dmls`` (values, old_values) without the columns that the target does not have, in both."""
    return dmls.withColumn("values", without_columns(F.col("values"), known)).withColumn("old_values", without_columns(F.col("old_values"), known))


def local_default(utc: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A default that is kept as text in UTC, as local time of a zone, whatever the session's zone is."""
    shown = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(utc, F.lit(pattern)))
    return F.date_format(shown, pattern)


def shouted(db: Column, tbl: Column) -> Column:
    """Names for a database that keeps them in upper case."""
    return F.concat(F.upper(db), F.lit("."), F.upper(tbl))
