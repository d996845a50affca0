"""Keys and columns of tables, from what a database tells about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_of(columns: DataFrame, table: list[str]) -> DataFrame:
    """table, columns: names in order of place, without generated ones (place, name, extra). Tables without any are not there."""
    generated = F.col("extra").contains("VIRTUAL GENERATED") | F.col("extra").contains("STORED GENERATED")
    rows = columns.filter(~F.coalesce(generated, F.lit(False))).groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("c"))
    return rows.select(*table, F.col("c.name").alias("columns"))


def unique_keys(indexes: DataFrame, table: list[str]) -> DataFrame:
    """table, keys: (name, columns) of each unique index (name, is_unique, seq, col), the primary key first, then by name."""
    each = indexes.filter("is_unique").groupBy(*table, "name").agg(F.array_sort(F.collect_list(F.struct("seq", "col"))).alias("c"))
    key = F.struct((F.col("name") != "PRIMARY").alias("later"), "name", F.col("c.col").alias("columns"))
    keys = each.groupBy(*table).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return keys.select(*table, F.transform("keys", lambda k: F.struct(k["name"].alias("name"), k["columns"].alias("columns"))).alias("keys"))


def constrained_keys(indexes: DataFrame, constraints: DataFrame, columns: DataFrame, table: list[str]) -> DataFrame:
    """table, keys of a database that keeps indexes (index_name, is_unique), constraints (index_name, kind: P primary) and columns (index_name, pos, col) apart.

    Unique indexes count, with or without a constraint; the primary key's comes first.
    """
    kinds = constraints.groupBy(*table, "index_name").agg(F.max((F.col("kind") == "P").cast("int")).alias("primary"))
    own = indexes.filter("is_unique").select(*table, "index_name").join(kinds, [*table, "index_name"], "left")
    each = own.join(columns, [*table, "index_name"]).groupBy(*table, "index_name").agg(F.max("primary").alias("primary"), F.array_sort(F.collect_list(F.struct("pos", "col"))).alias("c"))
    key = F.struct((F.coalesce("primary", F.lit(0)) == 0).alias("later"), F.col("index_name").alias("name"), F.col("c.col").alias("columns"))
    keys = each.groupBy(*table).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return keys.select(*table, F.transform("keys", lambda k: F.struct(k["name"].alias("name"), k["columns"].alias("columns"), (~k["later"]).alias("primary"))).alias("keys"))


def data_types(columns: DataFrame, table: list[str]) -> DataFrame:
    """table, types: a map from column name to data type (name, data_type)."""
    return columns.groupBy(*table).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "data_type")))).alias("types"))


def record_keys(pk_is_handle: Column, pk_name: Column, indexes: Column) -> Column:
    """Keys as self-describing records list them: a primary key that is the row's handle, then the unique indexes in order.

    ``indexes``: array of (name, is_unique, is_primary, columns). A handle's primary key is not among them; if it is all the same, it counts once.
    """
    handle = F.when(pk_is_handle, F.array(F.struct(F.lit("PRIMARY").alias("name"), F.array(pk_name).alias("columns"))))
    own = F.filter(indexes, lambda i: (i["is_unique"] | i["is_primary"]) & ~(pk_is_handle & (i["name"] == "PRIMARY")))
    listed = F.transform(own, lambda i: F.struct(i["name"].alias("name"), i["columns"].alias("columns")))
    return F.when(handle.isNotNull(), F.concat(handle, listed)).otherwise(listed)


def positions(applied: DataFrame, table: list[str]) -> DataFrame:
    """table, position: how far each table of the target has come."""
    return applied.groupBy(*table).agg(F.max("commit_ts").alias("position"))
