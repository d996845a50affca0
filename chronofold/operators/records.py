"""From the log's encoded rows to transactions, and between transactions and the record forms of files and queues.

A mutation is a row of changes: commit_ts, txn_seq, table_id, op (I, U, D), pk (array of
values of the row's handle) and pairs (array of (id, value): column ids with values as
text; an update has each column twice, the old value first). A table's ``info`` is a
struct: columns (array of (id, name, kind, state, generated, nullable, default, elements,
zero, unsigned)), pk_is_handle, common_handle, pk (array of (id, prefixed)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import ddl, names
from chronofold.operators import catalog
from chronofold.operators.routing import Route, routed

INFO = """struct<columns:array<struct<id:int,name:string,kind:string,state:string,generated:boolean,nullable:boolean,
  `default`:string,elements:array<string>,zero:string,unsigned:boolean>>,pk_is_handle:boolean,common_handle:boolean,pk:array<struct<id:int,prefixed:boolean>>>"""
#: Fixed value: the id of the column that stands for a handle without a column of its own.
IMPLICIT_ID = -1

_PAIRS = "array<struct<id:int,value:string>>"


def _fixed(value: Column, unsigned: Column) -> Column:
    """A handle as its column shows it: a 64-bit pattern read as unsigned where the column is."""
    wide = value.try_cast("decimal(20,0)")
    return F.when(unsigned & (wide < 0), (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")).otherwise(value)


def inserted(info: Column, pk: Column, pairs: Column) -> Column:
    """Pairs (id, value) of an inserted row: what it holds, and the key columns that only its handle tells.

    Of a handle of several columns each fills its column, unless the row has that column
    itself or the key holds a prefix only. A handle of one column fills the primary key's
    column, or the implicit one.
    """
    own = F.transform(pairs, lambda p: p["id"])
    from_key = F.filter(
        F.transform(info["pk"], lambda k, i: F.struct(k["id"].alias("id"), F.get(pk, i).alias("value"), k["prefixed"].alias("prefixed"))),
        lambda k: ~k["prefixed"] & ~F.array_contains(own, k["id"]),
    )
    common = F.transform(from_key, lambda k: F.struct(k["id"].alias("id"), k["value"].alias("value")))
    key_ids = F.transform(info["pk"], lambda k: k["id"])
    handles = F.filter(info["columns"], lambda c: (info["pk_is_handle"] & F.array_contains(key_ids, c["id"])) | (c["id"] == IMPLICIT_ID))
    one = F.transform(handles, lambda c: F.struct(c["id"].alias("id"), _fixed(F.get(pk, F.lit(0)), c["unsigned"]).alias("value")))
    told = F.filter(pairs, lambda p: ~F.exists(one, lambda o: o["id"] == p["id"]))
    return F.when(info["common_handle"], F.concat(pairs, common)).otherwise(F.concat(told, one)).cast(_PAIRS)


def _nth(pairs: Column, of: Column, nth: int) -> Column:
    return F.get(F.filter(pairs, lambda p: p["id"] == of), F.lit(nth))["value"]


def old_and_new(info: Column, pairs: Column, fill: Column, source: Column) -> Column:
    """struct(old, new, corrupt) of an update's pairs: of each column the first value is old, the second new.

    Another number of values than two is corrupt. A column without any takes its default
    in ``source`` (the table's version at the row's) where ``fill`` allows it; else the row is corrupt.
    """
    ids = F.array_distinct(F.transform(pairs, lambda p: p["id"]))
    odd = F.exists(ids, lambda i: F.size(F.filter(pairs, lambda p: p["id"] == i)) != 2)
    absent = F.filter(info["columns"], lambda c: ~F.array_contains(ids, c["id"]) & ~c["generated"])
    filled = F.transform(absent, lambda c: F.struct(c["id"].alias("id"), default(c, source).alias("value")))

    def image(nth: int) -> Column:
        return F.concat(F.transform(ids, lambda i: F.struct(i.alias("id"), _nth(pairs, i, nth).alias("value"))), filled).cast(_PAIRS)

    return F.struct(image(0).alias("old"), image(1).alias("new"), (odd | (~fill & (F.size(absent) > 0))).alias("corrupt"))


def default(column: Column, source: Column) -> Column:
    """What a column that a row lacks holds: its default in ``source``, null if it may be, the first element, or zero."""
    told = F.get(F.filter(source["columns"], lambda c: c["id"] == column["id"]), F.lit(0))
    return catalog.default_or_zero(F.lit(None).cast("string"), F.coalesce(told["default"], F.when(told["id"].isNull(), column["default"])), column["nullable"], column["elements"], column["zero"])


def _bit(place: Column) -> Column:
    """The number whose only set bit is the ``place``-th, from 1 to 64; 0 for none."""
    return F.when(place > 0, F.conv(F.rpad(F.lit("1"), place.cast("int"), F.lit("0")), 2, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def formatted(value: Column, column: Column, target: str) -> Column:
    """A value for a target (mysql, oracle): enums and sets by number, bits as an unsigned number, all else as its text.

    Dates, timestamps, decimals and JSON are text already; a time of day is refused by the other dialect.
    """
    place = F.array_position(column["elements"], value)
    bits = F.aggregate(F.split(value, ","), F.lit(0).cast("decimal(20,0)"), lambda a, x: (a + _bit(F.array_position(column["elements"], x))).cast("decimal(20,0)"))
    out = F.when(column["kind"] == "enum", place.cast("string")).when(column["kind"] == "set", bits.cast("string"))
    out = out.when(column["kind"] == "bit", F.conv(F.hex(F.unbase64(value)), 16, 10))
    if target == "oracle":
        out = out.when(column["kind"] == "time", F.raise_error(F.lit("unsupported column type[time]")).cast("string"))
    return F.when(value.isNotNull(), out.otherwise(value))


def values_of(info: Column, pairs: Column, target: str = "mysql", missing: Column | None = None, writable: bool = True, upper: bool = False) -> Column:
    """Column names to formatted values of the columns that pairs hold; with ``missing`` (a version of the table) all writable ones."""
    ids = F.transform(pairs, lambda p: p["id"])
    own = F.filter(info["columns"], lambda c: (c["state"] == "public") & ~c["generated"]) if writable else info["columns"]
    if missing is None:
        own = F.filter(own, lambda c: F.array_contains(ids, c["id"]))

    def one(c):
        value = _nth(pairs, c["id"], 0)
        value = value if missing is None else F.when(F.array_contains(ids, c["id"]), value).otherwise(default(c, missing))
        name = F.upper(c["name"]) if upper else c["name"]
        return F.struct(name.alias("name"), formatted(value, c, target).alias("value"))

    return F.map_from_entries(F.transform(own, one))


def _resolved(mutations: DataFrame, tables: DataFrame, fill: Column) -> DataFrame:
    """Mutations with their table's names and infos; a table_id that is not known is an error."""
    known = mutations.join(tables.select("table_id", "db", "tbl", "info", "source", F.lit(True).alias("__known")), "table_id", "left")
    checked = F.when(F.col("__known"), F.col("db")).otherwise(F.raise_error(F.concat(F.lit("unknown table id "), F.col("table_id").cast("string"))).cast("string"))
    both = old_and_new(F.col("info"), F.col("pairs"), fill, F.col("source"))
    return known.withColumn("db", checked).withColumn("__both", F.when(F.col("op") == "U", both)).drop("__known")


def _sound(db: Column, tbl: Column, both: Column, value: Column) -> Column:
    """``value``, unless the update is corrupt, which is an error."""
    bad = F.raise_error(F.concat(F.lit("table "), names.quoted_table(db, tbl), F.lit(": corrupt update")))
    return F.when(F.coalesce(both["corrupt"], F.lit(False)), bad.cast("map<string,string>")).otherwise(value)


def dml_rows(mutations: DataFrame, tables: DataFrame, target: str = "mysql", routes: list[Route] | None = None, fill: Column | None = None) -> DataFrame:
    """commit_ts, txn_seq, op, db, tbl, values, old_values of each mutation; for the other dialect column names in upper case, and routed tables.

    ``tables``: table_id, db, tbl, info, source (the version at the row's). An insert has all
    writable columns, an update those that it holds or may fill, a delete those that it holds.
    """
    m = _resolved(mutations, tables, F.lit(False) if fill is None else fill)
    info, both, upper = F.col("info"), F.col("__both"), target == "oracle"
    new = F.when(F.col("op") == "I", values_of(info, inserted(info, F.col("pk"), F.col("pairs")), target, F.col("source"), upper=upper))
    new = new.when(F.col("op") == "U", _sound(F.col("db"), F.col("tbl"), both, values_of(info, both["new"], target, upper=upper)))
    new = new.otherwise(values_of(info, F.col("pairs"), target, writable=False, upper=upper))
    old = F.when(F.col("op") == "U", values_of(info, both["old"], target, upper=upper))
    m = m.withColumn("__to", routed(F.col("db"), F.col("tbl"), routes or []))
    return m.select("commit_ts", "txn_seq", "op", F.col("__to.db").alias("db"), F.col("__to.tbl").alias("tbl"), new.alias("values"), old.alias("old_values"))


def transactions(dmls: DataFrame, ddls: DataFrame | None = None) -> DataFrame:
    """commit_ts, ddl (db, tbl, sql, skip) or dmls (in order): one row for each transaction."""
    entries = F.struct("txn_seq", "op", "db", "tbl", F.map_entries("values").alias("values"), F.map_entries("old_values").alias("old_values"))  # maps do not sort
    rows = dmls.groupBy("commit_ts").agg(F.array_sort(F.collect_list(entries)).alias("d"))
    back = F.transform("d", lambda x: F.struct(x["txn_seq"].alias("txn_seq"), x["op"].alias("op"), x["db"].alias("db"), x["tbl"].alias("tbl"), F.map_from_entries(x["values"]).alias("values"), F.map_from_entries(x["old_values"]).alias("old_values")))
    none = F.lit(None).cast("struct<db:string,tbl:string,sql:string,skip:boolean>")
    out = rows.select("commit_ts", none.alias("ddl"), back.alias("dmls"))
    if ddls is None:
        return out
    made = ddls.select("commit_ts", F.struct("db", "tbl", "sql", "skip").alias("ddl"), F.lit(None).cast(out.schema["dmls"].dataType).alias("dmls"))
    return out.unionByName(made)


def file_ddl(db: Column, sql: Column) -> Column:
    """A statement as file records carry it: after the use of its database, but for one that makes a database."""
    with_use = F.concat(F.lit("use "), names.quoted(db), F.lit("; "), sql, F.lit(";"))
    return F.when(db == "", sql).when(ddl.is_create_database(sql), F.concat(sql, F.lit(";"))).otherwise(with_use)


def file_events(mutations: DataFrame, tables: DataFrame, fill: Column | None = None) -> DataFrame:
    """commit_ts, txn_seq, db, tbl, op, row of each mutation: row is an array of (name, type, value, changed); updates have both values."""
    m = _resolved(mutations, tables, F.lit(False) if fill is None else fill)
    info, both = F.col("info"), F.col("__both")

    def row(pairs: Column, other: Column | None = None, missing: bool = False):
        ids = F.transform(pairs, lambda p: p["id"])
        own = info["columns"] if missing else F.filter(info["columns"], lambda c: F.array_contains(ids, c["id"]))

        def one(c):
            value = _nth(pairs, c["id"], 0)
            value = F.when(F.array_contains(ids, c["id"]), value).otherwise(default(c, F.col("source"))) if missing else value
            changed = F.lit(None).cast("string") if other is None else _nth(other, c["id"], 0)
            return F.struct(c["name"].alias("name"), c["kind"].alias("type"), value.alias("value"), changed.alias("changed"))

        return F.transform(own, one)

    rows = F.when(F.col("op") == "I", row(inserted(info, F.col("pk"), F.col("pairs")), None, True)).when(F.col("op") == "U", row(both["old"], both["new"])).otherwise(row(F.col("pairs")))
    bad = F.raise_error(F.lit("corrupt update")).cast("array<struct<name:string,type:string,value:string,changed:string>>")
    return m.select("commit_ts", "txn_seq", "db", "tbl", "op", F.when(F.coalesce(both["corrupt"], F.lit(False)), bad).otherwise(rows).alias("row"))


def from_file_events(events: DataFrame) -> DataFrame:
    """commit_ts, txn_seq, op, db, tbl, values, old_values of file events."""

    def named(field: str):
        return F.map_from_entries(F.transform("row", lambda c: F.struct(c["name"], c[field])))

    changed = F.col("op") == "U"
    return events.select("commit_ts", "txn_seq", "op", "db", "tbl", F.when(changed, named("changed")).otherwise(named("value")).alias("values"), F.when(changed, named("value")).alias("old_values"))


def from_file_ddl(records: DataFrame) -> DataFrame:
    """commit_ts, db, tbl, sql of file records (commit_ts, ddl_query): without the use before it. A statement without a database is an error."""
    t = ddl.target(F.col("ddl_query"))
    refused = F.raise_error(F.concat(F.lit("no database in the statement "), F.col("ddl_query"))).cast("string")
    db = F.when(t["db"] == "", refused).otherwise(t["db"])
    return records.select("commit_ts", db.alias("db"), t["tbl"].alias("tbl"), ddl.without_use(F.col("ddl_query")).alias("sql"))


def secondary(mutations: DataFrame, tables: DataFrame) -> DataFrame:
    """commit_ts, tables of self-describing records: each table once, with column_info (name, kind) and mutations in order.

    Rows are arrays in the order of the columns. An insert holds all columns, filled; in updates
    and deletes a column that the row lacks is null.
    """
    m, info = _resolved(mutations, tables, F.lit(True)), F.col("info")

    def row(pairs: Column, missing: bool = False):
        ids = F.transform(pairs, lambda p: p["id"])
        return F.transform(info["columns"], lambda c: F.when(F.array_contains(ids, c["id"]), _nth(pairs, c["id"], 0)).otherwise(default(c, F.col("source")) if missing else F.lit(None).cast("string")))

    def told(nth: int):  # what the update itself holds, without fills
        ids = F.array_distinct(F.transform("pairs", lambda p: p["id"]))
        return F.transform(ids, lambda i: F.struct(i.alias("id"), _nth(F.col("pairs"), i, nth).alias("value"))).cast(_PAIRS)

    now = F.when(F.col("op") == "I", row(inserted(info, F.col("pk"), F.col("pairs")), True)).when(F.col("op") == "U", row(told(1))).otherwise(row(F.col("pairs")))
    before = F.when(F.col("op") == "U", row(told(0)))
    columns = F.transform(info["columns"], lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind")))
    rows = m.select("commit_ts", "db", "tbl", columns.alias("column_info"), F.struct("txn_seq", F.col("op").alias("type"), now.alias("row"), before.alias("change_row")).alias("m"))
    per_table = rows.groupBy("commit_ts", "db", "tbl", "column_info").agg(F.array_sort(F.collect_list("m")).alias("mutations"))
    return per_table.groupBy("commit_ts").agg(F.array_sort(F.collect_list(F.struct("db", "tbl", "column_info", "mutations"))).alias("tables"))


def from_secondary(records: DataFrame, routes: list[Route] | None = None, upper: bool = False) -> DataFrame:
    """commit_ts, txn_seq, op, db, tbl, values, old_values, kinds (upper case only: column name to type) of self-describing records."""
    t = records.select("commit_ts", F.explode("tables").alias("t")).select("commit_ts", routed(F.col("t.db"), F.col("t.tbl"), routes or []).alias("to"), "t.column_info", F.explode("t.mutations").alias("m"))

    def name(c):
        return F.upper(c["name"]) if upper else c["name"]

    own = F.transform("column_info", name)
    kinds = F.map_from_entries(F.transform("column_info", lambda c: F.struct(name(c), c["kind"]))) if upper else F.lit(None).cast("map<string,string>")
    return t.select("commit_ts", "m.txn_seq", F.col("m.type").alias("op"), "to.db", "to.tbl", F.map_from_arrays(own, "m.row").alias("values"), F.when(F.col("m.type") == "U", F.map_from_arrays(own, "m.change_row")).alias("old_values"), kinds.alias("kinds"))
