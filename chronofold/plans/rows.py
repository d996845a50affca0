"""Queries over encoded rows: the events as mutations of one table, decoded into transactions and record forms and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import ddl
from chronofold.operators import records
from chronofold.operators.routing import Route
from chronofold.plans import views
from chronofold.plans.queries import _facts, query
from chronofold.plans.views import CHANGES

KINDS = ["view", "click", "purchase", "signup", "error"]


def _column(i, name, kind="int", **more):
    c = {"state": "public", "generated": False, "nullable": True, "default": None, "elements": [], "zero": "0", "unsigned": False} | more
    return (i, name, kind, c["state"], c["generated"], c["nullable"], c["default"], c["elements"], c["zero"], c["unsigned"])


_INFO = ([_column(1, "id", nullable=False), _column(2, "kind", "enum", elements=KINDS, nullable=False), _column(3, "amount", nullable=False), _column(4, "note", "varchar", default="none"), _column(5, "twice", generated=True)], True, False, [(1, False)])


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "App", "log", _INFO, _INFO)], f"table_id long, db string, tbl string, info {records.INFO}, source {records.INFO}")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each minute; an insert lacks its kind or amount now and then, an update its note, a delete its kind."""
    c = views.changes(spark, sf_dir)
    amount = (F.col("event_id") % 1000).cast("string")

    def pair(i, value):
        return F.struct(F.lit(i).alias("id"), value.cast("string").alias("value"))

    new = F.array_compact(F.array(F.when(F.col("event_id") % 4 != 0, pair(2, F.col("tbl"))), F.when(F.col("event_id") % 6 != 0, pair(3, amount))))
    changed = F.array(pair(1, F.col("pk")), pair(1, F.col("pk") + 1), pair(2, F.col("tbl")), pair(2, F.lit("error")), pair(3, amount), pair(3, F.col("pk")))
    gone = F.array(pair(1, F.col("pk")), pair(3, amount))
    pairs = F.when(F.col("op") == "I", new).when(F.col("op") == "U", changed).otherwise(gone)
    minute = F.expr("(commit_ts div 15728640000) * 15728640000")
    return c.select(minute.alias("commit_ts"), F.col("event_id").alias("txn_seq"), F.lit(1).cast("long").alias("table_id"), "op", F.array(F.col("pk").cast("string")).alias("pk"), pairs.alias("pairs"))


_LIST = "['" + "', '".join(KINDS) + "']"
_ROWS = f"""mut AS (SELECT (commit_ts // 15728640000) * 15728640000 AS commit_ts, event_id, op, CAST(pk AS VARCHAR) AS pk, CAST(pk + 1 AS VARCHAR) AS pk1, tbl,
  CAST(event_id % 1000 AS VARCHAR) AS amount, CAST(list_position({_LIST}, tbl) AS VARCHAR) AS place FROM chg)"""
_FILLED = "CASE WHEN event_id % 4 <> 0 THEN place ELSE '1' END AS kind, CASE WHEN event_id % 6 <> 0 THEN amount ELSE '0' END AS amount"


def _rows(spark, sf_dir, **options) -> DataFrame:
    return records.dml_rows(mutations(spark, sf_dir), tables(spark), fill=F.lit(True), **options)


def _value(name: str, of: str = "values"):
    return F.try_element_at(F.col(of), F.lit(name))


@query("t3_inserted_rows", f"SELECT event_id, pk AS id, {_FILLED}, 'none' AS note FROM mut WHERE op = 'I'", CHANGES, _ROWS)
def t3(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("op = 'I'")
    return rows.select(F.col("txn_seq").alias("event_id"), *[_value(c).alias(c) for c in ("id", "kind", "amount", "note")])


@query("t4_updated_rows", "SELECT event_id, pk1 AS id, pk AS old_id, '5' AS kind, place AS old_kind, pk AS amount, amount AS old_amount, 'none' AS note, 'none' AS old_note FROM mut WHERE op = 'U'", CHANGES, _ROWS)
def t4(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("op = 'U'")
    return rows.select(F.col("txn_seq").alias("event_id"), *[_value(c, m).alias(p + c) for c in ("id", "kind", "amount", "note") for p, m in (("", "values"), ("old_", "old_values"))])


@query("t5_delete_rows", "SELECT event_id, pk AS id, amount, 2 AS columns FROM mut WHERE op = 'D'", CHANGES, _ROWS)
def t5(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("op = 'D'")
    return rows.select(F.col("txn_seq").alias("event_id"), _value("id").alias("id"), _value("amount").alias("amount"), F.size("values").alias("columns"))


@query("t7_formatted_values", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate::DATE AS VARCHAR) WHEN 1 THEN CAST(list_position({_LIST}, 'signup') AS VARCHAR) WHEN 2 THEN CAST(1 + 16 * (o_orderkey % 2) AS VARCHAR)
  WHEN 3 THEN CAST(o_orderkey % 200 * 256 + 7 AS VARCHAR) END AS v FROM orders""")
def t7(spark, sf_dir):
    """Dates, enums, sets, bits and nulls by the column's type."""
    o, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    bits = F.base64(F.unhex(F.concat(F.lpad(F.hex(F.col("o_orderkey") % 200), 2, "0"), F.lit("07"))))
    value = F.when(k == 0, F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd")).when(k == 1, "signup").when(k == 2, F.when(F.col("o_orderkey") % 2 == 1, "view,error").otherwise("view")).when(k == 3, bits)
    kind = F.when(k == 0, "date").when(k == 1, "enum").when(k == 2, "set").when(k == 3, "bit").otherwise("int")
    column = F.struct(kind.alias("kind"), F.array(*map(F.lit, KINDS)).alias("elements"))
    rows = o.select("o_orderkey", value.alias("value"), column.alias("c"))
    return rows.select("o_orderkey", records.formatted(F.col("value"), F.col("c"), "mysql").alias("v"))


@query("t8_sql_transactions", "SELECT commit_ts, count(*) AS dmls, string_agg(op || CASE op WHEN 'U' THEN pk1 ELSE pk END, ',' ORDER BY event_id) AS text FROM mut GROUP BY commit_ts", CHANGES, _ROWS)
def t8(spark, sf_dir):
    t = records.transactions(_rows(spark, sf_dir))
    text = F.array_join(F.transform("dmls", lambda d: F.concat(d["op"], F.try_element_at(d["values"], F.lit("id")))), ",")
    return t.select("commit_ts", F.size("dmls").cast("long").alias("dmls"), text.alias("text"))


@query("t9_upper_case_transactions", f"SELECT event_id, 'MAIN' AS db, 'LOGS' AS tbl, pk AS id, {_FILLED} FROM mut WHERE op = 'I'", CHANGES, _ROWS)
def t9(spark, sf_dir):
    """For the other dialect: routed tables, and columns in upper case."""
    rows = _rows(spark, sf_dir, target="oracle", routes=[Route("app", "l*", "MAIN", "LOGS")]).filter("op = 'I'")
    return rows.select(F.col("txn_seq").alias("event_id"), "db", "tbl", *[_value(c.upper()).alias(c) for c in ("id", "kind", "amount")])


@query("t10_file_records", """SELECT event_id, 'id:int:' || pk || ':' || CASE op WHEN 'U' THEN pk1 ELSE '-' END || CASE op WHEN 'I' THEN ';kind:enum:' || CASE WHEN event_id % 4 <> 0 THEN tbl ELSE 'view' END || ':-' WHEN 'U' THEN ';kind:enum:' || tbl || ':error' ELSE '' END
  || ';amount:int:' || CASE WHEN op = 'I' AND event_id % 6 = 0 THEN '0' ELSE amount END || ':' || CASE op WHEN 'U' THEN pk ELSE '-' END || CASE op WHEN 'I' THEN ';note:varchar:none:-;twice:int:NULL:-' WHEN 'U' THEN ';note:varchar:none:none' ELSE '' END AS fields FROM mut""", CHANGES, _ROWS)
def t10(spark, sf_dir):
    events = records.file_events(mutations(spark, sf_dir), tables(spark), F.lit(True))
    field = F.transform("row", lambda c: F.concat_ws(":", c["name"], c["type"], F.coalesce(c["value"], F.lit("NULL")), F.coalesce(c["changed"], F.lit("-"))))
    return events.select(F.col("txn_seq").alias("event_id"), F.array_join(field, ";").alias("fields"))


_BARE = [s.replace("use shop; ", "").replace("use shop;", "") for s in views.STATEMENTS]


@query("t10_file_ddl", "SELECT id, CASE WHEN db = '' THEN bare WHEN kind = 'create database' THEN bare || ';' ELSE 'use `' || db || '`; ' || bare || ';' END AS query FROM " + _facts([(i, f[0], f[1], b) for i, (f, b) in enumerate(zip(views.STATEMENT_FACTS, _BARE, strict=True))], "id, kind, db, bare"))
def t10_ddl(spark, sf_dir):
    s = views.statements(spark).select("id", ddl.target(F.col("sql"))["db"].alias("db"), ddl.without_use(F.col("sql")).alias("bare"))
    return s.select("id", records.file_ddl(F.col("db"), F.col("bare")).alias("query"))


@query("t11_secondary_records", """SELECT commit_ts, 1 AS tables, count(*) AS mutations, string_agg(CASE WHEN op = 'I' AND event_id % 6 = 0 THEN '0' WHEN op = 'U' THEN pk ELSE amount END, ',' ORDER BY event_id) AS amounts FROM mut GROUP BY commit_ts""", CHANGES, _ROWS)
def t11(spark, sf_dir):
    made = records.secondary(mutations(spark, sf_dir), tables(spark))
    first = F.get("tables", F.lit(0))
    amounts = F.array_join(F.transform(first["mutations"], lambda m: F.get(m["row"], F.lit(2))), ",")
    return made.select("commit_ts", F.size("tables").alias("tables"), F.size(first["mutations"]).cast("long").alias("mutations"), amounts.alias("amounts"))


def _back(spark, sf_dir, **options):
    return records.from_secondary(records.secondary(mutations(spark, sf_dir), tables(spark)), **options)


@query("t12_absent_stay_null", "SELECT event_id, CASE op WHEN 'I' THEN 'none' END AS note, CASE op WHEN 'I' THEN CASE WHEN event_id % 4 <> 0 THEN tbl ELSE 'view' END WHEN 'U' THEN 'error' END AS kind FROM mut", CHANGES, _ROWS)
def t12(spark, sf_dir):
    """What an update or a delete lacks is null in self-describing records, whatever its default."""
    return _back(spark, sf_dir).select(F.col("txn_seq").alias("event_id"), _value("note").alias("note"), _value("kind").alias("kind"))


@query("t14_from_secondary", "SELECT event_id, op, 'MAIN' AS db, 'log' AS tbl, CASE op WHEN 'U' THEN pk1 WHEN 'D' THEN pk ELSE pk END AS id, CASE op WHEN 'U' THEN pk END AS old_id, 'enum' AS kind_type FROM mut", CHANGES, _ROWS)
def t14(spark, sf_dir):
    rows = _back(spark, sf_dir, routes=[Route("app", "*", "MAIN", "")], upper=True)
    return rows.select(F.col("txn_seq").alias("event_id"), "op", "db", "tbl", _value("ID").alias("id"), _value("ID", "old_values").alias("old_id"), _value("KIND", "kinds").alias("kind_type"))


@query("t16_from_file_records", "SELECT event_id, op, CASE op WHEN 'U' THEN pk1 ELSE pk END AS id, CASE op WHEN 'U' THEN pk END AS old_id, CASE op WHEN 'U' THEN amount END AS old_amount FROM mut", CHANGES, _ROWS)
def t16(spark, sf_dir):
    rows = records.from_file_events(records.file_events(mutations(spark, sf_dir), tables(spark), F.lit(True)))
    return rows.select(F.col("txn_seq").alias("event_id"), "op", _value("id").alias("id"), _value("id", "old_values").alias("old_id"), _value("amount", "old_values").alias("old_amount"))


@query("t16_from_file_ddl", "SELECT id, db, tbl, bare || ';' AS sql FROM " + _facts([(i, f[1], f[2], b) for i, (f, b) in enumerate(zip(views.STATEMENT_FACTS, _BARE, strict=True)) if f[1] and not f[0].startswith("create database")], "id, db, tbl, bare"))
def t16_ddl(spark, sf_dir):
    t = ddl.target(F.col("sql"))
    s = views.statements(spark).select("id", t["db"].alias("db"), ddl.without_use(F.col("sql")).alias("bare")).filter(~ddl.is_create_database(F.col("bare")) & (F.col("db") != ""))
    made = s.select(F.col("id").alias("commit_ts"), records.file_ddl(F.col("db"), F.col("bare")).alias("ddl_query"))
    return records.from_file_ddl(made).withColumnRenamed("commit_ts", "id")


@query("t18_generated_columns", "SELECT event_id, CASE op WHEN 'D' THEN 'amount,id' ELSE 'amount,id,kind,note' END AS columns FROM mut", CHANGES, _ROWS)
def t18(spark, sf_dir):
    """The generated column of the table is never written; a delete names what it holds."""
    return _rows(spark, sf_dir).select(F.col("txn_seq").alias("event_id"), F.array_join(F.array_sort(F.map_keys("values")), ",").alias("columns"))


@query("t19_known_columns", "SELECT event_id, CASE op WHEN 'D' THEN 'id' ELSE 'id,note' END AS columns, CASE op WHEN 'U' THEN 'id,note' END AS old_columns FROM mut", CHANGES, _ROWS)
def t19(spark, sf_dir):
    """Columns that the target lacks go, of the old values too."""
    from chronofold.operators import translate

    known = F.array(F.lit("note"), F.lit("id"), F.lit("other"))
    left = translate.without_unknown(_rows(spark, sf_dir), known)
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return left.select(F.col("txn_seq").alias("event_id"), keys("values").alias("columns"), keys("old_values").alias("old_columns"))
