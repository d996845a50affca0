"""Row decoding, transactions and record forms, case by case."""

import pytest
from pyspark.sql import functions as F

from chronofold.operators import records
from chronofold.operators.routing import Route


def column(i, name, kind="int", **more):
    c = {"state": "public", "generated": False, "nullable": True, "default": None, "elements": [], "zero": "0", "unsigned": False} | more
    return (i, name, kind, c["state"], c["generated"], c["nullable"], c["default"], c["elements"], c["zero"], c["unsigned"])


#: A person with an enum and a set; by handle, by a key of two columns, and without any key.
COLUMNS = [
    column(1, "id", nullable=False), column(2, "name", "varchar", nullable=False, zero=""), column(3, "mood", "enum", elements=["calm", "wild"], nullable=False),
    column(4, "tags", "set", elements=["x", "y", "z"]), column(5, "total", "decimal", generated=True), column(6, "note", "varchar", default="none"), column(7, "late", state="delete only"),
]
HANDLE = (COLUMNS, True, False, [(1, False)])
COMMON = (COLUMNS, False, True, [(1, False), (2, True)])
PLAIN = ([column(-1, "_handle"), *COLUMNS], False, False, [])
OLDER = ([column(1, "id"), column(6, "note", "varchar", default="older")], True, False, [(1, False)])


def tables(spark, info=HANDLE, source=None):
    return spark.createDataFrame([(7, "Shop", "People", info, source or info)], f"table_id long, db string, tbl string, info {records.INFO}, source {records.INFO}")


def mutations(spark, *rows):
    return spark.createDataFrame([(10, n, 7, *r) for n, r in enumerate(rows)], "commit_ts long, txn_seq int, table_id long, op string, pk array<string>, pairs array<struct<id:int,value:string>>")


def both(rows):
    return [(r["op"], r["values"], r["old_values"]) for r in sorted(rows.collect(), key=lambda r: r["txn_seq"])]


def test_inserts(spark):
    row = ("I", ["5"], [(2, "Ann"), (4, "x,z")])
    got = both(records.dml_rows(mutations(spark, row), tables(spark)))
    # the handle fills the key; the enum's first element, the default and null fill the rest; generated and unfinished columns are not written
    assert got == [("I", {"id": "5", "name": "Ann", "mood": "1", "tags": "5", "note": "none"}, None)]
    older = both(records.dml_rows(mutations(spark, row), tables(spark, source=OLDER)))
    assert older[0][1]["note"] == "older"
    # of a key of two columns the prefixed one does not fill, nor one that the row has itself
    assert both(records.dml_rows(mutations(spark, ("I", ["5", "An"], [(2, "Ann"), (1, "55")])), tables(spark, COMMON)))[0][1]["id"] == "55"
    filled = both(records.dml_rows(mutations(spark, ("I", ["5", "An"], [(3, "wild")])), tables(spark, COMMON)))[0][1]
    assert (filled["id"], filled["name"], filled["mood"]) == ("5", "", "2")
    implicit = both(records.dml_rows(mutations(spark, ("I", ["9"], [(1, "1"), (2, "b")])), tables(spark, PLAIN)))[0][1]
    assert implicit["_handle"] == "9" and implicit["id"] == "1"
    unsigned = ([column(1, "id", unsigned=True)], True, False, [(1, False)])
    assert both(records.dml_rows(mutations(spark, ("I", ["-1"], [])), tables(spark, unsigned)))[0][1] == {"id": "18446744073709551615"}


def test_updates(spark):
    full = [(1, "5"), (1, "6"), (2, "a"), (2, "b"), (3, "calm"), (3, "wild"), (4, None), (4, "y"), (6, "n"), (6, "n"), (7, "0"), (7, "0")]
    got = both(records.dml_rows(mutations(spark, ("U", ["5"], full)), tables(spark)))
    assert got == [("U", {"id": "6", "name": "b", "mood": "2", "tags": "2", "note": "n"}, {"id": "5", "name": "a", "mood": "1", "tags": None, "note": "n"})]
    short = mutations(spark, ("U", ["5"], [p for p in full if p[0] != 6]))
    with pytest.raises(Exception, match="corrupt update"):  # a column is missing and may not be filled
        both(records.dml_rows(short, tables(spark)))
    assert both(records.dml_rows(short, tables(spark), fill=F.lit(True)))[0][2]["note"] == "none"
    with pytest.raises(Exception, match="corrupt update"):
        both(records.dml_rows(mutations(spark, ("U", ["5"], full[:-1])), tables(spark)))


def test_deletes_and_unknown_tables(spark):
    got = both(records.dml_rows(mutations(spark, ("D", ["5"], [(1, "5"), (5, "9"), (4, "z,x")])), tables(spark)))
    assert got == [("D", {"id": "5", "total": "9", "tags": "5"}, None)]
    with pytest.raises(Exception, match="unknown table id 7"):
        both(records.dml_rows(mutations(spark, ("D", ["5"], [(1, "5")])), tables(spark).filter("table_id <> 7")))


def test_formats(spark):
    kinds = [("bit", [], "AQA=", "256"), ("enum", ["a", "b"], "b", "2"), ("set", ["a", "b", "c"], "", "0"), ("set", ["a", "b", "c"], "c,a", "5"), ("json", [], '{"a": 1}', '{"a": 1}'), ("datetime", [], "2024-02-29 10:00:00", "2024-02-29 10:00:00"), ("time", [], "-100:00:00", "-100:00:00"), ("int", [], None, None)]
    df = spark.createDataFrame([(v, (k, e)) for k, e, v, _ in kinds], "v string, c struct<kind:string,elements:array<string>>")
    assert [r["f"] for r in df.select(records.formatted(F.col("v"), F.col("c"), "mysql").alias("f")).collect()] == [w for *_, w in kinds]
    with pytest.raises(Exception, match=r"unsupported column type\[time\]"):
        df.select(records.formatted(F.col("v"), F.col("c"), "oracle").alias("f")).collect()


def test_the_other_dialect(spark):
    rows = mutations(spark, ("I", ["5"], [(2, "Ann")]), ("D", ["5"], [(1, "5"), (2, "Ann")]))
    got = records.dml_rows(rows, tables(spark), "oracle", [Route("shop", "*", "MAIN", "")]).orderBy("txn_seq").collect()
    assert [(r["db"], r["tbl"]) for r in got] == [("MAIN", "People")] * 2 and got[1]["values"] == {"ID": "5", "NAME": "Ann"}


def test_transactions_in_order(spark):
    rows = mutations(spark, *[("I", [str(i)], [(2, f"n{i}")]) for i in range(12)])
    ddls = spark.createDataFrame([(11, "shop", "t", "drop table t", False)], "commit_ts long, db string, tbl string, sql string, skip boolean")
    got = {r["commit_ts"]: r for r in records.transactions(records.dml_rows(rows, tables(spark)), ddls).collect()}
    assert [d["values"]["id"] for d in got[10]["dmls"]] == [str(i) for i in range(12)] and got[10]["ddl"] is None
    assert got[11]["ddl"]["sql"] == "drop table t" and got[11]["dmls"] is None


def test_file_records_and_back(spark):
    full = [(i, v) for i, a, b in [(1, "5", "6"), (2, "a", "b"), (3, "calm", "wild"), (4, None, "y"), (6, "n", "m"), (7, "0", "0")] for v in (a, b)]
    rows = mutations(spark, ("I", ["5"], [(2, "Ann")]), ("U", ["5"], full), ("D", ["6"], [(1, "6"), (4, "y")]))
    events = records.file_events(rows, tables(spark))
    shown = {r["op"]: [tuple(c) for c in r["row"]] for r in events.collect()}
    assert shown["D"] == [("id", "int", "6", None), ("tags", "set", "y", None)] and ("mood", "enum", "calm", "wild") in shown["U"]
    assert ("note", "varchar", "none", None) in shown["I"] and len(shown["I"]) == len(COLUMNS)
    back = {r["op"]: r for r in records.from_file_events(events).collect()}
    assert back["U"]["values"]["tags"] == "y" and back["U"]["old_values"]["tags"] is None and back["D"]["old_values"] is None
    ddls = spark.createDataFrame([("shop", "drop database shop"), ("shop", "create database shop"), ("", "drop table t")], "db string, sql string")
    assert [r["f"] for r in ddls.select(records.file_ddl(F.col("db"), F.col("sql")).alias("f")).collect()] == ["use `shop`; drop database shop;", "create database shop;", "drop table t"]
    one = spark.createDataFrame([(1, "use `shop`; alter table carts add x int;")], "commit_ts long, ddl_query string")
    assert tuple(records.from_file_ddl(one).first())[1:] == ("shop", "carts", "alter table carts add x int;")
    with pytest.raises(Exception, match="no database"):
        records.from_file_ddl(spark.createDataFrame([(1, "drop table t")], "commit_ts long, ddl_query string")).collect()


def test_secondary_records_and_back(spark):
    rows = mutations(spark, ("I", ["5"], [(2, "Ann")]), ("U", ["5"], [(1, "5"), (1, "6"), (6, "n"), (6, "m")]), ("D", ["6"], [(1, "6")]))
    made = records.secondary(rows, tables(spark))
    (t,) = made.first()["tables"]
    assert [c["name"] for c in t["column_info"]] == [c[1] for c in COLUMNS] and [m["type"] for m in t["mutations"]] == ["I", "U", "D"]
    assert t["mutations"][1]["row"] == ["6", None, None, None, None, "m", None]  # what an update lacks stays null
    back = records.from_secondary(made, [Route("*", "*", "to", "x")], upper=True).orderBy("txn_seq").collect()
    assert (back[1]["db"], back[1]["tbl"], back[1]["values"]["NOTE"], back[1]["old_values"]["NOTE"], back[1]["kinds"]["MOOD"]) == ("to", "x", "m", "n", "enum")
    assert back[0]["values"]["MOOD"] == "calm" and records.from_secondary(made).filter("kinds is not null").count() == 0
