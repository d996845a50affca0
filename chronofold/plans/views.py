"""Change-log views over the test tables, the same in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import tso


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from events: one for each event, keyed by user."""
    e = table(spark, sf_dir, "events")
    commit = tso.encode(tso.millis("ts")) + F.col("event_id") % tso.PER_MS
    version = 1 + F.col("event_id") % 5
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    db = F.when(F.col("user_id") % 2 == 0, "App").otherwise(F.concat(F.lit("log_"), (F.col("user_id") % 4).cast("string")))
    return e.select(
        "event_id", F.col("user_id").alias("pk"), (F.col("user_id") % 3).alias("source_id"), version.alias("schema_version"), commit.alias("commit_ts"),
        (commit - tso.PER_MS * version).alias("start_ts"), op.alias("op"), db.alias("db"), F.col("event_type").alias("tbl"), "value",
    )


CHANGES = """chg AS (
  SELECT event_id, user_id AS pk, user_id % 3 AS source_id, 1 + event_id % 5 AS schema_version,
    (epoch_us(ts) // 1000) * 262144 + event_id % 262144 AS commit_ts,
    (epoch_us(ts) // 1000) * 262144 + event_id % 262144 - 262144 * (1 + event_id % 5) AS start_ts,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
    CASE WHEN user_id % 2 = 0 THEN 'App' ELSE 'log_' || CAST(user_id % 4 AS VARCHAR) END AS db, event_type AS tbl, value
  FROM events)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as they arrive: some late, some a second time. seq is the order of arrival."""
    c = changes(spark, sf_dir)
    late = F.when(F.col("event_id") % 20 == 0, F.col("event_id") * 10 + 255).otherwise(F.col("event_id") * 10)
    again = c.filter("event_id % 50 = 7").withColumn("seq", F.col("event_id") * 10 + 1)
    return c.withColumn("seq", late).unionByName(again)


ARRIVALS = """arr AS (
  SELECT *, CASE WHEN event_id % 20 = 0 THEN event_id * 10 + 255 ELSE event_id * 10 END AS seq FROM chg
  UNION ALL SELECT *, event_id * 10 + 1 AS seq FROM chg WHERE event_id % 50 = 7)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records from orders: a prewrite each, and a commit or rollback unless still open."""
    o = table(spark, sf_dir, "orders")
    commit = tso.encode(tso.millis("o_orderdate")) + F.col("o_orderkey") % tso.PER_MS
    start = commit - tso.PER_MS * (1 + F.col("o_orderkey") % 5)
    base = o.select(F.col("o_orderkey").alias("txn"), (F.col("o_orderkey") % 4).alias("source_id"), start.alias("start_ts"), commit.alias("c"), F.col("o_totalprice").alias("body"),
                    ((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"))).alias("open"))
    back = F.col("txn") % 10 == 3
    p = base.select("txn", "source_id", F.lit("P").alias("tp"), "start_ts", F.lit(None).cast("long").alias("commit_ts"), "body", (F.col("start_ts") * 2).alias("seq"))
    c = base.filter(~back & ~F.col("open")).select("txn", "source_id", F.lit("C").alias("tp"), "start_ts", F.col("c").alias("commit_ts"), F.lit(None).cast("double").alias("body"), (F.col("c") * 2 + 1).alias("seq"))
    r = base.filter(back).select("txn", "source_id", F.lit("R").alias("tp"), "start_ts", F.lit(None).cast("long").alias("commit_ts"), F.lit(None).cast("double").alias("body"), (F.col("c") * 2 + 1).alias("seq"))
    return p.unionByName(c).unionByName(r)


TRANSACTIONS = """txo AS (
  SELECT o_orderkey AS txn, o_orderkey % 4 AS source_id, (epoch_us(o_orderdate) // 1000) * 262144 + o_orderkey % 262144 AS c, o_totalprice AS body,
    o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-01-01' AS open FROM orders),
txs AS (SELECT *, c - 262144 * (1 + txn % 5) AS start_ts FROM txo),
txl AS (
  SELECT txn, source_id, 'P' AS tp, start_ts, CAST(NULL AS BIGINT) AS commit_ts, body, start_ts * 2 AS seq FROM txs
  UNION ALL SELECT txn, source_id, 'C', start_ts, c, NULL, c * 2 + 1 FROM txs WHERE txn % 10 <> 3 AND NOT open
  UNION ALL SELECT txn, source_id, 'R', start_ts, NULL, NULL, c * 2 + 1 FROM txs WHERE txn % 10 = 3)"""

#: Statements about a shop, with and without their database: (statement, kind, database, table, table after a rename).
_STATEMENTS = [
    ("CREATE SCHEMA IF NOT EXISTS shop", "create database", "shop", "", ""),
    ("drop database old_shop", "drop database", "old_shop", "", ""),
    ("use shop; create table if not exists carts (id bigint primary key, total decimal(10, 2))", "create table", "shop", "carts", "carts"),
    ("create table `week days` (n int)", "create table", "", "week days", "week days"),
    ("drop table if exists shop.carts", "drop table", "shop", "carts", "carts"),
    ("use shop; drop table wishes", "drop table", "shop", "wishes", "wishes"),
    ("use shop; alter table carts add column note varchar(20)", "alter table", "shop", "carts", "carts"),
    ("ALTER TABLE carts DROP INDEX by_total", "alter table", "", "carts", "carts"),
    ("use shop; truncate table carts", "truncate table", "shop", "carts", "carts"),
    ("truncate shop.carts", "truncate table", "shop", "carts", "carts"),
    ("use shop; create unique index by_total on carts (total)", "create index", "shop", "carts", "carts"),
    ("drop index by_total on shop.carts", "drop index", "shop", "carts", "carts"),
    ("use shop;rename table carts to baskets", "rename table", "shop", "carts", "baskets"),
    ("rename table shop.carts to shop.baskets", "rename table", "shop", "carts", "baskets"),
    ("create view dear as select * from carts where total > 100", "create view", "", "dear", "dear"),
    ("SELECT SETVAL(cart_ids, 400)", None, "", "", ""),
    ("revoke select on shop.carts from visitor", None, "", "", ""),
]
STATEMENTS = [s for s, *_ in _STATEMENTS]
#: What the statements above are about: kind, database, table, and the table after a rename.
STATEMENT_FACTS = [tuple(f) for _, *f in _STATEMENTS]


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STATEMENTS)), "id long, sql string")
