"""A query for each operator over the change-log views, with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import ddl, names, tso
from chronofold.operators import apply, catalog, causality, collapse, files, filters, keyinfo, merge, ordering, pairing, routing, statements, translate
from chronofold.plans import views
from chronofold.plans.views import ARRIVALS, CHANGES, TRANSACTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views_used: str):
    """Register a query; ``sql`` may use the named views."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH " + ",\n".join(views_used) + "\n" if views_used else "") + sql
        return f

    return keep


def _facts(rows: list[tuple], columns: str) -> str:
    """Rows as an SQL table."""

    def one(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"


# ---- scans and sources ----

#: A range of the events' days.
RANGE = (1_700_000_000_000 << 18, 1_720_000_000_000 << 18)


def _middle(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """A quarter and three quarters of the way through the log."""
    low, high = views.changes(spark, sf_dir).agg(F.min("commit_ts"), F.max("commit_ts")).first()
    return low + (high - low) // 4, low + 3 * ((high - low) // 4)


_MIDDLE = """rng AS (SELECT min(commit_ts) + (max(commit_ts) - min(commit_ts)) // 4 AS a, min(commit_ts) + 3 * ((max(commit_ts) - min(commit_ts)) // 4) AS b FROM chg)"""


@query("s1_ordered_commit_scan", """, lim AS (SELECT min(commit_ts) + (max(commit_ts) - min(commit_ts)) // 2 AS m, max(commit_ts) AS x FROM txl)
SELECT c.start_ts, c.commit_ts, c.source_id, p.body FROM txl c JOIN txl p ON p.start_ts = c.start_ts AND p.tp = 'P', lim
WHERE c.tp = 'C' AND c.commit_ts > m AND c.commit_ts <= x""", TRANSACTIONS)
def s1(spark, sf_dir):
    log = views.transactions(spark, sf_dir)
    low, high = log.agg(F.min("commit_ts"), F.max("commit_ts")).first()
    if high is None:  # no commits
        low = high = 0
    return pairing.committed_scan(log, low - 1, high, low + (high - low) // 2).select("start_ts", "commit_ts", "source_id", "body")


@query("s5_range_replay", "SELECT event_id, commit_ts FROM chg, rng WHERE commit_ts BETWEEN a AND b", CHANGES, _MIDDLE)
def s5(spark, sf_dir):
    return views.changes(spark, sf_dir).filter(filters.in_range(F.col("commit_ts"), *_middle(spark, sf_dir))).select("event_id", "commit_ts")


@query("s6_range_open_end", "SELECT event_id FROM chg, rng WHERE commit_ts >= b", CHANGES, _MIDDLE)
def s6(spark, sf_dir):
    return views.changes(spark, sf_dir).filter(filters.in_range(F.col("commit_ts"), _middle(spark, sf_dir)[1], 0)).select("event_id")


@query("s7_file_pruning", """, f AS (SELECT event_id % 10 AS suffix, min(commit_ts) AS first_ts FROM (SELECT commit_ts, (row_number() OVER (ORDER BY commit_ts) - 1) // ((SELECT count(*) FROM chg) // 10 + 1) AS event_id FROM chg) GROUP BY 1),
g AS (SELECT *, lead(first_ts) OVER (ORDER BY suffix) AS next_ts FROM f)
SELECT suffix, first_ts FROM g, rng WHERE (next_ts IS NULL OR next_ts > a) AND first_ts <= b""", CHANGES, _MIDDLE)
def s7(spark, sf_dir):
    log = views.changes(spark, sf_dir)
    n, (a, b) = log.count(), _middle(spark, sf_dir)
    place = ordering.running(log, F.col("commit_ts"), [], F.lit(1), "before", "sum")
    starts = place.groupBy(F.expr(f"before div {n // 10 + 1}").alias("suffix")).agg(F.min("commit_ts").alias("first_ts"))
    return files.pruned(starts, "suffix", "first_ts", a, b)


@query("s10_file_names", """, n AS (SELECT event_id, 'binlog-' || lpad(CAST(event_id AS VARCHAR), 16, '0') || CASE WHEN event_id % 3 > 0 THEN '-20240102030405' ELSE '' END
  || CASE event_id % 6 WHEN 1 THEN '-' || commit_ts || '.tar.gz' WHEN 4 THEN '-' || commit_ts ELSE '' END AS name, commit_ts FROM chg WHERE event_id % 5 > 0)
SELECT name, event_id AS suffix, CASE WHEN event_id % 6 IN (1, 4) THEN commit_ts ELSE 0 END AS first_ts FROM n""", CHANGES)
def s10(spark, sf_dir):
    c, k = views.changes(spark, sf_dir), F.col("event_id")
    stamp = F.when(k % 3 > 0, "-20240102030405").otherwise("")
    ts = F.when(k % 6 == 1, F.concat(F.lit("-"), F.col("commit_ts").cast("string"), F.lit(".tar.gz"))).when(k % 6 == 4, F.concat(F.lit("-"), F.col("commit_ts").cast("string"))).otherwise("")
    other = F.when(k % 10 == 0, "savepoint").when(k % 10 == 5, F.concat(F.lit("binlog-x"), k.cast("string")))
    name = F.coalesce(other, F.concat(F.lit("binlog-"), F.lpad(k.cast("string"), 16, "0"), stamp, ts))
    return files.parsed_names(c.select(name.alias("name")), "name")


@query("s12_read_n_from", ", p AS (SELECT a FROM rng) SELECT event_id, commit_ts FROM chg, p WHERE commit_ts >= a ORDER BY commit_ts LIMIT 100", CHANGES, _MIDDLE)
def s12(spark, sf_dir):
    return files.first_from(views.changes(spark, sf_dir), F.col("commit_ts"), _middle(spark, sf_dir)[0], 100).select("event_id", "commit_ts")


@query("s18_point_lookup", ", p AS (SELECT max(start_ts) AS a FROM txl WHERE tp = 'P') SELECT txn, tp, start_ts, commit_ts FROM txl, p WHERE CASE WHEN tp = 'P' THEN start_ts ELSE commit_ts END = a", TRANSACTIONS)
def s18(spark, sf_dir):
    log = views.transactions(spark, sf_dir)
    return pairing.point(log, log.filter("tp = 'P'").agg(F.max("start_ts")).first()[0]).select("txn", "tp", "start_ts", "commit_ts")


_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'create table' WHEN 1 THEN 'add column' WHEN 2 THEN 'lock table' WHEN 3 THEN 'alter table placement' ELSE 'truncate table' END"


def _ddl_jobs(spark, sf_dir):
    o, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "create table").when(k % 5 == 1, "add column").when(k % 5 == 2, "lock table").when(k % 5 == 3, "alter table placement").otherwise("truncate table")
    state = F.when(F.col("o_orderstatus") == "F", "synced").when(F.col("o_orderstatus") == "O", "rollback").otherwise("done")
    return o.select(k.alias("version"), kind.alias("job_type"), state.alias("state"), F.when(k % 50 == 0, (1 << 48) - 1).otherwise(F.col("o_custkey")).alias("table_id"))


@query("s19_ddl_history", f"SELECT o_orderkey AS version, {_KIND} AS job_type FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 5 NOT IN (2, 3) AND o_orderkey % 50 > 0")
def s19(spark, sf_dir):
    jobs = _ddl_jobs(spark, sf_dir)
    return jobs.filter(filters.finished_job(F.col("state"), F.col("table_id")) & filters.supported_job(F.col("job_type"))).orderBy("version").select("version", "job_type")


@query("s20_catalog_snapshot", """, t AS (SELECT DISTINCT db, tbl FROM chg), d AS (SELECT db, 0 AS phase, NULL AS tables FROM (SELECT DISTINCT db FROM t) UNION ALL SELECT db, 1, string_agg(tbl, ',' ORDER BY tbl) FROM t GROUP BY db)
SELECT row_number() OVER (ORDER BY phase, db) AS version, CASE phase WHEN 0 THEN 'create schema' ELSE 'create tables' END AS job_type, db, tables FROM d""", CHANGES)
def s20(spark, sf_dir):
    jobs = catalog.snapshot_jobs(views.changes(spark, sf_dir).select("db", "tbl").distinct())
    return jobs.withColumn("tables", F.array_join("tables", ","))


@query("s21_unique_keys", """SELECT n_nationkey AS tbl, place, name, columns FROM (SELECT n_nationkey, 0 AS place, 'PRIMARY' AS name, 'id' AS columns FROM nation WHERE n_nationkey % 3 > 0
  UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END, 'uk_name', 'region,name' FROM nation WHERE n_nationkey % 2 = 0)""")
def s21(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "tbl")

    def index(name, unique, *columns):
        return [F.struct(F.lit(name).alias("name"), F.lit(unique).alias("is_unique"), F.lit(i).alias("seq"), F.lit(c).alias("col")) for i, c in enumerate(columns, 1)]

    rows = F.when(F.col("tbl") % 3 > 0, F.array(*index("PRIMARY", True, "id"))).otherwise(F.array(*index("by_region", False, "region")))
    more = F.when(F.col("tbl") % 2 == 0, F.array(*reversed(index("uk_name", True, "region", "name")))).otherwise(F.array(*index("by_name", False, "name")))
    indexes = n.select("tbl", F.explode(F.concat(rows, more)).alias("x")).select("tbl", "x.*")
    keys = keyinfo.unique_keys(indexes, ["tbl"])
    return keys.select("tbl", F.posexplode("keys").alias("place", "k")).select("tbl", "place", "k.name", F.array_join("k.columns", ",").alias("columns"))


@query("s21_writable_columns", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'c_custkey' ELSE 'c_custkey,c_name' END AS columns FROM customer WHERE c_custkey % 9 > 0")
def s21_columns(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    extra = F.when(F.col("c_custkey") % 4 == 0, F.when(F.col("c_custkey") % 8 == 0, "VIRTUAL GENERATED").otherwise("STORED GENERATED")).otherwise("auto_increment")
    rows = F.array(F.struct(F.lit(1).alias("place"), F.lit("c_custkey").alias("name"), F.lit("").alias("extra")), F.struct(F.lit(2).alias("place"), F.lit("c_name").alias("name"), extra.alias("extra")))
    gone = F.transform(rows, lambda x: F.struct(x["place"].alias("place"), x["name"].alias("name"), F.when(F.col("c_custkey") % 9 == 0, "STORED GENERATED").otherwise(x["extra"]).alias("extra")))
    columns = c.select("c_custkey", F.explode(gone).alias("x")).select("c_custkey", "x.*")
    return keyinfo.columns_of(columns, ["c_custkey"]).select("c_custkey", F.array_join("columns", ",").alias("columns"))


@query("s23_target_position", ", f AS (SELECT db, tbl, max(commit_ts) AS position FROM chg GROUP BY db, tbl) SELECT * FROM f", CHANGES)
def s23(spark, sf_dir):
    return keyinfo.positions(views.changes(spark, sf_dir), ["db", "tbl"])


# ---- filters ----

RULES = filters.TableRules(do_dbs=["app", "~^log_1"], do_tables=[("log_3", "~ew$")], ignore_tables=[("app", "error")])
_PASSES = """((regexp_matches(lower(db), '(?i)^app$') OR regexp_matches(lower(db), '(?i)^log_1') OR (regexp_matches(lower(db), '(?i)^log_3$') AND regexp_matches(tbl, '(?i)ew$')))
  AND NOT (regexp_matches(lower(db), '(?i)^app$') AND regexp_matches(tbl, '(?i)^error$')))"""


@query("p1_table_filter", f"SELECT db, tbl, count(*) AS n FROM chg WHERE {_PASSES} GROUP BY db, tbl", CHANGES)
def p1(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    return c.filter(RULES.passes(F.col("db"), F.col("tbl"))).groupBy("db", "tbl").agg(F.count("*").alias("n"))


@query("p3_database_ddl_filter", "SELECT DISTINCT db, '' AS tbl FROM chg WHERE db <> 'log_3'", CHANGES)
def p3(spark, sf_dir):
    # statements about a whole database name no table, so a rule for a table does not let them pass
    t = views.changes(spark, sf_dir).select("db", F.lit("").alias("tbl")).distinct()
    return t.filter(filters.TableRules(do_dbs=["app", "~_1$"], do_tables=[("log_3", "view")]).passes(F.col("db"), F.col("tbl")))


EVENT_RULES = [filters.EventRule("log_*", "*", ("delete",)), filters.EventRule("App", "view", ("update",))]
_IGNORED = "((regexp_matches(db, '(?i)^log_.*$') AND op = 'D') OR (regexp_matches(db, '(?i)^App$') AND tbl = 'view' AND op = 'U'))"


def _event(op: str = "op"):
    return F.when(F.col(op) == "I", "insert").when(F.col(op) == "U", "update").otherwise("delete")


@query("p4_event_filter", f"SELECT db, tbl, op, count(*) AS n FROM chg WHERE NOT {_IGNORED} GROUP BY ALL", CHANGES)
def p4(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    return c.filter(~filters.ignored(EVENT_RULES, F.col("db"), F.col("tbl"), _event())).groupBy("db", "tbl", "op").agg(F.count("*").alias("n"))


@query("p5_kept_transactions", f"""SELECT commit_ts, count(DISTINCT db || '.' || tbl) AS mutations, CAST(sum(CASE WHEN {_IGNORED} THEN 0 ELSE 1 END) AS BIGINT) AS events FROM chg WHERE {_PASSES} GROUP BY commit_ts""", CHANGES)
def p5(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    return filters.kept_transactions(c, RULES.passes(F.col("db"), F.col("tbl")), ~filters.ignored(EVENT_RULES, F.col("db"), F.col("tbl"), _event()))


@query("p6_ddl_event_filter", "SELECT id, kind FROM " + _facts([(i, f[0]) for i, f in enumerate(views.STATEMENT_FACTS)], "id, kind") + " WHERE kind IS DISTINCT FROM 'truncate table' AND id NOT IN (6, 7)")
def p6(spark, sf_dir):
    s = views.statements(spark).withColumn("kind", ddl.kind(F.col("sql")))
    rules = [filters.EventRule("*", "*", ("truncate table",), (r"alter\s+table .* (add|drop) ",))]
    return s.filter(~filters.ignored(rules, F.lit(""), F.lit(""), F.col("kind"), F.col("sql"))).select("id", "kind")


_RULES = [(1, "a*", "*", "drop database", None), (2, "a*", "*", None, "alter table .* add"), (3, "a*", "*", "delete", None), (4, "b*", "t*", None, "alter table .* add"), (5, "c*", "t*", "delete", None)]


@query("p9_combined_rules", "SELECT schema, tbl AS \"table\", coalesce(string_agg(ev, ',' ORDER BY rule_id), '') AS events, coalesce(string_agg(pat, ',' ORDER BY rule_id), '') AS sql_patterns FROM " + _facts(_RULES, "rule_id, schema, tbl, ev, pat") + " GROUP BY schema, tbl")
def p9(spark, sf_dir):
    r = spark.createDataFrame(_RULES, "rule_id long, schema string, table string, ev string, pat string")
    rows = r.select("rule_id", "schema", "table", F.array_compact(F.array("ev")).alias("events"), F.array_compact(F.array("pat")).alias("sql_patterns"))
    return filters.combined(rows).select("schema", "table", F.array_join("events", ",").alias("events"), F.array_join("sql_patterns", ",").alias("sql_patterns"))


@query("p10_skipped_commits", ", s AS (SELECT commit_ts FROM chg ORDER BY commit_ts LIMIT 3) SELECT event_id FROM chg WHERE commit_ts NOT IN (SELECT commit_ts FROM s)", CHANGES)
def p10(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    skipped = [r[0] for r in c.select("commit_ts").orderBy("commit_ts").limit(3).collect()]
    return filters.without_commits(c, skipped).select("event_id")


@query("p13_sequence_queries", "SELECT id FROM " + _facts(list(enumerate(views.STATEMENTS)), "id, sql") + " WHERE NOT starts_with(lower(sql), 'select setval')")
def p13(spark, sf_dir):
    return views.statements(spark).filter(filters.real_statement(F.col("sql"))).select("id")


@query("p14_truncated_tables", "SELECT event_id FROM chg WHERE pk NOT IN (SELECT DISTINCT pk FROM chg WHERE event_id % 100 = 0)", CHANGES)
def p14(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumnRenamed("pk", "table_id")
    return filters.without_truncated(c, c.filter("event_id % 100 = 0")).select("event_id")


@query("p15_loop_back", ", m AS (SELECT commit_ts, CASE WHEN event_id % 7 = 0 THEN 'retl' ELSE db END AS d, event_id, event_id % 3 AS ch FROM chg) SELECT event_id FROM m WHERE NOT (d = 'retl' AND ch = 1)", CHANGES)
def p15(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("db", F.when(F.col("event_id") % 7 == 0, "retl").otherwise(F.col("db"))).withColumn("tbl", F.when(F.col("event_id") % 7 == 0, "mark").otherwise(F.col("tbl"))).withColumn("channel_id", F.col("event_id") % 3)
    return filters.without_loop_backs(c, 1, "retl", "mark").select("event_id")


_RANKED = "run AS (SELECT *, max(commit_ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arr)"


@query("p17_repeated_records", "SELECT seq, event_id FROM run WHERE seen IS NULL OR commit_ts > seen", CHANGES, ARRIVALS, _RANKED)
def p17(spark, sf_dir):
    return merge.not_repeated(views.arrivals(spark, sf_dir), F.col("seq"), []).select("seq", "event_id")


@query("p18_after_checkpoint", "SELECT event_id FROM chg, rng WHERE commit_ts > a", CHANGES, _MIDDLE)
def p18(spark, sf_dir):
    return merge.ordered_merge([views.changes(spark, sf_dir)], _middle(spark, sf_dir)[0]).select("event_id")


@query("p20_ignorable_errors", "SELECT code, code IN (1007, 1008, 1049, 1050, 1051, 1054, 1060, 1061, 1091, 1146, 1176, 1831) AS ignorable FROM (SELECT DISTINCT 1000 + p_partkey % 900 AS code FROM part)")
def p20(spark, sf_dir):
    codes = views.table(spark, sf_dir, "part").select((1000 + F.col("p_partkey") % 900).alias("code")).distinct()
    return codes.select("code", ddl.ignorable_error(F.col("code")).alias("ignorable"))


# ---- joins ----


@query("j1_pair_commits", "SELECT c.txn, c.start_ts, c.commit_ts, p.body FROM txl c JOIN txl p ON c.start_ts = p.start_ts AND p.tp = 'P' WHERE c.tp = 'C'", TRANSACTIONS)
def j1(spark, sf_dir):
    return pairing.paired(views.transactions(spark, sf_dir)).select("txn", "start_ts", "commit_ts", "body")


@query("j2_unmatched_prewrites", "SELECT txn, start_ts FROM txl p WHERE tp = 'P' AND NOT EXISTS (SELECT 1 FROM txl o WHERE o.tp <> 'P' AND o.start_ts = p.start_ts)", TRANSACTIONS)
def j2(spark, sf_dir):
    return pairing.unmatched(views.transactions(spark, sf_dir)).select("txn", "start_ts")


@query("j3_resolve_missing", """, op AS (SELECT txn, start_ts FROM txl p WHERE tp = 'P' AND NOT EXISTS (SELECT 1 FROM txl o WHERE o.tp <> 'P' AND o.start_ts = p.start_ts)), nw AS (SELECT max(start_ts) AS n FROM txl)
SELECT txn, CASE WHEN txn % 7 = 0 THEN 'commit' WHEN txn % 7 = 1 THEN 'drop' WHEN txn % 7 = 2 THEN 'wait' WHEN ((n >> 18) - (start_ts >> 18)) / 1000.0 <= 600 THEN 'wait' ELSE 'drop' END AS decision FROM op, nw""", TRANSACTIONS)
def j3(spark, sf_dir):
    log = views.transactions(spark, sf_dir)
    now = log.agg(F.max("start_ts")).first()[0]
    waiting = pairing.unmatched(log).select("txn", "start_ts")
    state = F.when(F.col("txn") % 7 == 0, "committed").when(F.col("txn") % 7 == 1, "rolled back")
    status = waiting.filter("txn % 7 < 3").select("txn", "start_ts", state.alias("state"), F.when(F.col("txn") % 7 == 2, 30).otherwise(0).alias("lock_ttl"))
    return pairing.resolved(waiting, status, now, keys=("txn", "start_ts")).select("txn", "decision")


@query("j4_schema_as_of", "SELECT event_id, (SELECT min(v) FROM (VALUES (2), (4)) AS t(v) WHERE v >= schema_version) AS version FROM chg", CHANGES)
def j4(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    versions = spark.createDataFrame([("App", v) for v in (2, 4)] + [("log_1", v) for v in (2, 4)] + [("log_3", v) for v in (2, 4)], "db string, version int")
    return catalog.as_of(c, versions, ["db"]).select("event_id", "version")


@query("j5_table_names", "SELECT db, tbl, count(*) AS n FROM chg GROUP BY db, tbl", CHANGES)
def j5(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("table_id", F.crc32(F.concat("db", F.lit("."), "tbl").cast("binary")))
    tables = c.select("table_id", "db", "tbl").distinct()
    return catalog.named(c.drop("db", "tbl"), tables).groupBy("db", "tbl").agg(F.count("*").alias("n"))


_DELTA = """delta AS (SELECT DISTINCT pk, last_value(op) OVER w AS op, last_value(value) OVER w AS value FROM chg WINDOW w AS (PARTITION BY pk ORDER BY commit_ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _base(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_acctbal").alias("value"))


def _delta(spark, sf_dir):
    return collapse.collapsed(views.changes(spark, sf_dir), ["pk"], ["commit_ts"], "value", "new").select("pk", "op", F.col("new").alias("value"))


@query("j8_apply_changes", "SELECT c_custkey AS pk, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT pk FROM delta) UNION ALL SELECT pk, value FROM delta WHERE op <> 'D'", CHANGES, _DELTA)
def j8(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    last = c.groupBy("pk").agg(F.max_by(F.struct("op", "value"), "commit_ts").alias("l")).select("pk", "l.op", "l.value")
    return apply.applied(_base(spark, sf_dir), last, ["pk"])


@query("j9_table_diff", """, b AS (SELECT c_custkey AS pk, c_acctbal AS v FROM customer), t AS (SELECT pk, CASE WHEN pk % 5 = 0 THEN v + 1 ELSE v END AS v FROM b WHERE pk % 11 <> 0 UNION ALL SELECT -1, 0.0)
SELECT coalesce(b.pk, t.pk) AS pk, CASE WHEN t.pk IS NULL THEN 'missing' WHEN b.pk IS NULL THEN 'extra' ELSE 'changed' END AS state FROM b FULL JOIN t ON b.pk = t.pk WHERE b.v IS DISTINCT FROM t.v OR b.pk IS NULL OR t.pk IS NULL""", CHANGES)
def j9(spark, sf_dir):
    b = _base(spark, sf_dir)
    t = b.filter("pk % 11 <> 0").withColumn("value", F.when(F.col("pk") % 5 == 0, F.col("value") + 1).otherwise(F.col("value"))).unionByName(spark.createDataFrame([(-1, 0.0)], "pk long, value double"))
    return apply.difference(b, t, ["pk"])


# ---- collapse and aggregates ----

_FOLD = """o AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ts) AS k FROM chg),
lst AS (SELECT pk, max(k) AS n, coalesce(max(CASE WHEN op <> 'U' THEN k END), 0) AS a FROM o GROUP BY pk),
fin AS (SELECT l.pk, o.op AS last_op, o.value AS after_value, an.op AS anchor, f.value AS first_u, o.value AS last_value FROM lst l JOIN o ON o.pk = l.pk AND o.k = l.n LEFT JOIN o an ON an.pk = l.pk AND an.k = l.a LEFT JOIN o f ON f.pk = l.pk AND f.k = l.a + 1),
res AS (SELECT pk, CASE WHEN last_op <> 'U' THEN last_op WHEN anchor = 'I' THEN 'I' ELSE 'U' END AS op, first_u, last_value FROM fin)"""


@query("a1_collapse", "SELECT pk, op, CASE op WHEN 'U' THEN first_u WHEN 'D' THEN last_value END AS before, CASE WHEN op <> 'D' THEN last_value END AS after FROM res", CHANGES, _FOLD)
def a1(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("before", F.col("value")).withColumn("after", F.col("value"))
    return collapse.collapsed(c, ["pk"], ["commit_ts"], "before", "after")


@query("a2_split_key_changes", """SELECT event_id, op, part, k AS key FROM (SELECT event_id, 'D' AS op, 0 AS part, pk AS k FROM chg WHERE op = 'U' AND event_id % 10 = 0 UNION ALL SELECT event_id, 'I', 1, pk + 1 FROM chg WHERE op = 'U' AND event_id % 10 = 0
UNION ALL SELECT event_id, op, 0, pk FROM chg WHERE NOT (op = 'U' AND event_id % 10 = 0))""", CHANGES)
def a2(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    new = F.when((F.col("op") == "U") & (F.col("event_id") % 10 == 0), F.col("pk") + 1).otherwise(F.col("pk"))
    return collapse.split_key_changes(c, F.col("pk"), new).select("event_id", "op", "part", "key")


@query("a3_count_events", "SELECT op, count(*) AS n FROM chg GROUP BY op", CHANGES)
def a3(spark, sf_dir):
    return collapse.counted(views.changes(spark, sf_dir))


_NODES = [("n1", "online", 50), ("n2", "paused", 40), ("n3", "offline", 10), ("n4", "closing", 45)]


@query("a4_safe_gc_ts", "SELECT min(ts) AS safe_ts FROM " + _facts(_NODES, "id, state, ts") + " WHERE state <> 'offline'")
def a4(spark, sf_dir):
    return pairing.safe_gc_ts(spark.createDataFrame(_NODES, "id string, state string, max_commit_ts long"))


@query("a5_file_max_ts", "SELECT txn % 16 AS file, max(greatest(start_ts, coalesce(commit_ts, start_ts))) AS max_ts FROM txl GROUP BY 1", TRANSACTIONS)
def a5(spark, sf_dir):
    return pairing.file_max_ts(views.transactions(spark, sf_dir), F.col("txn") % 16)


@query("a6_final_state", f"""SELECT pk, db, value, commit_ts FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY commit_ts DESC) AS k FROM chg WHERE {_PASSES}) WHERE k = 1 AND op <> 'D'""", CHANGES)
def a6(spark, sf_dir):
    """Flagship: four sources merged and deduplicated, filtered, and folded into the table they leave."""
    c = views.changes(spark, sf_dir)
    late = c.filter("event_id % 50 = 0").withColumn("source_id", F.lit(9).cast("long"))  # a source that repeats others' rows
    rows = merge.deduplicated(c.unionByName(late))
    return collapse.final_state(rows.filter(RULES.passes(F.col("db"), F.col("tbl"))), ["pk"], ["commit_ts"], ["db", "value", "commit_ts"])


@query("a7_table_groups", "SELECT db, tbl, count(*) AS n, min(CASE WHEN tbl = 'view' THEN 0 ELSE 1 END) = 1 AS bulk FROM chg GROUP BY db, tbl", CHANGES)
def a7(spark, sf_dir):
    return collapse.grouped(views.changes(spark, sf_dir), F.col("tbl") != "view")


@query("a9_delay_histogram", """, d AS (SELECT ((commit_ts >> 18) - (start_ts >> 18)) / 1000.0 AS s FROM chg), b AS (SELECT range AS k FROM range(15))
SELECT k AS bucket, 0.001 * (1 << k) AS upto, count(s) AS n FROM b LEFT JOIN d ON d.s <= 0.001 * (1 << k) GROUP BY k""", CHANGES)
def a9(spark, sf_dir):
    delay = (tso.physical(F.col("commit_ts")) - tso.physical(F.col("start_ts"))) / 1000
    return collapse.histogram(views.changes(spark, sf_dir), delay, 0.001, 2.0, 15)


# ---- windows and order ----


@query("w1_running_max", "SELECT seq, event_id, CASE WHEN commit_ts < seen THEN 'disorder' WHEN commit_ts = seen THEN 'dup' ELSE 'ok' END AS state FROM run", CHANGES, ARRIVALS, _RANKED)
def w1(spark, sf_dir):
    return pairing.with_running_max(views.arrivals(spark, sf_dir), F.col("seq"), []).select("seq", "event_id", "state")


@query("w2_resolved_ts", """, op AS (SELECT min(seq) AS s FROM txl p WHERE tp = 'P' AND NOT EXISTS (SELECT 1 FROM txl o WHERE o.tp <> 'P' AND o.start_ts = p.start_ts)) SELECT max(commit_ts) AS resolved_ts FROM txl, op WHERE tp = 'C' AND (s IS NULL OR seq < s)""", TRANSACTIONS)
def w2(spark, sf_dir):
    return pairing.resolved_ts(views.transactions(spark, sf_dir))


@query("w3_disorder_counts", "SELECT CASE WHEN commit_ts < seen THEN 'disorder' WHEN commit_ts = seen THEN 'dup' ELSE 'ok' END AS state, count(*) AS n FROM run GROUP BY 1", CHANGES, ARRIVALS, _RANKED)
def w3(spark, sf_dir):
    return pairing.with_running_max(views.arrivals(spark, sf_dir), F.col("seq"), []).groupBy("state").agg(F.count("*").alias("n"))


@query("w7_suffix_gaps", "SELECT suffix, suffix - lag(suffix) OVER (ORDER BY suffix) - 1 AS gap FROM (SELECT DISTINCT user_id AS suffix FROM events WHERE user_id % 10 <> 3)")
def w7(spark, sf_dir):
    suffixes = views.table(spark, sf_dir, "events").filter("user_id % 10 <> 3").select(F.col("user_id").alias("suffix")).distinct()
    return files.gaps(suffixes)


@query("o1_ordered_merge", """, u AS (SELECT commit_ts, source_id, event_id FROM chg UNION ALL SELECT commit_ts, 9, event_id FROM chg WHERE event_id % 50 = 0) SELECT commit_ts, source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY commit_ts ORDER BY source_id) AS k FROM u) WHERE k = 1""", CHANGES)
def o1(spark, sf_dir):
    c = views.changes(spark, sf_dir).select("commit_ts", "source_id", "event_id")
    again = c.filter("event_id % 50 = 0").withColumn("source_id", F.lit(9).cast("long"))
    return merge.ordered_merge([c, again])


@query("o6_batches", "SELECT tbl, (row_number() OVER (PARTITION BY tbl ORDER BY commit_ts) - 1) // 128 AS batch, event_id FROM chg", CHANGES)
def o6(spark, sf_dir):
    return merge.numbered_batches(views.changes(spark, sf_dir), ["tbl"], ["commit_ts"], 128).select("tbl", "batch", "event_id")


_EPOCH = "ep AS (SELECT *, 2 * coalesce(sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY commit_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS e FROM chg)"


@query("o7_flush_batches", "SELECT event_id, CAST(e AS BIGINT) AS epoch, (row_number() OVER (PARTITION BY e ORDER BY commit_ts) - 1) // 48 AS batch FROM ep", CHANGES, _EPOCH)
def o7(spark, sf_dir):
    return merge.flush_batches(views.changes(spark, sf_dir), F.col("event_id") % 97 == 0, 48).select("event_id", "epoch", "batch")


@query("m2_low_watermark", "SELECT event_id FROM chg WHERE commit_ts <= (SELECT min(m) FROM (SELECT max(commit_ts) AS m FROM chg GROUP BY source_id))", CHANGES)
def m2(spark, sf_dir):
    return merge.released(views.changes(spark, sf_dir)).select("event_id")


@query("m4_thinned_heartbeats", f"""WITH RECURSIVE {CHANGES}, kept AS (SELECT source_id, min(commit_ts) AS commit_ts FROM chg GROUP BY source_id
  UNION ALL SELECT k.source_id, (SELECT min(c.commit_ts) FROM chg c WHERE c.source_id = k.source_id AND (c.commit_ts >> 18) - (k.commit_ts >> 18) > 3600000) FROM kept k WHERE k.commit_ts IS NOT NULL)
SELECT * FROM kept WHERE commit_ts IS NOT NULL""")
def m4(spark, sf_dir):
    return merge.thinned_heartbeats(views.changes(spark, sf_dir), gap_ms=3_600_000)


@query("m9_safe_mode", """SELECT event_id, step, verb FROM (SELECT event_id, 0 AS step, CASE op WHEN 'I' THEN 'replace' ELSE 'delete' END AS verb FROM chg UNION ALL SELECT event_id, 1, 'replace' FROM chg WHERE op = 'U')""", CHANGES)
def m9(spark, sf_dir):
    return apply.repeatable(views.changes(spark, sf_dir)).select("event_id", "step", "verb")


@query("m10_safe_mode_three_steps", """SELECT event_id, step, verb FROM (SELECT event_id, 0 AS step, 'delete' AS verb FROM chg UNION ALL SELECT event_id, 1, CASE op WHEN 'I' THEN 'insert' ELSE 'delete' END FROM chg WHERE op <> 'D' UNION ALL SELECT event_id, 2, 'insert' FROM chg WHERE op = 'U')""", CHANGES)
def m10(spark, sf_dir):
    return apply.repeatable(views.changes(spark, sf_dir), oracle=True).select("event_id", "step", "verb")


def _keyed(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("old_pk", F.col("pk")).withColumn("uk", F.col("event_id") % 40).withColumn("old_uk", F.col("event_id") % 41)
    keys = causality.conflict_keys(F.col("tbl"), [["pk"], ["uk"]], ["pk", "uk"], F.col("op") == "U")
    return c.select(F.col("event_id").alias("id"), "tbl", "commit_ts", F.lit(0).alias("txn_seq"), keys.alias("keys"))


@query("m11_causality")
def m11(spark, sf_dir):
    return causality.ordered_tokens(_keyed(spark, sf_dir), 16)


@query("m14_garbage_collection", """, g AS (SELECT min(commit_ts) + (max(commit_ts) - min(commit_ts)) // 4 AS gc FROM txl) SELECT txn, tp FROM txl, g WHERE CASE WHEN tp = 'P' THEN start_ts > gc - CAST(600000 AS BIGINT) * 262144 ELSE coalesce(commit_ts, start_ts) > gc END""", TRANSACTIONS)
def m14(spark, sf_dir):
    log = views.transactions(spark, sf_dir)
    low, high = log.agg(F.min("commit_ts"), F.max("commit_ts")).first()
    return pairing.collected(log, low + (high - low) // 4, 0, high).select("txn", "tp")


@query("m15_droppable_files", """, f AS (SELECT txn // 100 AS file, max(greatest(start_ts, coalesce(commit_ts, start_ts))) AS max_ts FROM txl GROUP BY 1), g AS (SELECT min(max_ts) + (max(max_ts) - min(max_ts)) // 2 AS gc, max(file) AS newest FROM f) SELECT file, max_ts FROM f, g WHERE max_ts <= gc AND file < newest""", TRANSACTIONS)
def m15(spark, sf_dir):
    files = pairing.file_max_ts(views.transactions(spark, sf_dir), F.expr("txn div 100"))
    low, high = files.agg(F.min("max_ts"), F.max("max_ts")).first()
    return pairing.droppable_files(files, low + (high - low) // 2)


@query("m16_purged_range_alert", """, n AS (SELECT pk, max(commit_ts) AS ts, bool_or(event_id % 100 = 0) AS off FROM chg GROUP BY pk), g AS (SELECT max(commit_ts) - CAST(75600000 AS BIGINT) * 262144 AS gc FROM chg)
SELECT pk AS id FROM n, g WHERE NOT off AND ts < gc + CAST(72000000 AS BIGINT) * 262144""", CHANGES)
def m16(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    gc = c.agg(F.max("commit_ts")).first()[0] - 21 * 3_600_000 * tso.PER_MS
    nodes = c.groupBy(F.col("pk").alias("id")).agg(F.max("commit_ts").alias("max_commit_ts"), F.when(F.max((F.col("event_id") % 100 == 0).cast("int")) == 1, "offline").otherwise("online").alias("state"))
    return pairing.near_collected(nodes, gc).select("id")


@query("m17_safe_to_leave", "SELECT min(ts) >= 40 AS safe FROM " + _facts(_NODES, "id, state, ts") + " WHERE state <> 'offline'")
def m17(spark, sf_dir):
    return pairing.safe_gc_ts(spark.createDataFrame(_NODES, "id string, state string, max_commit_ts long")).select((F.col("safe_ts") >= 40).alias("safe"))


# ---- translation and statements ----


def _mutations(spark, sf_dir):
    """A mutation for each order: one to seven rows, whose kinds follow one another."""
    k = F.col("o_orderkey")
    kinds = F.array(F.lit("I"), F.lit("U"), F.lit("D"))
    places = F.sequence(F.lit(0).cast("long"), k % 7)

    def rows(kind: int):
        return F.transform(F.filter(places, lambda p: (k + p) % 3 == kind), lambda p: k * 10 + p)

    kind_of = F.transform(places, lambda p: F.get(kinds, ((k + p) % 3).cast("int")))
    o = views.table(spark, sf_dir, "orders")
    return o.select(k.alias("commit_ts"), F.lit(1).alias("table_id"), kind_of.alias("sequence"), rows(0).alias("inserted"), rows(1).alias("updated"), rows(2).alias("deleted"))


@query("t1_sequence_unnest", """SELECT o_orderkey AS commit_ts, CAST(p AS INTEGER) AS pos, ['I', 'U', 'D'][(o_orderkey + p) % 3 + 1] AS op, o_orderkey * 10 + p AS "row" FROM (SELECT o_orderkey, unnest(range(o_orderkey % 7 + 1)) AS p FROM orders)""")
def t1(spark, sf_dir):
    return translate.unnested(_mutations(spark, sf_dir)).select("commit_ts", "pos", "op", "row")


@query("t4_old_and_new", "SELECT pk, event_id // 2 AS grp, min_by(value, event_id) AS old, max_by(value, event_id) AS new, count(*) <> 2 AS corrupt FROM chg GROUP BY pk, event_id // 2", CHANGES)
def t4(spark, sf_dir):
    c = views.changes(spark, sf_dir).select("pk", F.expr("event_id div 2").alias("grp"), F.col("event_id").alias("pos"), F.lit("v").alias("column"), "value")
    return translate.old_and_new(c, ["pk", "grp"]).drop("column")


@query("t6_default_fill", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type WHEN event_id % 8 = 0 THEN 'none' WHEN user_id % 2 = 0 THEN NULL ELSE 'click' END AS filled FROM events")
def t6(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    default = F.when(F.col("event_id") % 8 == 0, F.lit("none"))
    elements = F.array(F.lit("click"), F.lit("view"))
    return e.select("event_id", catalog.default_or_zero(value, default, F.col("user_id") % 2 == 0, elements, F.lit("")).alias("filled"))


ROUTES = [routing.Route("log_*", "*", "logs", ""), routing.Route("log_1", "view", "special", "seen"), routing.Route("app", "", "main")]


@query("t17_routed_tables", "SELECT CASE WHEN db = 'log_1' AND tbl = 'view' THEN 'special' WHEN db LIKE 'log_%' THEN 'logs' WHEN db = 'App' THEN 'main' ELSE db END AS db, CASE WHEN db = 'log_1' AND tbl = 'view' THEN 'seen' ELSE tbl END AS tbl, count(*) AS n FROM chg GROUP BY 1, 2", CHANGES)
def t17(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("to", routing.routed(F.col("db"), F.col("tbl"), ROUTES))
    return c.groupBy(F.col("to.db").alias("db"), F.col("to.tbl").alias("tbl")).agg(F.count("*").alias("n"))


@query("t21_insert_statements", "SELECT event_id, 'INSERT INTO `' || db || '`.`' || tbl || '`(`event_id`,`pk`) VALUES(?,?)' AS sql, event_id || ',' || pk AS args FROM chg WHERE op = 'I'", CHANGES)
def t21_insert(spark, sf_dir):
    c = views.changes(spark, sf_dir).filter("op = 'I'")
    s = statements.insert(names.quoted_table(F.col("db"), F.col("tbl")), ["pk", "event_id"])
    return c.select("event_id", s["sql"].alias("sql"), F.array_join(s["args"], ",").alias("args"))


@query("t21_replace_statements", "SELECT event_id, 'REPLACE INTO `' || db || '`.`' || tbl || '`(`event_id`,`pk`) VALUES(?,?)' AS sql FROM chg WHERE op = 'I'", CHANGES)
def t21_replace(spark, sf_dir):
    c = views.changes(spark, sf_dir).filter("op = 'I'")
    return c.select("event_id", statements.replace(names.quoted_table(F.col("db"), F.col("tbl")), ["pk", "event_id"])["sql"].alias("sql"))


@query("t22_update_statements", "SELECT event_id, 'UPDATE `' || db || '`.`' || tbl || '` SET `event_id` = ?,`pk` = ? WHERE ' || CASE WHEN pk % 2 = 0 THEN '`pk` = ?' ELSE '`event_id` = ? AND `pk` IS NULL' END || ' LIMIT 1' AS sql FROM chg WHERE op = 'U'", CHANGES)
def t22(spark, sf_dir):
    c = views.changes(spark, sf_dir).filter("op = 'U'").withColumn("old_pk", F.when(F.col("pk") % 2 == 0, F.col("pk"))).withColumn("old_event_id", F.col("event_id"))
    return c.select("event_id", statements.update(names.quoted_table(F.col("db"), F.col("tbl")), ["pk", "event_id"], [["pk"]])["sql"].alias("sql"))


@query("t22_delete_statements", "SELECT event_id, 'DELETE FROM `' || db || '`.`' || tbl || '` WHERE `pk` = ? LIMIT 1' AS sql FROM chg WHERE op = 'D'", CHANGES)
def t22_delete(spark, sf_dir):
    c = views.changes(spark, sf_dir).filter("op = 'D'")
    return c.select("event_id", statements.delete(names.quoted_table(F.col("db"), F.col("tbl")), ["pk", "event_id"], [["pk"]])["sql"].alias("sql"))


@query("t23_delete_by_new_value", "SELECT event_id, 'DELETE FROM ' || upper(db) || '.' || upper(tbl) || ' WHERE ' || CASE WHEN pk % 2 = 0 THEN 'RTRIM(pk) = :1' ELSE 'event_id = :1 AND pk IS NULL' END || ' AND rownum <=1' AS sql FROM chg WHERE op = 'U'", CHANGES)
def t23(spark, sf_dir):
    c = views.changes(spark, sf_dir).filter("op = 'U'").withColumn("pk", F.when(F.col("pk") % 2 == 0, F.col("pk")))
    return c.select("event_id", statements.delete(translate.shouted(F.col("db"), F.col("tbl")), ["pk", "event_id"], [["pk"]], oracle=True, types={"pk": "CHAR"})["sql"].alias("sql"))


@query("k8_print", """SELECT event_id, 'schema: ' || db || '; table: ' || tbl || '; type: ' || CASE op WHEN 'I' THEN 'Insert' WHEN 'U' THEN 'Update' ELSE 'Delete' END || chr(10) || 'pk(bigint): ' || pk || CASE op WHEN 'U' THEN ' => ' || (pk + 1) ELSE '' END AS text FROM chg""", CHANGES)
def k8(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    fields = F.array(F.struct(F.lit("pk").alias("name"), F.lit("bigint").alias("type"), F.col("pk").cast("string").alias("value"), (F.col("pk") + 1).cast("string").alias("changed")))
    return c.select("event_id", F.array_join(statements.printed(F.col("db"), F.col("tbl"), F.col("op"), fields), "\n").alias("text"))


# ---- scalar functions ----


@query("f1_tso_parts", "SELECT event_id, (epoch_us(ts) // 1000) * 262144 + event_id % 262144 AS tso, epoch_us(ts) // 1000 AS ms, event_id % 262144 AS logical, epoch_us(ts) // 1000000 AS seconds FROM events")
def f1(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", (tso.encode(tso.millis("ts")) + F.col("event_id") % tso.PER_MS).alias("tso"))
    return e.select("event_id", "tso", tso.physical(F.col("tso")).alias("ms"), tso.logical(F.col("tso")).alias("logical"), tso.rough_seconds(F.col("tso")).alias("seconds"))


@query("f3_advanced_tso", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE commit_ts + 262144 * 5000 END AS later FROM chg", CHANGES)
def f3(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("commit_ts")))
    return c.select("event_id", tso.advanced(F.col("t"), 5).alias("later"))


@query("f4_datetime_to_tso", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 * 262144 AS tso FROM events")
def f4(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", tso.from_datetime(text).alias("tso"))


@query("f5_heartbeats", "SELECT count(*) AS n FROM chg WHERE event_id % 11 = 0", CHANGES)
def f5(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("start_ts", F.when(F.col("event_id") % 11 == 0, F.col("commit_ts")).otherwise(F.col("start_ts")))
    return c.filter(tso.is_heartbeat(F.col("start_ts"), F.col("commit_ts"))).agg(F.count("*").alias("n"))


@query("f6_quoted_names", "SELECT event_id, '`' || replace(CASE WHEN event_id % 3 = 0 THEN 'a`' || tbl ELSE tbl END, '`', '``') || '`' AS name FROM chg", CHANGES)
def f6(spark, sf_dir):
    n = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a`"), F.col("tbl"))).otherwise(F.col("tbl"))
    return views.changes(spark, sf_dir).select("event_id", names.quoted(n).alias("name"))


@query("f7_placeholders", "SELECT n_nationkey, array_to_string(list_transform(range(n_nationkey % 4 + 1), lambda x: '?'), ',') AS holders FROM nation")
def f7(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select("n_nationkey", names.placeholder_list(F.col("n_nationkey") % 4 + 1).alias("holders"))


@query("f8_ddl_target", "SELECT id, kind, db, tbl FROM " + _facts([(i, *f[:3]) for i, f in enumerate(views.STATEMENT_FACTS)], "id, kind, db, tbl"))
def f8(spark, sf_dir):
    s = views.statements(spark)
    return s.select("id", ddl.kind(F.col("sql")).alias("kind"), ddl.target(F.col("sql")).alias("t")).select("id", "kind", "t.db", "t.tbl")


@query("f9_ddl_target_after", "SELECT id, db, tbl FROM " + _facts([(i, f[1], f[3]) for i, f in enumerate(views.STATEMENT_FACTS)], "id, db, tbl"))
def f9(spark, sf_dir):
    return views.statements(spark).select("id", ddl.target(F.col("sql"), renamed=True).alias("t")).select("id", "t.db", "t.tbl")


@query("f10_without_use", "SELECT id, regexp_replace(sql, '^use shop; ?', '') AS sql FROM " + _facts(list(enumerate(views.STATEMENTS)), "id, sql"))
def f10(spark, sf_dir):
    return views.statements(spark).select("id", ddl.without_use(F.col("sql")).alias("sql"))


@query("f12_key_text", "SELECT event_id, CASE WHEN pk % 2 = 0 THEN '(pk: ' || pk || ')' ELSE '' END || '(tbl: ' || tbl || ')' AS key FROM chg", CHANGES)
def f12(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("pk", F.when(F.col("pk") % 2 == 0, F.col("pk")))
    return c.select("event_id", names.key_text(["pk", "tbl"]).alias("key"))


@query("f16_unsigned", "SELECT event_id, CASE WHEN v < 0 THEN CAST(v AS DECIMAL(20,0)) + 18446744073709551616 ELSE v END::VARCHAR AS u FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -event_id - 1 ELSE event_id END AS v FROM events)")
def f16(spark, sf_dir):
    v = F.when(F.col("event_id") % 2 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id"))
    return views.table(spark, sf_dir, "events").select("event_id", tso.unsigned(v).cast("string").alias("u"))


@query("f17_enum_and_set", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'male,female' END AS flags FROM nation")
def f17(spark, sf_dir):
    e = F.array(F.lit("male"), F.lit("female"))
    n = F.col("n_nationkey") % 4
    return views.table(spark, sf_dir, "nation").select("n_nationkey", F.when(n > 0, catalog.enum_name(e, n)).alias("sex"), F.array_join(catalog.set_names(e, n.cast("long")), ",").alias("flags"))


@query("f20_relaxed_sql_mode", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ANSI_QUOTES,' ELSE '' END || n_name AS mode FROM nation")
def f20(spark, sf_dir):
    before = F.when(F.col("n_nationkey") % 2 == 0, "ANSI_QUOTES,STRICT_TRANS_TABLES,").when(F.col("n_nationkey") % 3 == 0, "STRICT_TRANS_TABLES,").otherwise("")
    return views.table(spark, sf_dir, "nation").select("n_nationkey", names.relaxed_sql_mode(F.concat(before, F.col("n_name"))).alias("mode"))


@query("f23_node_id", "SELECT n_nationkey, trim(n_name) AS id FROM nation")
def f23(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select("n_nationkey", names.node_id(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "/nodes/").otherwise("  "), F.col("n_name"), F.lit(" "))).alias("id"))


# ---- catalog ----


@query("d4_default_permission", "SELECT event_id, event_id % 6 = 0 OR schema_version < 3 AS allowed FROM chg", CHANGES)
def d4(spark, sf_dir):
    return views.changes(spark, sf_dir).select("event_id", catalog.can_fill_default(F.col("event_id") % 6 == 0, F.col("schema_version"), F.lit(3)).alias("allowed"))


# ---- extras: windows over changes, which the log's engine does not have itself ----


@query("x1_tumbling_windows", "SELECT epoch_us(ts) // 3600000000 AS hour, op, count(*) AS n FROM events e JOIN chg USING (event_id) GROUP BY 1, 2", CHANGES)
def x1(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    return c.groupBy(F.expr("commit_ts div 943718400000").alias("hour"), "op").agg(F.count("*").alias("n"))
