"""Further queries: projections, record forms, control rows and streams, each with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import ddl, names, tso
from chronofold.operators import apply, catalog, filters, keyinfo, merge, ordering, pairing, statements, translate
from chronofold.plans import views
from chronofold.plans.queries import _ddl_jobs, _facts, _keyed, query
from chronofold.plans.views import ARRIVALS, CHANGES, TRANSACTIONS
from chronofold.streaming import sinks

# ---- scans ----


@query("s22_keys_with_constraints", """SELECT s_suppkey AS tbl, place, name, columns, CAST(name = 'pk' AS BOOLEAN) AS "primary" FROM (
  SELECT s_suppkey, 0 AS place, 'pk' AS name, 'id' AS columns FROM supplier UNION ALL SELECT s_suppkey, 1, 'uk', 'b,a' FROM supplier WHERE s_suppkey % 2 = 0)""")
def s22(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tbl"))
    unique = F.when(F.col("tbl") % 2 == 0, True).otherwise(False)
    indexes = s.select("tbl", F.explode(F.array(F.struct(F.lit("uk").alias("index_name"), unique.alias("is_unique")), F.struct(F.lit("pk").alias("index_name"), F.lit(True).alias("is_unique")))).alias("x")).select("tbl", "x.*")
    constraints = s.select("tbl", F.lit("pk").alias("index_name"), F.lit("P").alias("kind"))
    columns = s.crossJoin(F.broadcast(spark.createDataFrame([("uk", 2, "a"), ("uk", 1, "b"), ("pk", 1, "id")], "index_name string, pos int, col string")))  # three rows
    keys = keyinfo.constrained_keys(indexes, constraints, columns, ["tbl"])
    return keys.select("tbl", F.posexplode("keys").alias("place", "k")).select("tbl", "place", "k.name", F.array_join("k.columns", ",").alias("columns"), F.col("k.primary").alias("primary"))


@query("s22_data_types", "SELECT s_suppkey AS tbl, 'a=' || CASE WHEN s_suppkey % 2 = 0 THEN 'CHAR' ELSE 'NUMBER' END || ';b=DATE' AS types FROM supplier")
def s22_types(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tbl"))
    kind = F.when(F.col("tbl") % 2 == 0, "CHAR").otherwise("NUMBER")
    rows = s.select("tbl", F.explode(F.array(F.struct(F.lit("b").alias("name"), F.lit("DATE").alias("data_type")), F.struct(F.lit("a").alias("name"), kind.alias("data_type")))).alias("x")).select("tbl", "x.*")
    types = keyinfo.data_types(rows, ["tbl"])
    return types.select("tbl", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("types"))


# ---- filters ----


@query("p2_patterns", "SELECT c_custkey, regexp_matches(c_name, '(?i)00000[1-3]') AS free, regexp_matches(c_name, '(?i)^customer#00000000.$') AS whole FROM customer")
def p2(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_name").rlike(filters.pattern("~00000[1-3]")).alias("free"), F.col("c_name").rlike(filters.pattern("customer#00000000.")).alias("whole"))


@query("p8_assembled_rules", "SELECT db, tbl, op, count(*) AS n FROM chg WHERE NOT ((regexp_matches(db, '(?i)^log_') AND op = 'D') OR (db = 'App' AND tbl = 'click' AND op = 'I')) GROUP BY ALL", CHANGES)
def p8(spark, sf_dir):
    templates = {"no-deletes": (("delete",), ()), "no-inserts": (("insert",), ())}
    rules = filters.assembled(templates, [("log_*", "*", ["no-deletes"]), ("App", "click", ["no-inserts"])])
    event = F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete")
    c = views.changes(spark, sf_dir)
    return c.filter(~filters.ignored(rules, F.col("db"), F.col("tbl"), event)).groupBy("db", "tbl", "op").agg(F.count("*").alias("n"))


_KINDS = [
    "create table", "add column", "drop table", "alter table auto id", "update columnar replica status", "lock table", "unlock table", "alter table cache", "alter table nocache",
    "alter table attributes", "alter table partition attributes", "create placement policy", "alter placement policy", "drop placement policy", "alter table partition placement",
    "modify schema default placement", "alter table placement", "create resource group", "alter resource group", "drop resource group",
]


@query("p11_unsupported_jobs", "SELECT p_partkey, kind AS job_type FROM part JOIN " + _facts(list(enumerate(_KINDS)), "k, kind") + " ON p_partkey % 20 = k WHERE k < 4")
def p11(spark, sf_dir):
    kinds = F.array(*map(F.lit, _KINDS))
    jobs = views.table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 20).cast("int")).alias("job_type"))
    return jobs.filter(filters.supported_job(F.col("job_type")))


@query("p12_finished_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 50 > 0")
def p12(spark, sf_dir):
    return _ddl_jobs(spark, sf_dir).filter(filters.finished_job(F.col("state"), F.col("table_id"))).select(F.col("version").alias("o_orderkey"))


@query("p16_replay_filter", """, r AS (SELECT event_id // 7 AS rec, event_id % 70 < 7 AS is_ddl, db, tbl FROM chg), ok AS (SELECT *, lower(db) = 'app' AND tbl <> 'error' AS pass FROM r)
SELECT rec, CAST(CASE WHEN bool_or(is_ddl) THEN count(*) ELSE count(*) FILTER (WHERE pass) END AS BIGINT) AS events FROM ok GROUP BY rec HAVING bool_or(is_ddl) OR count(*) FILTER (WHERE pass) > 0""", CHANGES)
def p16(spark, sf_dir):
    c = views.changes(spark, sf_dir).withColumn("rec", F.expr("event_id div 7"))
    records = c.groupBy("rec").agg(F.collect_list(F.struct("db", "tbl")).alias("events"), F.max(F.when(F.col("event_id") % 70 < 7, "create table app.t(a int)")).alias("ddl_query"))
    rules = filters.TableRules(do_dbs=["app"], ignore_tables=[("app", "error")])
    return filters.replayed(records, rules).select("rec", F.size("events").cast("long").alias("events"))


# ---- joins ----


@query("j7_without_truncated_ids", "SELECT count(*) AS n FROM chg WHERE pk NOT IN (1, 3, 5)", CHANGES)
def j7(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (3,), (5,)], "table_id long")
    return filters.without_truncated(views.changes(spark, sf_dir).withColumnRenamed("pk", "table_id"), gone).agg(F.count("*").alias("n"))


# ---- translation ----


@query("t2_writable_columns", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' ELSE 'a' END AS columns FROM nation")
def t2(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")

    def column(name, state, generated):
        return F.struct(F.lit(name).alias("name"), state.alias("state"), generated.alias("generated"))

    columns = F.array(column("a", F.lit("public"), F.lit(False)), column("b", F.when(F.col("n_nationkey") % 3 == 2, "delete only").otherwise("public"), F.col("n_nationkey") % 3 == 0))
    return n.select("n_nationkey", F.array_join(translate.writable(columns), ",").alias("columns"))


@query("t13_key_order", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PRIMARY:id;uk:b,a' WHEN 1 THEN 'uk:b,a' WHEN 2 THEN 'PRIMARY:id;uk:b,a' ELSE 'PRIMARY:b;uk:b,a' END AS keys FROM orders""")
def t13(spark, sf_dir):
    k = F.col("o_orderkey") % 4

    def index(name, unique, primary, *columns):
        return F.struct(F.lit(name).alias("name"), F.lit(unique).alias("is_unique"), F.lit(primary).alias("is_primary"), F.array(*map(F.lit, columns)).alias("columns"))

    common = [index("uk", True, False, "b", "a"), index("plain", False, False, "c")]
    # 0: the primary key is the handle; 1: no primary key; 2: the same, and listed too; 3: a primary key beside the handle
    indexes = F.when(k == 2, F.array(index("PRIMARY", True, True, "id"), *common)).when(k == 3, F.array(index("PRIMARY", False, True, "b"), *common)).otherwise(F.array(*common))
    keys = keyinfo.record_keys((k == 0) | (k == 2), F.lit("id"), indexes)
    text = F.transform(keys, lambda x: F.concat(x["name"], F.lit(":"), F.array_join(x["columns"], ",")))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text, ";").alias("keys"))


@query("t15_union_arguments", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN CAST(user_id % 256 * 256 + 7 AS VARCHAR) WHEN 4 THEN '' END AS text,
  CASE event_id % 6 WHEN 3 THEN 'FF' || upper(hex(event_type)) END AS bytes FROM events""")
def t15(spark, sf_dir):
    e, k, none = views.table(spark, sf_dir, "events"), F.col("event_id") % 6, F.lit(None)
    two = F.unhex(F.concat(F.lpad(F.hex(F.col("user_id") % 256), 2, "0"), F.lit("07")))  # a bit column of two bytes
    raw = F.when(k == 1, F.col("event_type").cast("binary")).when(k == 2, two).when(k == 3, F.concat(F.unhex(F.lit("FF")), F.col("event_type").cast("binary")))
    u = F.struct(
        F.when(k.isin(0, 5), F.col("user_id")).alias("int_value"), none.cast("decimal(20,0)").alias("uint_value"), none.cast("double").alias("double_value"),
        raw.alias("bytes_value"), none.cast("string").alias("string_value"), (k == 5).alias("is_null"),
    )
    a = translate.argument(u, F.when(k == 1, "json").when(k == 2, "bit").otherwise("blob"))
    return e.select("event_id", a.alias("a")).select("event_id", "a.text", F.hex("a.bytes").alias("bytes"))


_PLACED = ["create table t(a int) placement policy=`p1`", "alter table t placement policy p2", "create table t(a int) TTL_ENABLE='ON'", "drop table t"]


@query("t20_ddl_rewrite", "SELECT id, sql FROM " + _facts([(0, "create table t(a int)"), (1, "alter table t"), (2, "create table t(a int) TTL_ENABLE='OFF'"), (3, "drop table t")], "id, sql"))
def t20(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_PLACED)), "id long, sql string").select("id", ddl.without_placement(F.col("sql")).alias("sql"))


@query("k11_apply_order", "SELECT event_id, CASE op WHEN 'D' THEN 0 WHEN 'I' THEN 1 ELSE 2 END AS rank FROM chg", CHANGES)
def k11(spark, sf_dir):
    return views.changes(spark, sf_dir).select("event_id", apply.apply_rank(F.col("op")).alias("rank"))


_BARE = [s.replace("use shop; ", "").replace("use shop;", "") for s in views.STATEMENTS]
_STATEMENT_ROWS = _facts([(i, f[0], f[1], f[2], b) for i, (f, b) in enumerate(zip(views.STATEMENT_FACTS, _BARE, strict=True))], "id, kind, db, tbl, bare")


@query("d7_target_statements", """SELECT id, CASE WHEN db <> '' AND kind IS DISTINCT FROM 'create database' THEN 'use `' || db || '`; ' ELSE '' END || bare AS mysql,
  CASE WHEN kind = 'truncate table' THEN 'BEGIN ' || db || '.do_truncate(' || chr(39) || db || '.' || tbl || chr(39) || ',' || chr(39) || chr(39) || ');END;' ELSE '' END AS oracle FROM """ + _STATEMENT_ROWS)
def d7(spark, sf_dir):
    """What two targets run for each statement: all of them, and truncations only (also K2)."""
    t = ddl.target(F.col("sql"))
    s = views.statements(spark).select("id", t["db"].alias("db"), t["tbl"].alias("tbl"), ddl.without_use(F.col("sql")).alias("bare"))
    one, other = sinks.mysql_statements(F.col("db"), F.col("bare")), sinks.oracle_statements(F.col("db"), F.col("tbl"), F.col("bare"))
    return s.select("id", F.array_join(one, " ").alias("mysql"), F.array_join(other, " ").alias("oracle"))


@query("k8_print_ddl", "SELECT id, 'DDL query: ' || sql AS text FROM " + _facts(list(enumerate(views.STATEMENTS)), "id, sql"))
def k8_ddl(spark, sf_dir):
    return views.statements(spark).select("id", statements.printed_ddl(F.col("sql")).alias("text"))


# ---- functions ----


@query("f11_ddl_flags", "SELECT id, coalesce(kind = 'create database', false) AS creates_db, coalesce(kind = 'truncate table', false) AS truncates, coalesce(kind IN ('alter table', 'rename table', 'create index', 'drop index', 'truncate table', 'drop table'), false) AS refreshes FROM " + _facts([(i, f[0]) for i, f in enumerate(views.STATEMENT_FACTS)], "id, kind"))
def f11(spark, sf_dir):
    q = F.col("sql")
    return views.statements(spark).select("id", ddl.is_create_database(q).alias("creates_db"), ddl.is_truncate(q).alias("truncates"), ddl.changes_columns(q).alias("refreshes"))


@query("f13_hash_slots")
def f13(spark, sf_dir):
    return views.changes(spark, sf_dir).groupBy(names.hash_slot(F.concat("db", "tbl", F.col("pk").cast("string")), 16).alias("slot")).agg(F.count("*").alias("n"))


@query("f14_conflict_keys", "SELECT event_id AS id, '(pk: ' || pk || ')' || tbl || '|(uk: ' || event_id % 40 || ')' || tbl || CASE WHEN op = 'U' THEN '|(pk: ' || pk || ')' || tbl || '|(uk: ' || event_id % 41 || ')' || tbl ELSE '' END AS keys FROM chg", CHANGES)
def f14(spark, sf_dir):
    return _keyed(spark, sf_dir).select("id", F.array_join("keys", "|").alias("keys"))


# ---- streaming and control ----


@query("m1_heartbeat_rows", """, s AS (SELECT source_id, max(commit_ts) AS ts FROM chg GROUP BY source_id), x AS (SELECT max(ts) AS top FROM s) SELECT source_id, top AS start_ts, top AS commit_ts FROM s, x WHERE (top >> 18) - (ts >> 18) > 3000""", CHANGES)
def m1(spark, sf_dir):
    return merge.idle_heartbeats(views.changes(spark, sf_dir))


@query("m3_late_rows", ", run AS (SELECT *, max(commit_ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arr) SELECT source_id, count(*) AS n FROM run WHERE commit_ts < seen GROUP BY source_id", CHANGES, ARRIVALS)
def m3(spark, sf_dir):
    late = pairing.with_running_max(views.arrivals(spark, sf_dir), F.col("seq"), []).filter("state = 'disorder'")
    return late.groupBy("source_id").agg(F.count("*").alias("n"))


@query("m7_monotone_schema_version", ", v AS (SELECT commit_ts, max(schema_version) OVER (ORDER BY commit_ts ROWS UNBOUNDED PRECEDING) AS version FROM chg) SELECT * FROM v", CHANGES)
def m7(spark, sf_dir):
    c = views.changes(spark, sf_dir)
    return ordering.running(c, F.col("commit_ts"), [], F.col("schema_version"), "version", "max", inclusive=True).select("commit_ts", "version")


@query("m19_ddl_barrier", """, ep AS (SELECT *, 2 * coalesce(sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY commit_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS e FROM chg)
SELECT CAST(e AS BIGINT) AS epoch, count(*) AS n FROM ep GROUP BY 1""", CHANGES)
def m19(spark, sf_dir):
    return merge.ddl_epochs(views.changes(spark, sf_dir), F.col("event_id") % 97 == 0).groupBy("epoch").agg(F.count("*").alias("n"))


@query("m2_stream_release", "SELECT commit_ts, source_id, CAST(event_id AS VARCHAR) AS payload FROM chg WHERE commit_ts <= (SELECT min(m) FROM (SELECT max(commit_ts) AS m FROM chg GROUP BY source_id))", CHANGES)
def m2_stream(spark, sf_dir):
    import uuid

    from chronofold.shipping import shared_folder
    from chronofold.streaming import release

    static = views.table(spark, sf_dir, "events")
    events = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that one file will do
    commit = tso.encode(tso.millis("ts")) + F.col("event_id") % tso.PER_MS
    rows = events.select(commit.alias("commit_ts"), (F.col("user_id") % 3).alias("source_id"), F.col("event_id").cast("string").alias("payload"))
    folder = f"{shared_folder(spark)}/released-{uuid.uuid4().hex}"
    q = release.ordered(rows, 3).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("commit_ts", "source_id", "payload")


# ---- catalog ----


@query("a7_event_groups", "SELECT db, tbl, op, count(*) AS n FROM chg WHERE regexp_matches(lower(db), '(?i)^app$') AND NOT regexp_matches(tbl, '^error$') GROUP BY ALL", CHANGES)
def a7_events(spark, sf_dir):
    rules = filters.TableRules(do_dbs=["app"], ignore_tables=[("app", "error")])
    return views.changes(spark, sf_dir).filter(rules.passes(F.col("db"), F.col("tbl"))).groupBy("db", "tbl", "op").agg(F.count("*").alias("n"))


# ---- functions and catalog over rows of the tables ----


@query("j6_ddl_jobs", """, jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'create table' ELSE 'drop table' END AS job_type FROM orders WHERE o_orderkey % 3 > 0)
SELECT txn, job_id, job_type FROM (SELECT txn, CASE WHEN txn % 5 = 0 THEN txn ELSE 0 END AS job_id FROM txl WHERE tp = 'C') JOIN jobs USING (job_id) WHERE job_id > 0""", TRANSACTIONS)
def j6(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = views.table(spark, sf_dir, "orders").filter(k % 3 > 0).select(k.alias("job_id"), F.when(k % 2 == 0, "create table").otherwise("drop table").alias("job_type"))
    log = views.transactions(spark, sf_dir).filter("tp = 'C'").withColumn("job_id", F.when(F.col("txn") % 5 == 0, F.col("txn")).otherwise(0))
    return catalog.with_jobs(log, jobs).select("txn", "job_id", "job_type")


@query("m8_timestamp_map", "SELECT (commit_ts >> 18) // 60000 AS minute, max(start_ts) AS primary_ts, max(commit_ts) AS secondary_ts FROM chg GROUP BY 1", CHANGES)
def m8(spark, sf_dir):
    return merge.timestamp_map(views.changes(spark, sf_dir))


@query("d6_version_to_table", """, v AS (SELECT schema_version, min(commit_ts) AS commit_ts FROM chg GROUP BY 1) SELECT schema_version, commit_ts, n_name AS db, 't' || n_nationkey AS tbl FROM v JOIN nation ON n_nationkey = schema_version""", CHANGES)
def d6(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version"), F.col("n_name").alias("db"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tbl"))
    return catalog.consumed_once(views.changes(spark, sf_dir), n)


@query("f15_formatted_text", "SELECT event_id, coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN user_id END AS VARCHAR), 'NULL') AS v FROM events")
def f15(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", names.shown(F.when(F.col("event_id") % 3 > 0, F.col("user_id"))).alias("v"))


@query("f18_local_default", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def f18(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    return o.select("o_orderkey", translate.local_default(F.col("t"), "+08:00").alias("t"))


@query("f19_zones", """SELECT o_orderkey, CASE WHEN h * 60 + m <= CASE WHEN s = '-' THEN 779 ELSE 840 END AND o_orderkey % 7 > 0 THEN CASE WHEN s = '-' THEN -1 ELSE 1 END * (h * 60 + m) END AS minutes
FROM (SELECT o_orderkey, o_orderkey % 16 AS h, o_orderkey % 60 AS m, CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '+' END AS s FROM orders)""")
def f19(spark, sf_dir):
    k = F.col("o_orderkey")
    zone = F.concat(F.when(F.col("o_custkey") % 2 == 0, "-").otherwise("+"), F.lpad((k % 16).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 7 == 0, "Asia/Tokyo").otherwise(zone).alias("zone"))
    return o.select("o_orderkey", names.zone_minutes(F.col("zone")).cast("long").alias("minutes"))


@query("f21_sizes_and_durations", """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 90) * 86400 WHEN 1 THEN (o_orderkey % 50) * 3600 + 30 * 60 WHEN 2 THEN (o_orderkey % 50) * 60 + 1.5 END AS DOUBLE) AS seconds,
  CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 50) * 1073741824 WHEN 1 THEN (o_orderkey % 50) * 1000000 END AS bytes FROM orders""")
def f21(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, (k % 90).cast("string")).when(k % 4 == 1, F.concat((k % 50).cast("string"), F.lit("h30m"))).when(k % 4 == 2, F.concat((k % 50).cast("string"), F.lit("m1.5s"))).otherwise("soon")
    size = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit(" GiB"))).when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit("mb"))).otherwise("ten")
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), size.alias("size"))
    return o.select("o_orderkey", names.seconds_of(F.col("text")).alias("seconds"), names.bytes_of(F.col("size")).alias("bytes"))


@query("f9_refused_statements", "SELECT id, CASE WHEN id % 3 = 2 AND kind IS NOT NULL THEN 'several statements' WHEN id % 3 = 2 THEN 'several statements' WHEN kind IS NULL THEN 'unknown statement' END AS problem FROM " + _facts([(i, f[0]) for i, f in enumerate(views.STATEMENT_FACTS)], "id, kind"))
def f9_refused(spark, sf_dir):
    s = views.statements(spark)
    sql = F.when(F.col("id") % 3 == 2, F.concat("sql", F.lit("; drop table second"))).when(F.col("id") % 3 == 1, F.concat("sql", F.lit("; "))).otherwise(F.col("sql"))
    return s.select("id", ddl.problem(sql).alias("problem"))


def _nation_jobs(spark, sf_dir) -> list[catalog.Job]:
    """A schema, a table for each nation, and by its key: a rename, another column, a column being dropped, a truncation, a rolled back job."""
    J, jobs, version = catalog.Job, [catalog.Job(1, "create schema", schema_id=1, db="world")], 1
    for n in views.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # a catalog is small
        k, name, version = n["n_nationkey"], n["n_name"].strip(), version + 1
        jobs.append(J(version, "create table", schema_id=1, table_id=100 + k, tbl=name, columns=("a",)))
        version += 1
        more = {
            0: J(version, "rename table", schema_id=1, table_id=100 + k, tbl=name + "_2", columns=("a",)), 1: J(version, "add column", schema_id=1, table_id=100 + k, tbl=name, columns=("a", "b")),
            2: J(version, "drop column", schema_id=1, table_id=100 + k, tbl=name, columns=("a",), schema_state="delete only"), 3: J(version, "truncate table", schema_id=1, table_id=200 + k, old_table_id=100 + k, tbl=name, columns=("a",)),
            4: J(version, "add column", state="rollback", schema_id=1, table_id=100 + k, tbl=name, columns=("a", "bad")),
        }
        jobs.append(more[k % 5])
    return jobs


_VERSIONS = """made AS (SELECT n_nationkey AS k, trim(n_name) AS name, 2 * n_nationkey + 2 AS v, 100 + n_nationkey AS id FROM nation),
ver AS (SELECT id, name AS tbl, v AS version, 'a' AS columns FROM made UNION ALL
  SELECT CASE WHEN k % 5 = 3 THEN 200 + k ELSE id END, CASE WHEN k % 5 = 0 THEN name || '_2' ELSE name END, v + 1, CASE WHEN k % 5 = 1 THEN 'a,b' ELSE 'a' END FROM made WHERE k % 5 < 4)"""


@query("d2_catalog_fold", "WITH " + _VERSIONS + " SELECT id AS table_id, 'world' AS db, tbl, version, columns, lead(version) OVER (PARTITION BY id ORDER BY version) AS valid_to FROM ver")
def d2(spark, sf_dir):
    c = catalog.Catalog().apply(_nation_jobs(spark, sf_dir))
    return c.versions(spark).select("table_id", "db", "tbl", "version", F.array_join("columns", ",").alias("columns"), "valid_to")


@query("d1_previous_jobs", "SELECT CAST(19 AS BIGINT) AS version, count(*) AS tables FROM nation WHERE 2 * n_nationkey + 2 <= 19")
def d1(spark, sf_dir):
    """The catalog as it was at a version in the middle; a truncated table counts once."""
    c = catalog.Catalog().apply(_nation_jobs(spark, sf_dir), upto=19)
    return spark.createDataFrame([(c.version, len(c.names))], "version long, tables long")


@query("d5_dropping_columns", "SELECT CAST(100 + n_nationkey AS BIGINT) AS table_id FROM nation WHERE n_nationkey % 5 = 2")
def d5(spark, sf_dir):
    c = catalog.Catalog().apply(_nation_jobs(spark, sf_dir))
    return spark.createDataFrame([(t,) for t in sorted(c.dropping)], "table_id long")
