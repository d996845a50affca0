"""Golden cases and model checks of the change-log operators."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronofold.functions import ddl, names, tso
from chronofold.operators import apply, catalog, causality, collapse, filters, merge, ordering, pairing, routing, translate
from chronofold.plans import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def skips(spark, rules, db, tbl):
    return not one(spark, rules.passes(F.lit(db), F.lit(tbl)))


def test_filter_truth_table(spark):
    """Whole names, patterns, tables of a database, blocked names and the empty name, in any case."""
    do = {"do_dbs": ["shop", "~^branch_[0-9]+$"], "do_tables": [("stock", "items"), ("hr", "~staff")]}
    at = [("SHOP", "Carts"), ("branch_12", ""), ("branch_x", ""), ("stock", "items_old"), ("stock", "ITEMS"), ("hr", "old_staff_list"), ("hr", ""), ("shops", "carts")]
    rules = filters.TableRules(**do)
    assert [skips(spark, rules, *t) for t in at] == [False, False, True, True, False, False, True, True]
    rules = filters.TableRules(ignore_dbs=["hr"], ignore_tables=[("shop", "~^carts$")], **do)
    assert [skips(spark, rules, *t) for t in at] == [True, False, True, True, False, True, True, True]
    rules = filters.TableRules(ignore_tables=[("tmp", "x")])
    assert [skips(spark, rules, *t) for t in [("tmp", "x"), ("tmp", "y"), ("any", "x")]] == [True, False, False]
    rules = filters.TableRules(do_dbs=[""])
    assert [skips(spark, rules, *t) for t in [("", "t"), ("shop", "")]] == [False, True]
    with pytest.raises(ValueError):
        filters.TableRules(do_tables=[("shop", "")])


def test_jobs_that_are_not_passed_on(spark):
    kinds = ["lock table", "UNLOCK TABLE", "alter table cache", "alter table nocache", "alter cache table", "alter no cache table", "alter table attributes", "alter table partition attributes"]
    kinds += ["create placement policy", "alter placement policy", "drop placement policy", "alter table partition placement", "modify schema default placement", "alter table placement"]
    kinds += ["create resource group", "alter resource group", "drop resource group", "update columnar replica status"]
    passed = ["create table", "alter table modify column", "drop schema", "rename table", "set columnar replica", "alter table partitioning", "recover table"]
    df = spark.createDataFrame([(k,) for k in kinds + passed], "k string")
    assert {r["k"] for r in df.filter(filters.supported_job(F.col("k"))).collect()} == set(passed)
    jobs = spark.createDataFrame([("done", 1), ("synced", (1 << 48) - 1), ("synced", (1 << 48) - 1001), ("cancelled", 1)], "s string, t long")
    assert jobs.filter(filters.finished_job(F.col("s"), F.col("t"))).count() == 2
    assert one(spark, ddl.ignorable_error(F.lit(1831))) and not one(spark, ddl.ignorable_error(F.lit(1062)))


def test_versions_of_null_keys(spark):
    changes = spark.createDataFrame([(None, 1), ("a", 1), ("a", 9)], "db string, schema_version int")
    versions = spark.createDataFrame([(None, 2), ("a", 3), (None, 5)], "db string, version int")
    got = {(r["db"], r["schema_version"]): r["version"] for r in catalog.as_of(changes, versions, ["db"]).collect()}
    assert got == {(None, 1): 2, ("a", 1): 3, ("a", 9): None}


def test_arguments_of_bits_and_blobs(spark):
    union = "struct<int_value:long,uint_value:decimal(20,0),double_value:double,bytes_value:binary,string_value:string,is_null:boolean>"
    rows = [("bit", (None, None, None, b"\x01\x00", None, False)), ("bit", (None, None, None, b"\xff" * 8, None, None)), ("json", (None, None, None, b'{"a":1}', None, None)), ("blob", (None, None, None, b"\xff\x00", None, None))]
    rows += [("int", (0, None, None, None, None, None)), ("int", (5, None, None, None, None, True)), ("varchar", (None, None, None, None, None, None)), ("varchar", (None, None, None, None, "x", None))]
    got = [tuple(r["a"]) for r in spark.createDataFrame(rows, f"k string, u {union}").select(translate.argument(F.col("u"), F.col("k")).alias("a")).collect()]
    assert got == [("256", None), ("18446744073709551615", None), ('{"a":1}', None), (None, bytearray(b"\xff\x00")), ("0", None), (None, None), ("", None), ("x", None)]


def fold(ops):
    """The effect of one key's changes, step by step: (op, before, after)."""
    out = None
    for op, before, after in ops:
        if out is None or op != "U":
            out = (op, before, after)
        elif out[0] == "I":
            out = ("I", out[1], after)
        elif out[0] == "D":
            out = ("U", before, after)
        else:
            out = ("U", out[1], after)
    return out


def test_collapse_equals_fold(spark):
    rng = random.Random(5)
    rows, model = [], {}
    for n in range(4000):
        k, op = rng.randrange(200), rng.choice("IUD")
        rows.append((k, n, op, n, n + 10**6))
        model.setdefault(k, []).append((op, n, n + 10**6))
    df = spark.createDataFrame(rows, "k long, n long, op string, b long, a long")
    got = {r["k"]: (r["op"], r["b"], r["a"]) for r in collapse.collapsed(df, ["k"], ["n"], "b", "a").collect()}
    for k, ops in model.items():
        op, before, after = fold(ops)
        assert got[k] == (op, before if op != "I" else None, None if op == "D" else after)


def test_collapsed_apply_equals_sequential(spark):
    """Random changes with key updates, in slices: the merged state is the sequential one."""
    rng, state, rows, n = random.Random(7), {}, [], 0
    for _ in range(3000):
        k, n = rng.randrange(100), n + 1
        if k not in state:
            rows.append((n, "I", None, k, n))
            state[k] = n
        elif rng.random() < 0.3:
            rows.append((n, "D", k, None, None))
            del state[k]
        else:
            new = rng.randrange(100) if rng.random() < 0.1 else k
            if new != k and new in state:
                continue
            del state[k]
            state[new] = n
            rows.append((n, "U", k, new, n))
    df = spark.createDataFrame(rows, "n long, op string, old long, new long, v long")
    table = spark.createDataFrame([], "key long, v long")
    for part in range(3):
        piece = collapse.split_key_changes(df.filter(F.floor(F.col("n") / 1001) == part), F.col("old"), F.col("new")).withColumn("before", F.col("v"))
        delta = collapse.collapsed(piece, ["key"], ["n", "part"], "before", "v").select("key", "op", "v")
        table = apply.applied(table, delta, ["key"])
    assert {r["key"]: r["v"] for r in table.collect()} == state


def test_null_keys_are_keys(spark):
    base = spark.createDataFrame([(None, 1), (1, 1)], "k long, v long")
    delta = spark.createDataFrame([(None, "U", 5)], "k long, op string, v long")
    assert sorted(r["v"] for r in apply.applied(base, delta, ["k"]).collect()) == [1, 5]
    assert apply.difference(base, base, ["k"]).count() == 0
    changed = collapse.collapsed(spark.createDataFrame([(None, 1, "I", 1, 1), (None, 2, "U", 1, 2)], "k long, n long, op string, b long, a long"), ["k"], ["n"], "b", "a").collect()
    assert [(r["op"], r["a"]) for r in changed] == [("I", 2)]


def test_ordered_merge(spark):
    """Five sources and a late one, one item out of order: strictly increasing without repeats."""
    rows = [(j * 100 + s, s) for s in range(5) for j in range(9)] + [(150, 9), (101, 9)]
    df = spark.createDataFrame(rows, "commit_ts long, source_id long")
    got = [r["commit_ts"] for r in merge.ordered_merge([df.filter(F.col("source_id") == s) for s in (0, 1, 2, 3, 4, 9)], 0).collect()]
    assert got == sorted({r[0] for r in rows if r[0] > 0})


def test_resolved_ts(spark):
    def log(*records):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "seq long, tp string, start_ts long, commit_ts long")

    assert pairing.resolved_ts(log(("P", 1, None), ("C", 1, 2))).first()[0] == 2
    assert pairing.resolved_ts(log(("P", 1, None), ("P", 2, None), ("C", 2, 3), ("C", 1, 10))).first()[0] == 10
    assert pairing.resolved_ts(log(("P", 1, None), ("C", 1, 5), ("P", 2, None), ("P", 6, None), ("C", 6, 9))).first()[0] == 5


def test_running_max_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 1)
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000)) for i in range(2000)]
    got = {r["i"]: r["m"] for r in ordering.running(spark.createDataFrame(rows, "i long, v long"), F.col("i"), [], F.col("v"), "m", ranges=7).collect()}
    seen = None
    for i, v in rows:
        assert got[i] == seen
        seen = v if seen is None else max(seen, v)
    total = {r["i"]: r["m"] for r in ordering.running(spark.createDataFrame(rows, "i long, v long"), F.col("i"), [], F.col("v"), "m", "sum", True, 5).collect()}
    assert total[1999] == sum(v for _, v in rows)


def test_ddl_targets(spark):
    s = views.statements(spark).select("id", ddl.kind(F.col("sql")).alias("k"), ddl.target(F.col("sql")).alias("t"), ddl.target(F.col("sql"), True).alias("r"))
    for row in s.collect():
        kind, db, tbl, after = views.STATEMENT_FACTS[row["id"]]
        assert (row["k"], row["t"]["db"], row["t"]["tbl"], row["r"]["tbl"]) == (kind, db, tbl, after), views.STATEMENTS[row["id"]]
    assert one(spark, ddl.target(F.lit("ALTER TABLE `a b`.`t``x` ADD c INT"))).asDict() == {"db": "a b", "tbl": "t`x"}
    assert one(spark, ddl.without_placement(F.lit("create table t(a int) placement policy=`p1`"))) == "create table t(a int)"


def test_statements_without_a_target(spark):
    at = lambda sql: one(spark, ddl.problem(F.lit(sql)))
    assert at("use a; drop table t;") is None and at("insert into t values (1)") == "unknown statement" and at("drop table a; drop table b") == "several statements"
    assert at("alter table t comment = 'a; b'") is None and at("alter table `x;y` add c int ;  ") is None
    with pytest.raises(Exception, match="unknown statement"):
        one(spark, ddl.checked_target(F.lit("optimize t")))
    assert one(spark, ddl.checked_target(F.lit("use a; drop table t"))).asDict() == {"db": "a", "tbl": "t"}


def test_columns_of_durations_sizes_zones(spark):
    texts = ["7", "1h30m", "+2ms", "soon", "1h x", "", "1.5m", None]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(names.seconds_of(F.col("t")).alias("s")).collect()]
    assert got == [604800.0, 5400.0, 0.002, None, None, None, 90.0, None]
    got = [r["s"] for r in spark.createDataFrame([("10 GiB",), ("5kb",), ("7",), ("x",), ("3 parsecs",)], "t string").select(names.bytes_of(F.col("t")).alias("s")).collect()]
    assert got == [10 << 30, 5000, 7, None, None]
    got = [r["s"] for r in spark.createDataFrame([("+08:00",), ("-12:59",), ("-13:00",), ("+14:01",), ("Asia/Tokyo",), ("+1:75",)], "t string").select(names.zone_minutes(F.col("t")).alias("s")).collect()]
    assert got == [480, -779, None, None, None, None]


def test_durations_sizes_zones():
    assert names.seconds("7") == 7 * 86400 and names.seconds("1h30m") == 5400 and names.size_bytes("10 GiB") == 10 << 30
    assert names.zone_offset_minutes("+08:00") == 480 and names.zone_offset_minutes("-12:59") == -779 and names.zone_offset_minutes("Asia/Tokyo") is None
    for bad in ("SYSTEM", "Local", "+14:01", "-13:00"):
        with pytest.raises(ValueError):
            names.zone_offset_minutes(bad)
    with pytest.raises(ValueError):
        names.seconds("soon")


def test_catalog(spark):
    J = catalog.Job
    jobs = [
        J(1, "create schema", schema_id=1, db="app"), J(2, "create table", schema_id=1, table_id=10, tbl="a", columns=("x",)), J(3, "add column", state="rollback", schema_id=1, table_id=10, columns=("x", "bad")),
        J(4, "add column", schema_id=1, table_id=10, tbl="a", columns=("x", "y")), J(5, "truncate table", schema_id=1, table_id=11, old_table_id=10, tbl="a", columns=("x", "y")), J(6, "rename table", schema_id=1, table_id=11, tbl="b", columns=("x", "y")),
    ]
    c = catalog.Catalog().apply(jobs)
    assert c.names == {11: (1, "b")} and c.truncated == {10} and c.version == 6
    assert c.apply(jobs).version == 6  # versions already applied are passed over
    with pytest.raises(catalog.CatalogError):
        catalog.Catalog().apply([J(1, "drop table", table_id=3)])
    with pytest.raises(catalog.CatalogError):
        catalog.Catalog().apply([J(1, "create schema", schema_id=1, db="a"), J(2, "create schema", schema_id=2, db="a")])
    catalog.Catalog().apply([J(1, "create schema", schema_id=1, db="mysql"), J(2, "create schema", schema_id=2, db="mysql")])
    dropping = catalog.Catalog().apply([J(1, "create schema", schema_id=1, db="a"), J(2, "create table", schema_id=1, table_id=5, tbl="t", columns=("x", "y")), J(3, "drop column", schema_id=1, table_id=5, columns=("x",), schema_state="delete only")])
    assert dropping.dropping == {5}
    versions = spark.createDataFrame([(1, v) for v in (1, 2, 3)], "t long, version long")
    assert sorted(r["version"] for r in catalog.retained(versions, ["t"]).collect()) == [2, 3]


def plain_tokens(keys_in_order):
    """(epoch, token) of each change, by hand: groups of keys as sets; a change that touches two groups starts a new epoch."""
    epoch, groups, out = 0, [], []
    for keys in keys_in_order:
        touched = [g for g in groups if g[1] & set(keys)]
        if len(touched) > 1:
            epoch, groups, touched = epoch + 1, [], []
        if not touched:
            touched = [(keys[0], set())]
            groups.append(touched[0])
        touched[0][1].update(keys)
        out.append((epoch, touched[0][0]))
    return out


def test_causality(spark):
    assert plain_tokens([["a", "b"], ["b", "c"], ["d"], ["c", "d"], ["a"]]) == [(0, "a"), (0, "a"), (0, "d"), (1, "c"), (1, "a")]
    rng = random.Random(6)
    rows = [(i, f"t{i % 3}", i, 0, [f"k{rng.randrange(25)}" for _ in range(rng.randrange(1, 4))]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, tbl string, commit_ts long, txn_seq int, keys array<string>")
    want = {}
    for t in ("t0", "t1", "t2"):
        own = [r for r in rows if r[1] == t]
        want |= dict(zip([r[0] for r in own], plain_tokens([r[4] for r in own]), strict=True))
    found = causality.ordered_tokens(df.repartition(5), 4).collect()
    assert {x["commit_ts"]: (x["epoch"], x["token"]) for x in found} == want
    assert all(x["worker"] == zlib.crc32(x["token"].encode()) % 4 for x in found)
    # of one epoch, changes with a common key have one token
    for t in ("t0", "t1", "t2"):
        by_key = {}
        for x in found:
            if x["tbl"] == t:
                for k in rows[x["commit_ts"]][4]:
                    by_key.setdefault((x["epoch"], k), set()).add(x["token"])
        assert all(len(v) == 1 for v in by_key.values())
    links = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["z"]), (5, ["z", "y"])], "id long, keys array<string>")
    assert {x["id"]: x["group"] for x in causality.linked_groups(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_conflict_keys_without_unique_keys(spark):
    """A whole row's text is hashed; an update has both images' keys."""
    df = spark.createDataFrame([("U", 1, "x", 1, "y"), ("I", 1, None, None, None)], "op string, a int, b string, old_a int, old_b string")
    got = [r["k"] for r in df.select(causality.conflict_keys(F.lit("t"), [], ["a", "b"], F.col("op") == "U").alias("k")).collect()]
    crc = lambda text: str(zlib.crc32(text.encode()))
    assert got == [[crc("(a: 1)(b: x)t"), crc("(a: 1)(b: y)t")], [crc("(a: 1)t")]]


def test_hash_slots(spark):
    keys = ["", "a", "App.click.7", "ключ"]
    got = [r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(names.hash_slot(F.col("k"), 16).alias("s")).collect()]
    assert got == [zlib.crc32(k.encode()) % 16 for k in keys]


def test_one_far_timestamp_and_one_table(spark, monkeypatch):
    """An outlier does not put all rows into one range, and a table that holds nearly all rows is numbered by ranges."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 1)
    rows = [(i, "big" if i % 50 else "small") for i in range(3000)] + [(10**15, "big"), (-(10**12), None)]
    df = spark.createDataFrame(rows, "ts long, tbl string")
    cuts = ordering.bounds(df, F.col("ts"), 16)
    sizes = [r["count"] for r in df.groupBy(ordering.range_of(F.col("ts"), cuts).alias("r")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(rows) / 16
    got = {r["ts"]: r["n"] for r in ordering.numbered(df, ["tbl"], F.col("ts"), [], "n", ranges=7).collect()}
    for tbl in ("big", "small", None):
        assert [got[ts] for ts in sorted(t for t, x in rows if x == tbl)] == list(range(sum(x == tbl for _, x in rows)))
    batches = merge.numbered_batches(df, ["tbl"], ["ts"], 100).groupBy("tbl", "batch").count().collect()
    assert max(r["count"] for r in batches) == 100 and sum(r["count"] for r in batches) == len(rows)
    epochs = merge.flush_batches(df.filter("ts >= 0").withColumnRenamed("ts", "commit_ts"), F.lit(False), 700).groupBy("epoch", "batch").count().collect()  # a log without any DDL
    assert sorted(r["count"] for r in epochs) == [201, 700, 700, 700, 700]  # 3,001 rows
    assert ordering.running(df.limit(0), F.col("ts"), [], F.col("ts"), "m").count() == 0


def test_sequence_unnest(spark):
    df = spark.createDataFrame([(1, 2, ["I", "U", "I", "D"], [10, 11], [20], [30])], "commit_ts long, table_id long, sequence array<string>, inserted array<long>, updated array<long>, deleted array<long>")
    got = sorted((r["pos"], r["op"], r["row"]) for r in translate.unnested(df).collect())
    assert got == [(0, "I", 10), (1, "U", 20), (2, "I", 11), (3, "D", 30)]


def test_routes_by_specificity(spark):
    routes = [routing.Route("*", "*", "all"), routing.Route("ab*", "*", "abs"), routing.Route("abc", "t", "one", "x")]
    at = lambda db, tbl: tuple(one(spark, routing.routed(F.lit(db), F.lit(tbl), routes)))
    assert at("abc", "t") == ("one", "x") and at("abd", "t") == ("abs", "t") and at("z", "q") == ("all", "q")


def test_range(spark):
    ts = spark.range(10).withColumn("t", F.col("id"))
    assert [ts.filter(filters.in_range(F.col("t"), a, b)).count() for a, b in [(0, 0), (3, 5), (9, 9), (5, 0), (7, 3)]] == [10, 3, 1, 5, 0]


def test_tso_in_any_zone(spark):
    row = spark.sql("select TIMESTAMP_NTZ'1970-01-01 00:00:01.5' as ts").select(tso.encode(tso.millis("ts")).alias("t")).first()
    assert row["t"] == 1500 << 18
    assert one(spark, tso.unsigned(F.lit(-1).cast("long"))) == 18446744073709551615


def test_thinned_heartbeats(spark):
    rows = [(1, t << 18) for t in (0, 1000, 3000, 3001, 6000, 6003)] + [(2, 5 << 18)]
    got = sorted((r["source_id"], r["commit_ts"] >> 18) for r in merge.thinned_heartbeats(spark.createDataFrame(rows, "source_id long, commit_ts long")).collect())
    assert got == [(1, 0), (1, 3001), (1, 6003), (2, 5)]
    rng = random.Random(8)
    many = sorted({(s, rng.randrange(400_000)) for s in range(3) for _ in range(700)})
    kept, last = [], {}
    for s, ms in many:
        if s not in last or ms - last[s] > 3000:
            last[s] = ms
            kept.append((s, ms))
    rng.shuffle(many)
    found = merge.thinned_heartbeats(spark.createDataFrame([(s, ms << 18) for s, ms in many], "source_id long, commit_ts long").repartition(4)).collect()
    assert sorted((r["source_id"], r["commit_ts"] >> 18) for r in found) == kept


def test_loop_back_and_replay(spark):
    c = spark.createDataFrame([(1, "a", "t", None), (1, "retl", "mark", 100), (2, "a", "t", None), (2, "retl", "mark", 7)], "commit_ts long, db string, tbl string, channel_id long")
    assert {r["commit_ts"] for r in filters.without_loop_backs(c, 100, "retl", "mark").collect()} == {2}
    r = spark.createDataFrame([(1, "create table db.t(a int)", []), (2, None, [("db", "t"), ("x", "y")]), (3, None, [("x", "y")])], "commit_ts long, ddl_query string, events array<struct<db:string,tbl:string>>")
    kept = {x["commit_ts"]: len(x["events"]) for x in filters.replayed(r, filters.TableRules(do_dbs=["db"])).collect()}
    assert kept == {1: 0, 2: 1}
