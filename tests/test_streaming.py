"""Ordered release, checkpoints and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.streaming import checkpoint, release, sinks


def test_fold_releases_in_order():
    rng, seen, held, done, dropped, out = random.Random(2), {}, [], -1, 0, []
    rows = [(t * 10 + s, s, f"{s}-{t}") for s in range(3) for t in range(30)]
    per = {s: sorted(r for r in rows if r[1] == s) for s in range(3)}
    while any(per.values()):
        batch = []
        for _ in range(7):
            s = rng.choice([s for s in per if per[s]] or [0])
            if per[s]:
                batch.append(per[s].pop(0))
        got, held, done, more = release.fold(batch, seen, held, done, 3)
        out += got
        dropped += more
    assert [r[0] for r in out] == sorted(r[0] for r in out) and dropped == 0
    assert out == sorted(rows)[: len(out)] and len(out) >= 85
    assert release.fold([(5, 0, "late")], seen, held, done, 3)[3] == 1


def test_stream_in_order(spark, tmp_path):
    rows = [(t * 10 + s, s, f"{s}-{t}") for s in range(3) for t in range(20)]
    for i in range(4):
        spark.createDataFrame(rows[i::4], "commit_ts long, source_id long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("commit_ts long, source_id long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = release.ordered(stream, 3).writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["commit_ts"] for r in spark.table("released").collect()]
    assert len(got) == len(set(got)) and len(got) > 0
    # what was released is what lies at or below the least of the sources' last timestamps, but for rows that came too late
    assert max(got) <= min(max(r[0] for r in rows if r[1] == s) for s in range(3))


@pytest.mark.parametrize("backend", ["file", "table"])
def test_checkpoint(spark, tmp_path, backend):
    path = str(tmp_path / "point")
    c = checkpoint.make(backend, spark, path)
    assert c.success(5000 << 18, 3) and not c.success(6000 << 18, 4) and c.success(6001 << 18, 2, is_ddl=True)
    again = checkpoint.make(backend, spark, path)
    assert again.point.commit_ts == 6001 << 18 and again.point.schema_version == 3 and not again.point.consistent
    again.close(7000 << 18, clean=True)
    assert checkpoint.make(backend, spark, path).point.consistent
    assert checkpoint.synced(1000, 600) and not checkpoint.synced(1000, 900)


def test_sinks_are_repeatable(spark, tmp_path):
    batch = spark.createDataFrame([(1, "I", 10, 1), (2, "I", 20, 2), (1, "U", 11, 3)], "k long, op string, v long, n long")
    more = spark.createDataFrame([(2, "D", 20, 4), (3, "I", 30, 5)], "k long, op string, v long, n long")
    sink = sinks.make("mysql", path=str(tmp_path / "t"), keys=["k"], columns=["k", "v"], order=["n"])
    sink.sync(batch, 0)
    sink.sync(more, 1)
    sink.sync(more, 1)
    assert sorted(map(tuple, sink.read(spark).collect())) == [(1, 11), (3, 30)] and sink.successes == [0, 1, 1]
    files = sinks.make("pb", path=str(tmp_path / "f"))
    log = batch.select(F.col("n").alias("commit_ts"), F.col("op").cast("binary").alias("payload"))
    files.sync(log, 7)
    files.sync(log, 7)
    from chronofold.sources import logdir

    assert logdir.read(spark, str(tmp_path / "f" / "batch=000000000007")).count() == 3


def test_stream_into_table(spark, tmp_path):
    batch = spark.createDataFrame([(1, "I", 10, 1), (1, "U", 12, 2)], "k long, op string, v long, n long")
    batch.write.parquet(str(tmp_path / "in"))
    sink = sinks.make("memory")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    sinks.run(stream, sink, str(tmp_path / "cp")).awaitTermination(60)
    assert sum(map(len, sink.batches.values())) == 2


def test_checkpoint_survives_an_end_at_any_step(spark, tmp_path):
    import json
    import os
    from dataclasses import asdict

    from chronofold.streaming import checkpoint

    path = f"file://{tmp_path}/c/point.json"
    checkpoint.FileCheckpoint(spark, path).save(checkpoint.Point(commit_ts=5, schema_version=2))
    local = str(tmp_path / "c" / "point.json")
    with open(local + ".tmp", "w") as f:  # ended while the new point was being written
        f.write('{"commit_')
    assert checkpoint.FileCheckpoint(spark, path).point.commit_ts == 5
    with open(local + ".tmp", "w") as f:  # ended between the two steps
        json.dump(asdict(checkpoint.Point(commit_ts=9, schema_version=3)), f)
    os.remove(local)
    for crc in (tmp_path / "c").glob(".*.crc"):
        crc.unlink()
    again = checkpoint.FileCheckpoint(spark, path)
    assert again.point.commit_ts == 9 and os.path.exists(local)
    again.save(checkpoint.Point(commit_ts=11))
    assert checkpoint.FileCheckpoint(spark, path).point == checkpoint.Point(commit_ts=11, schema_version=3)


def test_table_sink_rewrites_only_touched_buckets(spark, tmp_path):
    """Random batches, some given twice, against a dictionary; old versions go."""
    rng, state, n = random.Random(4), {}, 0
    sink = sinks.make("mysql", path=str(tmp_path / "t"), keys=["k"], columns=["k", "v"], order=["n"], buckets=8)
    for b in range(6):
        rows = []
        for _ in range(12 if b != 3 else 0):
            n, k, op = n + 1, rng.randrange(15), rng.choice("IUD")
            rows.append((k, op, n, n))
            state.pop(k, None) if op == "D" else state.update({k: n})
        batch = spark.createDataFrame(rows, "k long, op string, v long, n long")
        for _ in range(rng.choice([1, 2])):
            sink.sync(batch, b)
        assert {r["k"]: r["v"] for r in sink.read(spark).collect()} == state
    one = spark.createDataFrame([(3, "U", 777, 999)], "k long, op string, v long, n long")
    sink.sync(one, 6)
    assert len(list((tmp_path / "t" / "version=000000000006").glob("bucket=*"))) == 1  # only the bucket of that key
    assert len(list((tmp_path / "t").glob("manifest=*"))) <= 2
    assert {r["k"]: r["v"] for r in sink.read(spark).collect()} == state | {3: 777}


def test_sink_contract(spark):
    batch = spark.range(3)
    sink = sinks.make("memory")
    sink.sync(batch, 0)
    sink.write = lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        sink.sync(batch, 1)
    assert sink.successes == [0] and isinstance(sink.error, ZeroDivisionError)
    with pytest.raises(RuntimeError):  # nothing more after an error
        sink.sync(batch, 2)
    with pytest.raises(ZeroDivisionError):
        sink.close()
    clean = sinks.make("_intercept")
    clean.set_safe_mode(True)
    clean.close()
    with pytest.raises(RuntimeError):
        clean.sync(batch, 0)
    with pytest.raises(ValueError):
        sinks.make("ftp")


def test_the_other_dialect_takes_truncations_only(spark, tmp_path):
    schema = "commit_ts long, ddl_query string, op string, k long, v long"
    sink = sinks.make("oracle", path=str(tmp_path / "t"), keys=["k"], columns=["k", "v"], order=["commit_ts"], buckets=4)
    sink.sync(spark.createDataFrame([(1, None, "I", 1, 1), (2, None, "I", 2, 2)], schema), 0)
    sink.sync(spark.createDataFrame([(3, None, "I", 3, 3), (4, "truncate table t", None, None, None), (5, None, "I", 4, 4)], schema), 1)
    assert sorted(map(tuple, sink.read(spark).collect())) == [(4, 4)]
    with pytest.raises(sinks.UnsupportedStatement, match="skip commit ts 9"):
        sink.sync(spark.createDataFrame([(9, "drop table t", None, None, None)], schema), 2)
    assert sink.successes == [0, 1]


def test_statements_for_targets(spark):
    rows = [("shop", "carts", "create table carts (id int) placement policy = p1"), ("shop", "", "create database shop"), ("a`b", "t", "truncate table t"), ("", "t", "drop table t"), ("shop", "carts", " placement policy p2")]
    df = spark.createDataFrame(rows, "db string, tbl string, sql string")
    got = [r["s"] for r in df.select(sinks.mysql_statements(F.col("db"), F.col("sql")).alias("s")).collect()]
    assert got == [["use `shop`;", "create table carts (id int)"], ["create database shop"], ["use `a``b`;", "truncate table t"], ["drop table t"], []]
    got = [r["s"] for r in df.select(sinks.oracle_statements(F.col("db"), F.col("tbl"), F.col("sql")).alias("s")).collect()]
    assert got == [[], [], ["BEGIN a`b.do_truncate('a`b.t','');END;"], [], []]


def test_relay(spark, tmp_path):
    """A batch that was written but not applied comes back; applied ones are collected; safe mode holds meanwhile."""
    from chronofold.streaming import relay

    schema = "commit_ts long, k long, op string, v long"
    batches = [spark.createDataFrame([(b * 10 + i, i, "D" if (b, i) == (2, 1) else "I", b) for i in range(3)], schema) for b in range(3)]
    sink = sinks.make("mysql", path=str(tmp_path / "t"), keys=["k"], columns=["k", "v"], order=["commit_ts"], buckets=2)
    log = relay.Relay(str(tmp_path / "r"), batches[0].schema)
    assert log.scan(spark).count() == 0
    log.sync(batches[0], 0, sink)
    log.sync(batches[1], 1, sink)
    assert log._batches() == [1]
    log.record(batches[2], 2)
    log.record(batches[2], 2)
    assert log.scan(spark, 10).count() == 5
    modes, inner = [], sink.write
    sink.write = lambda *a: (modes.append(sink.safe_mode), inner(*a))
    log.recover(spark, sink, checkpoint_ts=10, batch_id=2)  # some of batch 1 again, and batch 2
    assert modes == [True] and not sink.safe_mode and log._batches() == []
    assert {r["k"]: r["v"] for r in sink.read(spark).collect()} == {0: 2, 2: 2}
