"""Pairing where transactions share a start_ts, as orders do whose keys go beyond the logical part of a timestamp."""

import duckdb
import pytest

from chronofold import registry
from chronofold.functions import tso
from chronofold.operators import pairing

#: Keys so far apart have one start_ts if their dates are equal.
SAME_START = 5 * tso.PER_MS


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Orders: three for most start_ts, a rolled-back one and a committed one for one of them, whole rows twice, null keys, dates and states."""
    d, c = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    c.execute(f"""create table o as select k + i * {SAME_START} as o_orderkey, k as o_custkey, case when (k + i) % 3 = 0 then 'O' else 'F' end as o_orderstatus,
      100.0::double * i + k as o_totalprice, timestamp '1997-12-01' + to_days(cast(k as int)) as o_orderdate from range(60) t(k), range(3) u(i)""")
    c.execute(f"insert into o values (1003, 1, 'F', 1.5, '1997-03-01 00:00:00.001'), (1003 + {tso.PER_MS}, 1, 'F', 2.5, '1997-03-01')")
    c.execute("insert into o select * from o where o_custkey % 7 = 2")
    c.execute("insert into o select * replace (null as o_orderdate) from o where o_custkey % 11 = 4")
    c.execute("insert into o values (null, 1, 'F', 3.5, '1997-03-01'), (9001, 1, null, 4.5, '1999-01-01'), (9002, 1, 'F', null, '1997-04-01')")
    c.execute(f"copy o to '{d}/orders.parquet' (format parquet)")
    return d


def compared(spark, name, d):
    """The query's rows and those of its SQL, both in one order."""
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{d}/orders.parquet'")
    want = c.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    return tuple(sorted(map(tuple, rows), key=repr) for rows in (registry.QUERIES[name](spark, d).select(*columns).collect(), want.fetchall()))


def test_pairs_of_shared_starts(spark, odd):
    got, want = compared(spark, "j1_pair_commits", odd)
    assert got == want
    assert len(got) > len({r[0] for r in got})


def test_each_prewrite_meets_each_commit(spark):
    """A commit keeps its own columns; a heartbeat passes once, whatever starts where it is; null meets nothing."""
    rows = [("P", 5, None, 0, 1.0), ("P", 5, None, 1, None), ("C", 5, 8, 2, None), ("C", 5, 9, 3, None), ("C", 6, 9, 0, None), ("C", 5, 5, 4, None), ("P", None, None, 0, 2.0), ("C", None, 9, 0, None), ("R", 5, None, 0, None)]
    got = pairing.paired(spark.createDataFrame(rows, "tp string, start_ts long, commit_ts long, source_id long, body double"))
    assert sorted(map(tuple, got.select("start_ts", "commit_ts", "source_id", "body", "heartbeat").collect()), key=repr) == sorted(
        [(5, 5, 4, None, True), *((5, c, s, b, False) for c, s in ((8, 2), (9, 3)) for b in (1.0, None))], key=repr
    )


@pytest.mark.parametrize("change", ["o_orderdate", "o_orderdate - interval 60 year", "null::timestamp"])
def test_scan_of_shared_starts(spark, odd, tmp_path, change):
    """Before 1970 too, and without any commit."""
    duckdb.execute(f"copy (select * replace ({change} as o_orderdate) from '{odd}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    got, want = compared(spark, "s1_ordered_commit_scan", str(tmp_path))
    assert got == want
    assert bool(got) == ("null" not in change)


def test_scan_in_order(spark):
    """What lies after the bound only, one order for equal commit_ts."""
    rows = [("P", s, None, 0, float(s)) for s in range(1, 9)] + [("C", s, 20 - s // 2, s % 3, None) for s in range(1, 9)]
    log = spark.createDataFrame(rows, "tp string, start_ts long, commit_ts long, source_id long, body double").repartition(5)
    got = [(r["commit_ts"], r["start_ts"], r["body"]) for r in pairing.committed_scan(log, 3, 19, 16).collect()]
    assert got == [(17, 6, 6.0), (17, 7, 7.0), (18, 4, 4.0), (18, 5, 5.0), (19, 2, 2.0), (19, 3, 3.0)]


def test_decisions_of_shared_starts(spark, odd, tmp_path):
    """One decision for each prewrite, by its own transaction's state; rows that repeat are decided each."""
    duckdb.execute(f"copy (select * replace (case when o_custkey % 2 = 0 then 'O' else o_orderstatus end as o_orderstatus) from '{odd}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    got, want = compared(spark, "j3_resolve_missing", str(tmp_path))
    assert got == want
    assert {r[1] for r in got} == {"commit", "drop", "wait"} and len(got) > len(set(got))


def test_several_answers_about_a_transaction(spark):
    waiting = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 7), (5, 8)], "txn long, start_ts long")
    answers = [(5, None, None, 0), (5, "rolled back", None, 0), (5, "committed", 9, 0), (6, None, None, 0), (6, None, None, 30), (7, None, None, 30), (7, "rolled back", None, None)]
    status = spark.createDataFrame(answers, "start_ts long, state string, commit_ts long, lock_ttl int")
    got = pairing.resolved(waiting, status, 700_000 << tso.LOGICAL_BITS)
    assert sorted(map(tuple, got.select("txn", "decision", "commit_ts").collect())) == [(1, "commit", 9), (2, "commit", 9), (3, "wait", None), (4, "drop", None), (5, "drop", None)]
