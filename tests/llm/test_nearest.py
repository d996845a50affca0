"""Nearest neighbours against all products, with ties, odd vectors and several blocks."""

import numpy as np
import pytest
from chronofold.llm import nearest
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<float>, score int, size int"


def brute(rows, k):
    best = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in good:
        if q % 20:
            continue
        for i, y in good:
            if i != q and len(x) == len(y):
                s = float((x * y).sum())
                best.setdefault(q, {})
                best[q][i] = max(best[q].get(i, -np.inf), s)
    return {q: sorted(c.items(), key=lambda t: (-t[1], t[0]))[:k] for q, c in best.items()}


@pytest.mark.parametrize("blocks", [(1024, 16_384), (3, 17), (3, 17, 0)])
def test_same_as_all_products(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties by id
    rows += [(20, rows[7][1]), (21, rows[21][1]), (None, rows[3][1]), (400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (500, []), (520, [1.0, 2.0, 3.0]), (521, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], ROWS).repartition(4)
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, *blocks).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert np.allclose([s for *_, s in found], [s for _, s in want[q]], rtol=1e-12)
        # ties may only differ where products differ in the last place
        assert [v for _, v, _ in found] == [v for v, _ in want[q]] or np.allclose([s for *_, s in found], [s for _, s in want[q]], rtol=1e-15)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)) * np.exp(rng.normal(size=(300, 1)) * 3)
    side = nearest.quantised(x) | {"id": np.arange(300)}
    assert side["q"].dtype == side["rest"].dtype == np.int8
    products = x @ x.T
    np.fill_diagonal(products, -np.inf)
    found = [set() for _ in range(300)]
    for q, v, low, high in nearest.tile(side, side, 5):
        assert (low <= products[q, v]).all() and (products[q, v] <= high).all()
        for a, b in zip(q.tolist(), v.tolist(), strict=True):
            found[a].add(b)
    for q in range(300):
        assert set(np.argsort(products[q])[::-1][:5].tolist()) <= found[q]
    assert sum(map(len, found)) < 300 * 6  # few are left to compute anew


def test_a_repeated_id_does_not_raise_the_floor():
    """Vectors of one id count once for the k-th, so they crowd nothing out."""
    x = np.array([[1.0, 0.0]] + [[5.0, 0.1 * i] for i in range(10)] + [[3.0, 0.0], [2.0, 0.0], [1.0, 0.0]])
    side = nearest.quantised(x) | {"id": np.array([0] + [1] * 10 + [2, 3, 4])}
    queries = {c: v[:1] for c, v in side.items()}
    kept = {side["id"][j] for _, v, _, _ in nearest.tile(queries, side, 3) for j in v.tolist()}
    assert kept == {1, 2, 3}


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rng = np.random.default_rng(4)
    hot = np.float32(rng.normal(size=8) * 3).tolist()
    rows = [(i, hot if i % 3 else np.float32(rng.normal(size=8)).tolist()) for i in range(600)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], ROWS)
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, 8, 100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = brute(rows, 20)
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}


def test_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert nearest.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 0, 0), (0, [1.0, 2.0], 0, 0)], ROWS)
    assert nearest.nearest(alone, F.col("vec_id") % 20 == 0).count() == 0
