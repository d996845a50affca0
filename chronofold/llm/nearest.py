"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Vectors are quantised to int8 where they are read, and what rounding lost once more,
each with a scale and the norm of what is still lost; only these are dealt into
blocks, a quarter of the bytes of doubles. A task takes one tile: a block of queries
against a block of candidates. The tile's int8 products, with the error bounds, give
a range for every inner product; only pairs whose upper end reaches the k-th largest
lower end of their query survive, and the second int8 vectors narrow their ranges.
The tiles' survivors meet in heaps, which keep the k-th largest lower end over all
tiles, and the pairs that reach it are computed anew in double precision: their
vectors are fetched once by a join. The result is exact: the bounds never drop a
true neighbour.

Blocks follow the table's size, so that each candidate goes to one tile for each
QUERY_BLOCK queries and each query to one for each CANDIDATE_BLOCK candidates.

Defined results: vectors that are null, zero, or hold a null or a component that
is not finite take no part; vectors of another length than the query's are not
its candidates; a vec_id that repeats is one candidate, with its largest product,
and one query, with the best of its rows' products; a null vec_id takes no part;
of equal products the smaller vec_id comes first; a very long vector is one row of
its tile; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.llm import common

K = 20
QUERIES_EVERY = 20
#: Rows in a block of queries and of candidates; a vector takes two bytes a component there.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 65_536
#: Products of a tile held at once.
TILE = 2_000_000
#: Vectors of at most so many bytes, all survivors or all queries, may be broadcast.
BROADCAST_BYTES = 32 << 20

_QUANTISED = "vec_id long, own long, size int, q binary, rest binary, scale double, lost double, left double, norm double"
#: Rows whose repeats a task recognises.
REMEMBERED = 500_000


def quantised(x: np.ndarray) -> dict[str, np.ndarray]:
    """int8 values (q) and their scales, int8 values of the rest at 1/254 of the scale, norms of what is lost (without the rest) and left (with it), norms."""
    scale = np.maximum(np.abs(x).max(1) / 127, 1e-300)
    q = np.rint(x / scale[:, None])
    lost = x - q * scale[:, None]
    rest = np.clip(np.rint(lost / scale[:, None] * 254), -127, 127)
    left = lost - rest * scale[:, None] / 254
    return {"q": q.astype(np.int8), "rest": rest.astype(np.int8), "scale": scale, "lost": np.linalg.norm(lost, axis=1), "left": np.linalg.norm(left, axis=1), "norm": np.linalg.norm(x, axis=1)}


def _restored(v: dict[str, np.ndarray]) -> np.ndarray:
    return (v["q"] + v["rest"] / 254) * v["scale"][:, None]


def _sound(x: list | None) -> bool:
    return bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)


def tile(queries: dict[str, np.ndarray], candidates: dict[str, np.ndarray], k: int):
    """(query's place, candidate's place, low, high) of the pairs whose range reaches the k-th largest low of their query.

    Both sides hold id and what quantised() gives. Of candidates with one id only the best counts for the k-th.
    """
    by = np.argsort(candidates["id"], kind="stable")
    v = {c: x[by] for c, x in candidates.items()}
    first = np.flatnonzero(np.concatenate([[True], v["id"][1:] != v["id"][:-1]]))
    size = v["q"].shape[1]
    kind = np.float32 if size * 127 * 127 < 1 << 24 else np.float64  # products are exact sums of integers
    right = v["q"].astype(kind)
    v_norm, v_fine = v["norm"] + v["lost"], _restored(v)
    rows = max(1, TILE // max(len(by), 1))
    for at in range(0, len(queries["id"]), rows):
        q = {c: x[at : at + rows] for c, x in queries.items()}
        near = (q["q"].astype(kind) @ right.T).astype(float) * q["scale"][:, None] * v["scale"][None]
        # x.y - x'.y' = (x - x').y' + x.(y - y'), so the norms bound it; a little more for the arithmetic
        slack = q["lost"][:, None] * v_norm[None] + q["norm"][:, None] * v["lost"][None]
        slack += 1e-9 * (np.abs(near) + q["norm"][:, None] * v_norm[None])
        own = q["id"][:, None] == v["id"][None]
        low, high = np.where(own, -np.inf, near - slack), near + slack
        best = np.maximum.reduceat(low, first, axis=1) if len(first) < len(by) else low
        floor = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        q_fine, fine = _restored(q), np.zeros(len(i))
        for c in range(size):
            fine += q_fine[i, c] * v_fine[j, c]
        slack = q["left"][i] * (v["norm"] + v["left"])[j] + q["norm"][i] * v["left"][j] + 1e-12 * q["norm"][i] * v_norm[j]
        low, high = fine - slack, fine + slack
        order = np.lexsort((-low, v["id"][j], i))  # the best of each id, then the k-th of those
        first_of = order[np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (i, v["id"][j])], axis=0)])] if len(i) else order
        order = first_of[np.lexsort((-low[first_of], i[first_of]))]
        begins = np.searchsorted(i[order], np.arange(len(q["id"]) + 1))
        floor = np.full(len(q["id"]), -np.inf)
        enough = np.flatnonzero(np.diff(begins) >= k)
        floor[enough] = low[order[begins[enough] + k - 1]]
        keep = high >= floor[i]
        yield i[keep] + at, by[j[keep]], low[keep], high[keep]


def _side(t: pa.Table) -> dict[str, np.ndarray]:
    """A block, without the rows that repeat."""
    out = {"id": t.column("vec_id").to_numpy(), "own": t.column("own").to_numpy()}
    out |= {c: t.column(c).to_numpy() for c in ("scale", "lost", "left", "norm")}
    out |= {c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.int8).reshape(len(out["id"]), -1) for c in ("q", "rest")}
    keep = np.unique(np.stack([out["id"], out["own"]], 1), axis=0, return_index=True)[1]
    return {c: x[keep] for c, x in out.items()}


def _least_ids(v: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Of equal vectors the k + 1 smallest ids: no other of them is among a query's k nearest."""
    keys = ("own", "scale", "norm")
    by = np.lexsort((v["id"], *(v[c] for c in keys)))
    new = np.concatenate([[True], np.any([v[c][by][1:] != v[c][by][:-1] for c in keys], axis=0)]) if len(by) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    nth = np.arange(len(by)) - starts[np.cumsum(new) - 1]
    return {c: x[by[nth <= k]] for c, x in v.items()}


def quantised_rows(vectors: DataFrame) -> DataFrame:
    """The sound vectors as int8, with a hash of the vector itself. A row that repeats comes once for some REMEMBERED rows of a task."""
    common.arrow_batches(vectors.sparkSession)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            by_size = defaultdict(list)
            for i, h, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is not None and (i, h) not in seen and _sound(v):
                    seen.add((i, h))
                    by_size[len(v)].append((i, h, v))
            if len(seen) > REMEMBERED:
                seen.clear()
            for size, rows in sorted(by_size.items()):
                v = quantised(np.array([r[2] for r in rows], float))
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([size] * len(rows), pa.int32())]
                columns += [pa.array([x.tobytes() for x in v[c]], pa.binary()) for c in ("q", "rest")] + [pa.array(v[c]) for c in ("scale", "lost", "left", "norm")]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _QUANTISED.split(", ")])

    return vectors.select("vec_id", _hash(), "embedding").mapInArrow(run, _QUANTISED)


def _hash():
    return F.xxhash64("embedding").alias("own")


def nearest(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for each query among ``vectors`` (vec_id, embedding); ``is_query`` is a condition on vec_id."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = common.settle(quantised_rows(vectors), "int8").withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, m, bytes_each = rows.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max("size"), F.lit(0)) * 8).first()
    of_queries, of_candidates = max(1, -(-m // query_block)), max(1, -(-n // candidate_block))
    place = F.xxhash64("vec_id", "own")
    candidates = rows.drop("is_query").withColumn("c", F.pmod(place, F.lit(of_candidates))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_queries - 1).cast("long"))))
    queries = rows.filter("is_query").drop("is_query").withColumn("b", F.pmod(place, F.lit(of_queries))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_candidates - 1).cast("long"))))
    pair = "query_id long, query_own long, vec_id long, own long, low double, high double"
    names = [x.split()[0] for x in pair.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),) * 2]
        if left.num_rows and right.num_rows:
            q, v = _side(left), _least_ids(_side(right), k)
            parts += [(q["id"][i], q["own"][i], v["id"][j], v["own"][j], low, high) for i, j, low, high in tile(q, v, k)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    key = ["size", "b", "c"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(run, pair)

    def survivors(batches):
        """The pairs that reach the k-th largest low of their query; a query's pairs come together."""
        now, held, lows, heap, full = None, [], {}, [], 100 * k

        def pruned():
            """What reaches the floor, and of equal vectors the k smallest ids."""
            floor = heap[0][0] if len(heap) == k else -np.inf
            rows, seen = [], Counter()
            for r in sorted(held, key=lambda r: r[2]):
                if r[5] >= floor and seen[r[1], r[3], r[4]] < k:
                    seen[r[1], r[3], r[4]] += 1
                    rows.append(r)
            return rows

        def out():
            rows = pruned()
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000], strict=True)], names=names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != now:
                    yield from out()
                    now, held, lows, heap, full = r[0], [], {}, [], 100 * k
                vec, low = r[2], r[4]
                if vec not in lows:
                    if len(heap) < k:
                        heapq.heappush(heap, (low, vec))
                        lows[vec] = low
                    elif low > heap[0][0]:
                        del lows[heapq.heapreplace(heap, (low, vec))[1]]
                        lows[vec] = low
                elif low > lows[vec]:
                    heap[heap.index((lows[vec], vec))] = (low, vec)
                    heapq.heapify(heap)
                    lows[vec] = low
                if len(heap) < k or r[5] >= heap[0][0]:
                    held.append(r)
                    if len(held) >= full:
                        held = pruned()
                        full = 2 * len(held) + 100 * k
        yield from out()

    pairs = common.settle(found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(survivors, pair).drop("low", "high"), "pairs")
    # the survivors' vectors, then the queries'; a side is broadcast only where its counted size allows
    ids = pairs.select("vec_id", "own").distinct()
    ids = ids if pairs.count() * 16 > broadcast_bytes else F.broadcast(ids)
    fetched = vectors.withColumn("own", _hash()).join(ids, ["vec_id", "own"], "left_semi").dropDuplicates(["vec_id", "own"])
    asked = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_own"), F.col("embedding").alias("y")).dropDuplicates(["query_id", "query_own"])
    asked = asked if m * bytes_each > broadcast_bytes else F.broadcast(asked)
    scored = pairs.join(fetched.withColumnRenamed("embedding", "x"), ["vec_id", "own"]).join(asked, ["query_id", "query_own"])
    # summed component by component, so that the last digit is the same everywhere
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    best = scored.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # a query has little more than k pairs by now
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_int8_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERIES_EVERY == 0)
