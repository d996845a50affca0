"""Connected components of links, distributed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import common


def forest(batches):
    """Union-find over one task's links: a link from each of its nodes to the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): each linked node with the smallest node of its component.

    Each task first contracts its own links by union-find. Then large-star and
    small-star steps alternate until nothing changes; each halves the depth, and
    both are joins and minima, so a node with very many links is split by
    partial aggregation and by the skew join. ``rounds`` allow paths of 2^30 nodes and
    more; beyond that it is an error.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = common.settle(edges.mapInArrow(forest, "a long, b long"), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, common.settle(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        common.unsettle(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = now
    raise RuntimeError("the components did not settle")
