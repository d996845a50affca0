"""Near duplicates against all pairs, signatures, components, and edge cases."""

import random
from itertools import combinations

import numpy as np
from chronofold.llm import common, graph, neardup

DOCS = "doc_id long, text string, rep string, kept int"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs):
    """All pairs: doc_id -> smallest doc_id reachable."""
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def corpus(seed, groups=12, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(groups):
        base = rng.choices(words, k=rng.randrange(3, 150))
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)] + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "One two three four")]


def test_same_components_as_all_pairs(spark):
    for seed in (1, 2, 3):
        docs = corpus(seed)
        got = neardup.group(spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], DOCS).repartition(3)).collect()
        want = components(docs)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        texts = dict(docs)
        for r in got:
            assert r["n_shingles"] == len(shingles(texts[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"])


def test_a_large_group_of_edited_copies(spark):
    """Copies of one text whose similarity to each other lies on both sides of the bound."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(140)]
    docs = []
    for i in range(250):
        own = list(base)
        for _ in range(rng.randrange(1, 8)):
            own[rng.randrange(140)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    got = neardup.group(spark.createDataFrame([(i, t, "", 0) for i, t in docs], DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(docs)


def test_a_bucket_of_unlinked_members(spark):
    """20,000 members in one bucket, none like another but for a few pairs: all are compared, a pair of blocks at a time."""
    from pyspark.sql import functions as F

    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.col("id").alias("label"), F.lit(100).alias("n"), F.when(F.col("id") % 1000 == 0, 90).otherwise(40).alias("shared"), F.lit(100).alias("room"))
    enough = F.expr("175 * least(shared_a, shared_b) >= 75 * (n_a + n_b)")
    got = sorted(map(tuple, neardup._across(rows, ["key"], 75, enough).collect()))
    assert got == [(a, b) for a in range(0, n, 1000) for b in range(0, a, 1000)]


def test_large_keys_meet_their_facts(spark):
    rows = spark.range(9000).selectExpr("if(id < 5000, 0, id % 1000) as key", "id as rep").repartition(4)
    facts = rows.groupBy("key").count().withColumnRenamed("count", "size").filter("key < 700")
    got = {r["key"]: (r["n"], r["size"]) for r in neardup._with_facts(rows, facts).groupBy("key").agg({"rep": "count", "size": "max"}).toDF("key", "n", "size").collect()}
    want = {r["key"]: (r["size"], r["size"]) for r in facts.collect()}
    assert got == want and max(x for x, _ in got.values()) > neardup.BLOCK


def test_blocks_compare_each_pair_once(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60).select((F.col("id") % 2).alias("key"), F.col("id").alias("rep"), F.floor(F.col("id") / 4).alias("label"), F.lit(10).alias("n"), F.lit(1).alias("shared"), F.lit(1).alias("room"))
    for block in (3, 2000):
        got = [tuple(r) for r in neardup._across(rows, ["key"], 75, F.lit(True), block).collect()]
        assert sorted(got) == [(a, b) for a in range(60) for b in range(60) if a % 2 == b % 2 and a // 4 > b // 4]


def test_edges(spark):
    assert neardup.group(spark.createDataFrame([], DOCS)).count() == 0
    long_text = " ".join(f"v{i}" for i in range(20_000))
    rows = [(None, "a b c d e f", "", 0), (5, "a b c d e f", "", 0), (5, "a b c d e f", "", 0), (6, "A b c d e f", "", 0), (5, long_text, "", 0), (7, long_text, "", 0)]
    got = neardup.group(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (5, 5, True), (6, 5, False), (7, 5, False)}
    left = neardup.deduplicated(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "rep", "kept"] and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 5, 5, 5]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (5, 40, 600):
        found = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[: int(1.5 * n)]), np.unique(x[int(0.5 * n) :])
            s = neardup.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)]), 128)
            found.append(((s[0] == s[1]).mean(), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        got, want = np.mean(found, axis=0)
        assert abs(got - want) < 0.03


def test_signatures_do_not_depend_on_chunks(monkeypatch):
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64))
    whole = neardup.superminhash(x, np.array([len(x)]), 128)
    monkeypatch.setattr(neardup, "CHUNK", 333)
    assert (neardup.superminhash(x, np.array([len(x)]), 128) == whole).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1200)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["node"]: r["label"] for r in graph.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[j] == 1000 for j in range(1001, 1200)) and 5000 not in got


def test_shingle_hashes_tell_lengths_apart():
    w = common.hashed([b"a", b"b", b"c"])
    assert len(common.shingle_hashes(w, 5)) == 1 and len(common.shingle_hashes(w, 2)) == 2 and len(common.shingle_hashes(w[:0], 5)) == 0
    assert common.shingle_hashes(w[:2], 5)[0] != common.shingle_hashes(w, 5)[0]
