"""Decontamination against all windows, the block tables' guarantee, and edge cases."""

import random
from collections import Counter

import numpy as np
from chronofold.llm import common, decontaminate

DOCS = "doc_id long, text string, matches string, item_id int"
ITEMS = "item_id long, text string, more int"


def words(text):
    return (text or "").encode().lower().split()


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items):
    """(doc, item) -> the best similarity of a window of the item's words."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            own = words(x)
            if not own or not w:
                continue
            n = min(len(own), len(w))
            for a in range(len(w) - n + 1):
                here, there = shingles(w[a : a + n]), shingles(own)
                both, either = sum((here & there).values()), sum((here | there).values())
                if 100 * both >= 75 * either:
                    out[d, i] = max(out.get((d, i), 0), both / either)
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([2, 4, 5, 6, 9, 14, 30, 45])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, " ".join(["same"] * 12)), (103, items[5][1])]
    docs = []
    for d in range(60):
        own = rng.choices(pool, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            x = [w.decode().upper() for w in x]
            for _ in range(rng.choice([0, 0, 1, 2])):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(pool)
            at = rng.randrange(len(own) + 1)
            own[at:at] = x
        docs.append((d, " ".join(own)))
    return docs + [(900, None), (901, ""), (902, " ".join(["same"] * 40))], items


def test_same_as_all_windows(spark):
    for seed in (1, 2, 3):
        docs, items = corpus(seed)
        df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(3)
        bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
        want = brute(docs, items)
        assert set(got) == set(want) and len(want) > 20
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
        clean = decontaminate.decontaminated(df, bench)
        assert clean.columns == df.columns
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_more_passes_find_the_same(spark, monkeypatch):
    docs, items = corpus(7)
    df, bench = spark.createDataFrame([(d, t, "", 0) for d, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    one = {tuple(r) for r in decontaminate.contaminated(df, bench).collect()}
    monkeypatch.setattr(decontaminate._passes, "__defaults__", (6, 300))
    assert {tuple(r) for r in decontaminate.contaminated(df, bench).collect()} == one


def _random_prints(n, seed):
    rng = np.random.default_rng(seed)
    return decontaminate.fingerprints(decontaminate.votes(rng.integers(0, 1 << 63, n * 26, dtype=np.uint64)).reshape(n, 26, -1).sum(1))


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    own = _random_prints(3000, 5)
    prints = own.copy()
    for k in range(3000):
        for b in rng.choice(128, rng.integers(0, 60), replace=False):
            prints[k, b // 16] ^= np.uint16(1 << (b % 16))
    distance = decontaminate._POPCOUNT[prints ^ own].sum(1)
    assert decontaminate.close(prints, own).tolist() == np.flatnonzero(distance <= decontaminate.RADIUS).tolist()
    assert decontaminate.BLOCKS * (decontaminate.NEAR + 1) > decontaminate.RADIUS


def test_blocks_let_few_random_pairs_through():
    a, b = _random_prints(20_000, 8), _random_prints(20_000, 9)
    near = (decontaminate._POPCOUNT[a ^ b] <= decontaminate.NEAR).any(1)
    assert near.mean() < 0.3
    assert len(decontaminate.close(a, b)) < 20  # 39 of 128 bits by chance


def test_fingerprints_at_the_threshold_lie_within_the_radius():
    rng = np.random.default_rng(6)
    misses = 0
    for _ in range(4000):
        x = rng.integers(0, 1 << 63, 46, dtype=np.uint64)
        a, b = x[:40], x[6:]  # 34 of 46 shared: just under the bound
        d = decontaminate._POPCOUNT[decontaminate.fingerprints(decontaminate.votes(a).sum(0, keepdims=True)) ^ decontaminate.fingerprints(decontaminate.votes(b).sum(0, keepdims=True))].sum()
        misses += d > decontaminate.RADIUS
    assert misses <= 2


def test_pairs_come_in_slices(monkeypatch):
    docs, items = corpus(4)
    rows = [(i, (x or "").encode()) for i, x in items]
    one = [decontaminate.Items(rows).matches(t.encode() if t else None) for _, t in docs]
    monkeypatch.setattr(decontaminate, "PAIRS", 3)
    assert [decontaminate.Items(rows).matches(t.encode() if t else None) for _, t in docs] == one


def test_many_items_of_one_size_and_shared_text():
    shared = " ".join(f"s{k}" for k in range(12))
    items = [(i, f"{shared} {' '.join(f'i{i}w{k}' for k in range(18))}".encode()) for i in range(2000)]
    text = " ".join([*(items[i][1].decode() for i in (3, 700)), *[f"f{k}" for k in range(200)], shared]).encode()
    assert [m[0] for m in decontaminate.Items(items).matches(text)] == [3, 700]


def test_edges(spark, monkeypatch):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(None, "a b c d e f g h", "", 0), (1, "x", "", 0), (1, "x", "", 0)], DOCS)
    items = spark.createDataFrame([(None, "a b c d e f g h", 0), (2, "x", 0)], ITEMS)
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.decontaminated(docs, no_items).count() == 3
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in decontaminate.contaminated(docs, items).collect()) == [(0, 0), (1, 2), (1, 2)]
    # a long text is taken in stretches
    monkeypatch.setattr(decontaminate, "STRETCH", 50)
    rng = random.Random(3)
    item = " ".join(f"i{k}" for k in range(30))
    text = " ".join([item, *[f"f{rng.random()}" for _ in range(500)], item] * 20)
    found = decontaminate.Items([(7, item.encode())]).matches(text.encode())
    assert found == [(7, 0, 30, 1.0)]
    assert len(common.words_of(text.encode())) > 10_000
