"""Packing: ids as the tokenizer gives them, dominance and fit, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from chronofold.llm import packing

DOCS = "doc_id long, text string, sequence_id string, length double"


def test_fast_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.encoder()
    rng = random.Random(4)
    letters = "abc ABC 12 .,'s\n\t  éßñ½ӿ中　🙂​<|endoftext|>"
    texts = ["", " ", "\n\n  x", "it's <|endoftext|> here", "日本語 text", "x" * 3000] + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert fast(t.encode()).tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_bytes_that_are_not_utf8():
    """Both ways replace them alike."""
    fast, exact = packing.Encoder("byte_bpe_50k.json", packing.RANKS), packing.Encoder("byte_bpe_50k.json", None)
    for t in (b"a\x80b", b"\xc3", b"plain", b"\xff\xfe x"):
        assert fast(t).tolist() == exact(t).tolist()


def brute_bins(lengths, capacity):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_reduction_keeps_an_optimum():
    """What is fixed is part of some optimal packing: fixed bins and the best of the rest are the optimum."""
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = packing.reduce_dominated(count, capacity)
        rest = [x for x in range(capacity, 0, -1) for _ in range(count[x])]
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert sum(n for _, n in fixed) + (brute_bins(rest, capacity) if rest else 0) == brute_bins(lengths, capacity)


def lower_bound(histogram, capacity):
    """The largest of the bounds that leave out items up to k."""
    best = 0
    for k in range(capacity // 2 + 1):
        one = sum(n for x, n in histogram.items() if x > capacity - k)
        two = [(x, n) for x, n in histogram.items() if capacity - k >= x > capacity // 2]
        small = sum(x * n for x, n in histogram.items() if capacity // 2 >= x >= k)
        room = sum((capacity - x) * n for x, n in two)
        best = max(best, one + sum(n for _, n in two) + max(0, -(-(small - room) // capacity)))
    return best


def test_plan_places_every_item():
    rng = np.random.default_rng(2)
    histogram = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 2049, 300)}
    p = packing.plan(histogram)
    assert sum(p["n"][p["length"] == x].sum() for x in histogram) == sum(histogram.values())
    assert p["sequences"] <= 1.02 * lower_bound(histogram, 2048) + 2


def check(rows, docs, capacity):
    encode = packing.encoder()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs:
        ids = np.append(encode((text or "").encode()), np.uint32(0)).astype("<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        assert len(pieces) == 1 if len(ids) <= capacity else all(p["length"] == capacity for p in pieces[1:])
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for rows_in in by_sequence.values():
        at = 0
        for r in sorted(rows_in, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    docs = [(i, None if i == 3 else "" if i == 4 else " ".join(rng.choices(["the", "thing", "ß", "x1"], k=rng.randrange(1, 90)))) for i in range(120)]
    docs += [(500, "word " * 5000), (501, "z" * 20_000)]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], DOCS).repartition(3)
    packed = packing.pack(df, capacity, keep_ids=True)
    rows = packed.collect()
    check(rows, docs, capacity)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in rows) and max(len(r["ids"]) for r in whole) <= capacity


def test_edges(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b", "", 0.0), (1, "a", "", 0.0), (1, "a", "", 0.0)], DOCS)).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
