"""Scores against plain counting and a plain PPM, shards against one table, and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from chronofold.llm import common, ppm, scoring
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, score double, row int"


class PlainPpm:
    """The model, a dictionary at a time."""

    def __init__(self, streams, order):
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for s in streams:
            padded = b"\n" * order + s
            for i in range(order, len(padded)):
                self.counts[order][padded[i - order : i]][padded[i]] += 1
        for k in range(order - 1, -1, -1):  # a short context learns a symbol once for each longer context that has it
            for context, seen in self.counts[k + 1].items():
                for symbol in seen:
                    self.counts[k][context[1:]][symbol] += 1

    def log10(self, stream):
        total, padded = 0.0, b"\n" * self.order + stream
        for i in range(self.order, len(padded)):
            excluded, p = set(), 1.0
            for k in range(self.order, -1, -1):
                seen = {s: c for s, c in self.counts[k].get(padded[i - k : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values())
                if padded[i] in seen:
                    total += math.log10(p * (seen[padded[i]] - ppm.DISCOUNT) / whole)
                    break
                p *= ppm.DISCOUNT * len(seen) / whole
                excluded |= set(seen)
            else:
                total += math.log10(p / (256 - len(excluded)))
        return total


def test_trie_equals_plain_model():
    rng = random.Random(1)
    streams = [("".join(rng.choices("ab cé", k=rng.randrange(40))) + "\n").encode() for _ in range(30)]
    others = [("".join(rng.choices("abd cxé", k=rng.randrange(40))) + "\n").encode() for _ in range(10)]
    for order in (0, 1, 2, 4):
        codes, _ = ppm.gram_codes(streams, order)
        trie, plain = ppm.Trie(*ppm.summed(codes, np.ones(len(codes), np.int64)), order), PlainPpm(streams, order)
        for s in streams[:5] + others:
            got = trie.log10(ppm.gram_codes([s], order)[0]).sum()
            assert abs(got - plain.log10(s)) < 1e-9


def test_probabilities_sum_to_one():
    codes, _ = ppm.gram_codes([b"the cat sat on the mat\n", b"that\n"], 3)
    trie = ppm.Trie(*ppm.summed(codes, np.ones(len(codes), np.int64)), 3)
    for context in (b"the", b"hat", b"zzz", b"\n\n\n"):
        v = int.from_bytes(context, "big")
        assert abs((10 ** trie.log10(np.array([v << 8 | b for b in range(256)], np.uint64))).sum() - 1) < 1e-9


def corpus(n=80):
    rng = random.Random(2)
    pool = ["the", "of", "And"] * 5 + [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 60)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, " \t\n"), (903, "unseen" * 3), (None, "no id here")]


def expected(docs, order):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    lists = [(d, (t or "").encode().lower().split()) for d, t in docs]
    counts = Counter(w for d, ws in lists if not held[d] for w in [*ws, "END"])
    n, v = sum(counts.values()), len(counts)
    model = PlainPpm([b" ".join(ws) + b"\n" for d, ws in lists if not held[d]], order)
    out = {}
    for d, ws in lists:
        tokens = [*ws, "END"]
        out[d] = (held[d], len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), model.log10(b" ".join(ws) + b"\n"))
    return out


def test_same_as_plain_counting(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0.0, 1) for d, t in docs], DOCS).repartition(3)
    trains = ~common.in_fold("doc_id", 5, 1)
    for order in (4, 2):
        want = expected(docs, order)
        for options in ({}, {"block_bytes": 300, "buckets": 7, "salt_blocks": 2, "flush": 50, "chunk": 90}):
            model = scoring.Model(df, trains, order=order, **options)
            assert (model.salts > 2) == bool(options)
            got = scoring.score(model).collect()
            assert len(got) == len(docs)
            for r in got:
                w = want[r["doc_id"]]
                assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
                assert abs(r["base_score"] - w[4]) < 1e-6 and abs(r["score"] - w[5]) < 1e-6


def test_packing_integers():
    for values in ([], [0], [1, 255, 256], [2**64 - 1, 0, 3], list(range(1000))):
        x = np.array(values, np.uint64)
        assert (scoring.unpacked(scoring.packed(x), len(x)) == x).all()


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    trains = ~common.in_fold("doc_id", 5, 1)
    assert scoring.score(scoring.Model(empty, trains)).count() == 0
    df = spark.createDataFrame([(1, "a b", 0.0, 0), (1, "a b", 0.0, 0), (2, "x " * 50_000, 0.0, 0)], DOCS)
    got = scoring.score(scoring.Model(df, F.lit(False))).collect()  # nothing trains
    assert len(got) == 3 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    # without training every byte is as likely as another
    assert abs(min(r["score"] for r in got) + 100_000 * math.log10(256)) < 1e-3


def test_trained_by_one_text(spark):
    df = spark.createDataFrame([(2, "one two", 0.0, 0)] * 3, DOCS)
    rows = scoring.score(scoring.Model(df, F.lit(True))).collect()
    assert len(rows) == 3 and {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(3, 3, 9)}
