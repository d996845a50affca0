"""Language ID: the forward algorithm against all cuts, expectation-maximisation, held-out accuracy, edge cases."""

import math
import random
from collections import Counter

import numpy as np
from chronofold.llm import langid

DOCS = "doc_id long, text string, lang string, score double"


def all_cuts(word, table):
    if not word:
        return 1.0
    return sum(table[word[:k]] * all_cuts(word[k:], table) for k in range(1, len(word) + 1) if word[:k] in table)


def test_forward_sums_all_cuts():
    rng = random.Random(1)
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b"bc", b"cab", "é".encode(), b" ab"]
    lattice = langid.Lattice(vocabulary)
    p = np.array([[rng.random(), rng.random()] for _ in vocabulary]) / 100
    words = [b" " + bytes(rng.choices(b"abc", k=rng.randrange(9))) for _ in range(60)] + [" é".encode()]
    got = langid.word_logs(words, lattice, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            table = {v: p[i, k] for i, v in enumerate(vocabulary)}
            assert abs(row[k] - math.log(all_cuts(w, table))) < 1e-9


def test_long_words_are_summed_whole():
    """The sliding sums against sums in exact fractions, over pieces longer than a step."""
    from fractions import Fraction

    rng = random.Random(3)
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abab", b"ab" * 14, b" a", b"ba" * 20, b"c" * 30]
    lattice = langid.Lattice(vocabulary)
    p = np.array([[rng.random(), rng.random()] for _ in vocabulary]) / 1000
    words = [b" " + b"ab" * 60, b" " + b"c" * 95, b" " + bytes(rng.choices(b"abc", k=200)), b"ab" * 12]
    got = langid.word_logs(words, lattice, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            sums = [Fraction(1)]
            for end in range(1, len(w) + 1):
                sums.append(sum(sums[end - len(v)] * Fraction(p[i, k]) for i, v in enumerate(vocabulary) if w[:end].endswith(v)))
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert abs(row[k] - want) < 1e-9 * abs(want)


def test_fit_against_all_cuts():
    """One round of expectation-maximisation, cut by cut."""
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b" a"]
    lattice = langid.Lattice(vocabulary)
    counts = Counter({b" abc": 3, b" bab": 2, b" cabcab": 1, b" " + b"abc" * 3: 2, b" " + b"ab" * 13: 1})

    def cuts(word):
        return [[]] if not word else [[v, *rest] for v in {word[:k] for k in (1, 2, 3)} & set(vocabulary) for rest in cuts(word[len(v) :])]

    p = {v: 1 / len(vocabulary) for v in vocabulary}
    for _ in range(2):
        expected = Counter({v: langid.SMOOTHING for v in vocabulary})
        for word, n in counts.items():
            if len(word) <= langid.STEP:
                ways = [(c, math.prod(p[v] for v in c)) for c in cuts(word)]
                whole = sum(w for _, w in ways)
                for c, w in ways:
                    for v in c:
                        expected[v] += n * w / whole
            else:  # too many cuts to list: sums over prefixes and suffixes
                a, b = [1.0], [1.0]
                for end in range(1, len(word) + 1):
                    a.append(sum(a[end - len(v)] * p[v] for v in vocabulary if word[:end].endswith(v)))
                for k in range(1, len(word) + 1):
                    b.append(sum(b[k - len(v)] * p[v] for v in vocabulary if word[len(word) - k :].startswith(v)))
                for v in vocabulary:
                    for at in range(len(word) - len(v) + 1):
                        if word[at : at + len(v)] == v:
                            expected[v] += n * a[at] * p[v] * b[len(word) - at - len(v)] / a[-1]
        p = {v: x / sum(expected.values()) for v, x in expected.items()}
    got = langid.fit([counts], lattice, 2)[:, 0]
    assert np.allclose(got, [p[v] for v in vocabulary], rtol=1e-9)


def test_predictions_against_plain_sums(spark):
    """lang_pred and score of whole texts from a plain forward sum over the fitted pieces."""
    docs = corpus(60) + [(700, "KA lo\u00a0mi schung", "aa", 0.0), (701, "x1 " + "tulo" * 30, None, 0.0)]
    df = spark.createDataFrame(docs, DOCS)
    model = langid.Model(df.filter("doc_id % 3 <> 0"))
    vocabulary = langid.pieces()
    tables = [dict(zip(vocabulary, model.probability[:, k].tolist(), strict=True)) for k in range(len(model.languages))]
    longest = max(map(len, vocabulary))

    def log(word, table):
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[start] * table.get(word[start:end], 0.0) for start in range(max(0, end - longest), end)))
        return math.log(sums[-1])

    for r in langid.predict(df, model).collect():
        text = next(t for i, t, *_ in docs if i == r["doc_id"])
        logs = [sum(log(b" " + w, t) for w in text.encode().lower().split()) for t in tables]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert r["lang_pred"] == model.languages[best]
        assert abs(r["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-6


def test_equal_texts_are_not_all_in_or_all_out(spark):
    df = spark.createDataFrame([(i, "ka lo", "aa", 0.0) for i in range(2000)], DOCS)
    found = langid.sampled_words(df.select("doc_id", "text", "lang"), 200)
    assert 100 < found["aa"]["ka"] < 320


def test_many_languages(spark):
    df = spark.createDataFrame([(i, f"w{i} x", f"l{i:04}", 0.0) for i in range(600)], DOCS)
    model = langid.Model(df)
    assert len(model.languages) == 600
    assert langid.predict(df.filter("doc_id < 3"), model).count() == 3


def test_fit_raises_likelihood():
    rng = random.Random(2)
    counts = Counter({b" " + bytes(rng.choices(b"abcd", k=rng.randrange(1, 8))): rng.randrange(1, 9) for _ in range(300)})
    lattice = langid.Lattice([bytes([b]) for b in range(256)] + [bytes(x) for x in (b"ab", b"cd", b" a", b"abc", b"dd")])

    def likelihood(rounds):
        p = langid.fit([counts], lattice, rounds)
        assert abs(p.sum() - 1) < 1e-9
        words = list(counts)
        return (langid.word_logs(words, lattice, p)[:, 0] * [counts[w] for w in words]).sum()

    found = [likelihood(r) for r in (1, 2, 4, 8)]
    assert found == sorted(found)


def test_memory_changes_nothing():
    lattice = langid.Lattice(langid.pieces())
    p = np.random.default_rng(1).random((lattice.size, 3)) / 1e4
    rng = random.Random(4)
    lists = [[bytes(rng.choices(b"abcdef", k=rng.randrange(1, 9))) for _ in range(rng.randrange(60))] for _ in range(20)] + [[b"z" * 500]]
    whole, small = langid.WordMemory(lattice, p), langid.WordMemory(lattice, p, 25)
    assert np.allclose(whole.totals(lists), small.totals(lists))


def corpus(n=400):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "ung", "keit", "ver", "ö"], "cc": ["ción", "ñ", "el", "os", "ra"]}
    return [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang, 0.0) for i in range(n) for lang in [rng.choice(list(parts))]]


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    model = langid.Model(df.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [d for d in docs if d[0] % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 + 1e-9 for r in got.values())


def test_edges(spark):
    docs = corpus(60)
    odd = [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "12 34 !?", "bb", 0.0), (903, "x", None, 0.0), (None, "ka lo mi", "aa", 0.0), (904, "schung " * 30_000, None, 0.0), (905, "y" * 50_000, None, 0.0), (905, "ñ", None, 0.0), (905, "ñ", None, 0.0)]
    df = spark.createDataFrame(docs + odd, DOCS)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, langid.Model(df)).collect()]
    assert len(got) == len(docs) + len(odd)
    assert all(lang == "und" for d, lang in got if d in (900, 901, 902)) and (904, "bb") in got and (None, "aa") in got and got.count((905, "cc")) == 2
    assert langid.predict(df.limit(0), langid.Model(df)).count() == 0
    nothing = langid.predict(df, langid.Model(df.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
