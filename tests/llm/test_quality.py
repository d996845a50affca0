"""Quality: rules as columns score as rules in numpy, held-out accuracy, and edge cases."""

import random

import numpy as np
import pytest
from chronofold.llm import common, quality
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, score double, __extra int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randrange(20, 200))
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            own = [own[0]] * len(own) if kind == 0 else [w + "%%%" for w in own] if kind == 1 else [x for w in own for x in (w, "|")]
        docs.append((i, " ".join(own) + ".", "xx", 0.0, 1))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held_out = common.in_fold("doc_id", 5, 0)
    model = quality.fit(df.filter(~held_out), marks)
    assert 0 < len(model.rules) < 200
    scored = quality.score(df.drop("score"), model).filter(held_out).join(marks, "doc_id").collect()
    right = sum((r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in scored)
    assert len(scored) > 100 and right / len(scored) > 0.97
    # the compiled columns are the rules
    x = np.array([quality.statistics(t.encode()) for _, t, *_ in docs[:50]])
    z = model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules)
    got = [r["score"] for r in quality.score(df.drop("score").limit(50), model).orderBy("doc_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_kept_keeps_columns(spark):
    docs, labels = corpus(400, 3)
    df = spark.createDataFrame(docs, DOCS)
    kept = quality.kept(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns
    good = {i for i, q, _ in labels if q}
    got = {r["doc_id"] for r in kept.collect()}
    assert len(got & good) > 0.98 * len(good) and len(got - good) < 10


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, 0)], 0.5)])
def test_few_labels(spark, labels, score):
    df = spark.createDataFrame([(1, "a b", "", 0.0, 0), (2, None, "", 0.0, 0), (None, "", "", 0.0, 0), (1, "a b", "", 0.0, 0)], DOCS)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [r["s"] for r in quality.score(df, model, "s").collect()]
    assert len(got) == 4 and np.allclose(got, score, atol=1e-5)
    assert quality.score(df.filter(F.lit(False)), model, "s").count() == 0


def test_statistics_of_odd_texts():
    for t in (None, b"", b" \n\t ", b"\xff\xfe", b"x" * 100_000, ("é" * 50).encode(), b"\n".join([b"a"] * 5000)):
        got = quality.statistics(t)
        assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()


def plain_statistics(text):
    """Each statistic as its name says, letter by letter."""
    import math
    from collections import Counter

    data = (text or "").encode()
    words = data.split()
    if not words:
        return [float(len(data))] + [0.0] * (len(quality.STATISTICS) - 1)
    n, k, low = len(data), len(words), [w.lower() for w in words]
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda chars: sum(b in chars for b in data) / n
    entropy = lambda counts: -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts)
    stops = (b".", b"!", b"?", b'."', b".)", b'!"', b'?"')
    return [
        math.log(n + 1), math.log(k + 1), sum(len(w) for w in words) / k, len(set(low)) / k, max(low.count(w) for w in set(low)) / k,
        sum(low[i] == low[i + 1] for i in range(k - 1)) / k, len([w for w in words if len(w) == 1]) / k,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len([w for w in words if w[0:1] in [bytes([c]) for c in range(65, 91)]]) / k,
        share(b"0123456789"), share(b".,;:!?'\"()-"), share(b"#$%&*+/<=>@\\^_`|~[]{}"), share(b" \t\n\x0b\x0c\r"),
        math.log(len(lines) + 1), k / len(lines), len(set(lines)) / len(lines), len([x for x in lines if len(x) < 40]) / len(lines),
        len([x for x in lines if any(x.rstrip().endswith(e) for e in stops)]) / len(lines),
        data.count(b".") / k, data.count(b",") / k, data.count(b"|") / k, share(b"{}<>[]"),
        (data.count(b"http:") + data.count(b"https:") + data.count(b"www.")) / k, share(bytes(range(128, 256))),
        math.log(max(len(w) for w in words) + 1), entropy(Counter(data).values()), entropy(Counter(low).values()) / math.log2(k + 1),
        len({(low[i], low[i + 1]) for i in range(k - 1)}) / k,
    ]


def test_statistics_against_plain_ones():
    rng = random.Random(8)
    texts = ["", " \n", "One two. TWO two, | {x} http://a www.b\nLine 2!\n\nÄé \"quoted.\"", "a"]
    texts += ["".join(rng.choices("abAB .,|{}\n09é#", k=rng.randrange(1, 300))) for _ in range(200)]
    for t in texts:
        assert np.allclose(quality.statistics(t.encode()), plain_statistics(t), atol=1e-12), t


def test_split_against_all_thresholds():
    rng = np.random.default_rng(3)

    def impurity(y):
        return len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    for _ in range(20):
        x, y = rng.integers(0, 12, (90, 3)).astype(float), rng.integers(0, 2, 90).astype(float)
        best = 0.0
        for c in range(3):
            for at in np.unique(x[:, c]):
                left, right = y[x[:, c] <= at], y[x[:, c] > at]
                if min(len(left), len(right)) >= quality.LEAST_ROWS:
                    best = max(best, impurity(y) - impurity(left) - impurity(right))
        gain, c, at = quality._split(x, y, np.arange(3))
        assert abs(gain - best) < 1e-9
        if c >= 0:
            left, right = y[x[:, c] <= at], y[x[:, c] > at]
            assert abs(impurity(y) - impurity(left) - impurity(right) - gain) < 1e-9


def test_rules_are_the_paths_of_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    rules = quality._paths(x, y, np.random.default_rng(1), 3)
    assert rules and len(set(rules)) == len(rules)
    for rule in rules:
        own = np.array([all((row[c] > at) == above for c, above, at in rule) for row in x])
        assert (quality.holds(rule, x) == own).all() and own.sum() >= quality.LEAST_ROWS
        sibling = rule[:-1] + ((rule[-1][0], not rule[-1][1], rule[-1][2]),)
        assert sibling in rules and (len(rule) == 1 or rule[:-1] in rules)


def test_lasso_against_a_slow_solver():
    """Coordinate descent with a full search for each weight finds no better weights."""
    rng = np.random.default_rng(5)
    z = (rng.random((300, 6)) < 0.4).astype(np.float32)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 3])))).astype(float)
    scale = z.std(0)

    def loss(w, b, penalty):
        m = z @ w + b
        return np.mean(np.logaddexp(0, m) - y * m) + penalty * np.abs(w * scale).sum()

    for penalty in (0.002, 0.05):
        w, b = np.zeros(6), 0.0
        step = 1.0
        while step > 1e-6:
            better = False
            for j in range(7):
                for d in (step, -step):
                    v, c = w.copy(), b
                    if j < 6:
                        v[j] = 0.0 if abs(v[j]) < step and v[j] * d < 0 else v[j] + d
                    else:
                        c += d
                    if loss(v, c, penalty) < loss(w, b, penalty) - 1e-12:
                        w, b, better = v, c, True
            if not better:
                step /= 2
        got, bias = quality.lasso_logistic(z, y, penalty, 3000)
        assert abs(loss(got, bias, penalty) - loss(w, b, penalty)) < 1e-5
        assert np.allclose(got, w, atol=0.02) and (penalty < 0.01 or (got[[1, 2, 4, 5]] == 0).sum() >= 3)


def test_query_against_its_rules(spark, tmp_path):
    """op3's rows from plain statistics, the fitted rules one by one, and folds by hand."""
    import zlib

    docs, labels = corpus(500, 6)
    docs += [(1000, None, "", 0.0, 1), (1001, "", "", 0.0, 1), (None, "a b", "", 0.0, 1)]
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in quality.op3_rule_quality(spark, str(tmp_path)).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in docs}
    known = dict((i, q) for i, q, _ in labels)
    train = sorted(i for i in known if not held[i])
    texts = {i: t for i, t, *_ in docs}
    by_hand = quality.Model(np.array([plain_statistics(texts[i]) for i in train]), np.array([float(known[i]) for i in train]))
    assert len(got) == len(docs)
    for i, t in texts.items():
        z = by_hand.intercept
        for rule, w in by_hand.rules:
            if all((plain_statistics(t)[c] > at) == above for c, above, at in rule):
                z += w
        want = 1 / (1 + np.exp(-z))
        assert abs(got[i]["score"] - want) < 0.02 and got[i]["held_out"] == held[i]
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_labels_of_one_document_and_repeated_rows(spark):
    docs = [(1, f"text {i % 7}", "", 0.0, 0) for i in range(300)]
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, 1, 0)] * 500 + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, marks)
    assert np.allclose([r["s"] for r in quality.score(df.limit(3), model, "s").collect()], 0.5, atol=0.01)
