"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on resampled labelled rows; each path to a node is a rule,
a conjunction of thresholds on statistics. A lasso logistic regression gives
most rules weight zero. The rules that remain are compiled into Spark column
expressions over the statistics, so scoring is one projection.

Statistics are taken over whole texts. Labels are read for training only. The fit
takes a bounded sample, by parameters: about ``sample_rows`` labelled rows, taken by
a hash of doc_id and then of the text, and for each tree at most ``tree_rows`` rows
of each class, drawn with replacement. Scores are computed for all rows.

Defined results: a null or empty text has all statistics 0 and gets a score like any
other; a null doc_id is in the training folds and has no label; rows that repeat are
scored once each and train once; a doc_id with several labels trains with each;
without labels, or with one class only, the score is that class's share (0.5 without
labels); an empty documents table gives no rows; equal scores stay equal, and the
threshold itself is accepted; a very long text is one row like any other; all other
columns pass through, also those named like a statistic or like ``score``'s helpers.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common

FOLDS, HELD_OUT = 5, 0
#: Bound of the training sample, in labelled rows, and of a tree's, in rows of each class.
SAMPLE_ROWS, TREE_ROWS = 30_000, 3000
THRESHOLD = 0.3
TREES, DEPTH, LEAST_ROWS = 40, 3, 20
PENALTY = 1e-3
SEED = 20

STATISTICS = [
    "chars", "words", "word_length", "distinct_words", "top_word", "repeat_next", "one_letter", "upper", "first_upper",
    "digits", "punctuation", "symbols", "spaces", "lines", "words_per_line", "distinct_lines", "short_lines", "ends_stop",
    "stop_per_word", "comma_per_word", "bars", "braces", "links", "high_bytes", "longest_word", "entropy", "word_entropy", "pairs_distinct",
]

def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SPACE = _bytes(bytes(range(65, 91))), _bytes(b"0123456789"), _bytes(b" \t\n\x0b\x0c\r")
_PUNCTUATION, _SYMBOL, _BRACE = _bytes(b".,;:!?'\"()-"), _bytes(b"#$%&*+/<=>@\\^_`|~[]{}"), _bytes(b"{}<>[]")
_HIGH = _bytes(bytes(range(128, 256)))
_CLASSES = np.stack([_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _SPACE, _BRACE, _HIGH], 1).astype(float)
_LINK = re.compile(rb"https?:|www\.")
_STOPS = (b".", b"!", b"?", b'."', b".)", b'!"', b'?"')


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    if not text or not (words := text.split()):
        return [float(len(text or b""))] + [0.0] * (len(STATISTICS) - 1)
    n, k = len(text), len(words)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, punctuation, symbols, spaces, braces, high = (letters @ _CLASSES / n).tolist()
    p = letters[letters > 0] / n
    q = np.fromiter(counts.values(), float, len(counts)) / k
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        sum(map(len, words)) / k,
        len(counts) / k,
        max(counts.values()) / k,
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / k,
        sum(len(w) == 1 for w in words) / k,
        upper,
        sum(w[:1].isupper() for w in words) / k,
        digits,
        punctuation,
        symbols,
        spaces,
        float(np.log1p(len(lines))),
        k / len(lines),
        len(set(lines)) / len(lines),
        sum(len(x) < 40 for x in lines) / len(lines),
        sum(x.rstrip().endswith(_STOPS) for x in lines) / len(lines),
        text.count(b".") / k,
        text.count(b",") / k,
        text.count(b"|") / k,
        braces,
        len(_LINK.findall(text)) / k,
        high,
        float(np.log1p(max(map(len, words)))),
        float(-(p * np.log2(p)).sum()),
        float(-(q * np.log2(q)).sum() / np.log2(k + 1)),
        len(set(zip(lower, lower[1:], strict=False))) / k,
    ]


def with_statistics(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with a struct column of statistics; all other columns pass through."""
    common.arrow_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=STATISTICS)

    return docs.withColumn(into, run(F.col("text").cast("binary")))


#: A rule: conditions (statistic, is it above?, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
    """The best (gain, statistic, threshold) by Gini impurity among these columns."""
    n, ones = len(y), y.sum()
    best = (0.0, -1, 0.0)
    whole = ones * (n - ones) / n
    for c in columns:
        by = np.argsort(x[:, c], kind="stable")
        v, left = x[by, c], np.cumsum(y[by])[:-1]
        at = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (at >= LEAST_ROWS) & (n - at >= LEAST_ROWS)
        if not ok.any():
            continue
        right = ones - left
        gain = np.where(ok, whole - left * (at - left) / at - right * (n - at - right) / (n - at), -1)
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), int(c), float((v[i] + v[i + 1]) / 2))
    return best


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """The rules of one tree: the path to each of its nodes but the root."""
    if depth == 0 or len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return []
    columns = rng.choice(x.shape[1], max(3, x.shape[1] // 3), replace=False)
    gain, c, at = _split(x, y, columns)
    if c < 0:
        return []
    above = x[:, c] > at
    out: list[Rule] = []
    for side in (True, False):
        own = path + ((c, side, at),)
        out += [own] + _paths(x[above == side], y[above == side], rng, depth - 1, own)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, at in rule:
        out &= (x[:, c] > at) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n = len(y)
    mean, scale = z.mean(0, dtype=float), np.maximum(z.std(0, dtype=float), 1e-3)

    def times(w: np.ndarray) -> np.ndarray:
        """Standardised columns times weights, without a second matrix."""
        w = w / scale
        return z @ w.astype(z.dtype) - float(mean @ w)

    def across(e: np.ndarray) -> np.ndarray:
        return (z.T @ e.astype(z.dtype) - mean * e.sum()) / scale

    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(z.shape[1]), float(np.log(rate / (1 - rate)))
    v, c, t = w.copy(), b, 1.0
    probe = np.ones(z.shape[1])
    for _ in range(30):  # the largest eigenvalue, for the step
        probe = across(times(probe))
        probe /= np.linalg.norm(probe) + 1e-12
    size = 4 / (np.linalg.norm(times(probe)) ** 2 / n + 1)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(times(v) + c))) - y
        nw = v - size * across(error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb = c - size * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / scale, b - float((w * mean / scale).sum())


class Model:
    """Weighted rules fitted on a bounded sample of labelled rows."""

    def __init__(self, rows: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED, tree_rows: int = TREE_ROWS):
        self.rules: list[tuple[Rule, float]] = []
        ones = float(y.sum())
        if not len(y) or ones in (0.0, float(len(y))):
            share = ones / len(y) if len(y) else 0.5
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.intercept = float(np.log(share / (1 - share)))
            return
        rng = np.random.default_rng(seed)
        found: dict[Rule, None] = {}
        heavy, light = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        for _ in range(trees):  # both classes weigh the same in a tree
            n = min(tree_rows, max(len(heavy), len(light)))
            own = np.concatenate([rng.choice(heavy, n), rng.choice(light, n)])
            found.update(dict.fromkeys(_paths(rows[own], y[own], rng, depth)))
        apart: dict[bytes, Rule] = {}
        for rule in found:  # rules that hold for the same rows count once
            apart.setdefault(np.packbits(holds(rule, rows)).tobytes(), rule)
        rules = list(apart.values())
        z = np.zeros((len(y), len(rules)), np.float32)
        for i, rule in enumerate(rules):
            z[:, i] = holds(rule, rows)
        w, self.intercept = lasso_logistic(z, y.astype(float), penalty)
        self.rules = [(r, float(x)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-6]

    def column(self, of: str) -> Column:
        """The score as an expression over the struct of statistics.

        The rules' weights are an array that is summed: one flat expression, which
        the driver analyses and compiles in little memory.
        """

        def weight(rule: Rule, w: float) -> str:
            conditions = " and ".join(f"{of}.{STATISTICS[c]} {'>' if above else '<='} {float(at)!r}D" for c, above, at in rule)
            return f"if({conditions}, {float(w)!r}D, 0D)"

        total = f"{float(self.intercept)!r}D"
        if self.rules:
            total += f" + aggregate(array({', '.join(weight(r, w) for r, w in self.rules)}), 0D, (a, x) -> a + x)"
        return F.expr(f"1D / (1D + exp(-({total})))")


def _share(of: int, *keys: str) -> Column:
    """True for about ``of`` of 2^20 rows, by a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < of


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """A model from labelled documents, of which about ``sample_rows`` at most are used; ``options`` are those of Model."""
    marks = labels.filter(F.col(target).isNotNull()).select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("__label")).distinct()
    ids = marks.select("__id").distinct().count()
    marks = marks.filter(_share(-(-sample_rows * (1 << 20) // max(ids, 1)), "__id"))
    few = common.maybe_broadcast(marks, marks.count())
    rows = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("__id")).withColumn("__text", F.xxhash64("text"))
    key = ["__id", "__label", "__text"]
    rows = common.settle(with_statistics(rows, "__s").select(*key, "__s.*").dropDuplicates(key), "labelled")  # texts are not shuffled
    rows = rows.filter(_share(-(-2 * sample_rows * (1 << 20) // max(rows.count(), 1)), "__id", "__text"))  # a doc_id may have many texts
    got = rows.orderBy(*key).drop("__id", "__text").toArrow()
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return Model(x, got.column("__label").to_numpy().astype(float) if got.num_rows else np.zeros(0), **options)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with its score; all columns pass through."""
    name = common.free_name(docs, "__statistics")
    return with_statistics(docs, name).withColumn(into, model.column(name)).drop(name)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; the model is fitted on the training folds."""
    model = fit(docs.filter(~common.in_fold("doc_id", FOLDS, HELD_OUT)), labels)
    name = common.free_name(docs, "__score")
    return score(docs, model, name).filter(F.col(name) >= threshold).drop(name)


def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.in_fold("doc_id", FOLDS, HELD_OUT)
    model = fit(docs.filter(~held_out), common.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
