"""Language identification by unigram pieces, marginalised over all segmentations.

The pieces are a fixed public vocabulary (as bytes, with all single bytes added,
so every word can be cut). Each language has a probability for each piece; a
word's probability in a language is the sum over all its cuts of the product of
its pieces' probabilities, by the forward algorithm, and a text's is the product
over its words. Probabilities are fitted by expectation-maximisation on the word
counts of a bounded sample of labelled documents (SAMPLE_DOCS of each language, a
parameter); all words of the sampled documents count.

A word of any length is summed as a whole: the forward state slides on, scaled every
STEP bytes. A-Z are scored as a-z. A piece table takes 26,000 numbers for each language.

Defined results: a text that is null or has no letter is `und` with score 0; without
training rows, or on an empty table, every text is `und`; of equally likely languages
the first in order of names is taken; a null doc_id is in the training folds; rows
that repeat are scored once each; a very long text is summed over its words in parts;
other columns are not read.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common

VOCABULARY = "piece_bpe_32k.model"
#: Bound of the training sample: documents of each language (about).
SAMPLE_DOCS = 2000
ROUNDS = 3
SMOOTHING = 0.1
#: Bytes between two scalings: no piece is so unlikely that a product of so many underflows.
STEP = 24
#: Numbers in a task's memory of word scores.
MEMORY = 2_000_000
FOLDS, HELD_OUT = 5, 0


def pieces(file: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes, the word mark as a space, in lower case; all bytes first."""
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=file if "/" in file else public_tokenizers.path(file))
    found = dict.fromkeys(bytes([b]) for b in range(256))
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)):
            found.setdefault(p.id_to_piece(i).replace("▁", " ").encode().lower())
    return list(found)


class Lattice:
    """Finds the pieces inside words by hashed substrings."""

    def __init__(self, vocabulary: list[bytes]):
        self.longest = max(map(len, vocabulary))
        width = np.array([len(p) for p in vocabulary])
        self.lengths = set(width.tolist())
        code = np.zeros(len(vocabulary), np.uint64)
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(width == n)
            if len(own):
                code[own] = self.codes(np.frombuffer(b"".join(vocabulary[i] for i in own), np.uint8).reshape(-1, n), n)[:, n - 1, 0]
        by = np.argsort(code)
        self.code, self.piece = code[by], by.astype(np.int32)
        self.size = len(vocabulary)

    def codes(self, letters: np.ndarray, most: int | None = None) -> np.ndarray:
        """(words, length - 1, start) -> hash of each substring; 0 where it runs over the end."""
        words, n = letters.shape
        most = min(self.longest, n) if most is None else most
        out = np.zeros((words, most, n), np.uint64)
        run = np.full((words, n), 0x2545F4914F6CDD1D, np.uint64)
        for k in range(most):
            run = common.mixed(run[:, : n - k] * np.uint64(0x9E3779B97F4A7C15) + letters[:, k:].astype(np.uint64) + np.uint64(1))
            out[:, k, : n - k] = run
        return out

    def find(self, letters: np.ndarray) -> np.ndarray:
        """(words, length - 1, start) -> piece, or -1."""
        codes = self.codes(letters)
        out = np.full(codes.shape, -1, np.int32)
        for k in range(codes.shape[1]):
            if k + 1 not in self.lengths:
                continue
            own = codes[:, k, : letters.shape[1] - k]
            at = np.minimum(np.searchsorted(self.code, own), len(self.code) - 1)
            out[:, k, : own.shape[1]] = np.where(self.code[at] == own, self.piece[at], -1)
        return out


def by_length(words: list[bytes], most: int = 20_000):
    """(indices, letters) of words of one length at a time."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for i in range(0, len(own), max(1, most // int(n))):
            part = own[i : i + max(1, most // int(n))]
            yield part, np.frombuffer(b"".join(words[j] for j in part), np.uint8).reshape(len(part), n)


def forward(found: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """(words, n + 1, languages): the probability of each word's first bytes, summed over their cuts.

    ``probability`` ends in a row of zeros, which is what the place -1 (no piece) gives.
    """
    words, most, n = found.shape
    alpha = np.zeros((words, n + 1, probability.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for k in range(min(most, end)):
            piece = found[:, k, end - 1 - k]
            if k == 0 or piece.max() >= 0:
                alpha[:, end] += alpha[:, end - 1 - k] * probability[piece]
    return alpha


def _padded(probability: np.ndarray) -> np.ndarray:
    return np.vstack([probability, np.zeros((1, probability.shape[1]))])


def word_logs(words: list[bytes], lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """(words, languages): log of each word's probability summed over its cuts."""
    out = np.zeros((len(words), probability.shape[1]))
    probability = _padded(probability)
    for own, letters in by_length(words):
        if letters.shape[1] <= STEP:
            out[own] = np.log(forward(lattice.find(letters), probability)[:, -1])
        else:
            out[own] = _sliding(letters, lattice, probability)
    return out


def _sliding(letters: np.ndarray, lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """The same for long words: of the sums so far only those are held that a piece can start from."""
    words, n = letters.shape
    log = np.zeros((words, probability.shape[1]))
    held = np.ones((words, 1, probability.shape[1]))  # sums up to the places before s and at it
    for s in range(0, n, STEP):
        e, low = min(n, s + STEP), max(0, s - lattice.longest + 1)
        found = lattice.find(letters[:, low:e])
        past = held.shape[1]
        alpha = np.concatenate([held, np.zeros((words, e - s, held.shape[2]))], axis=1)
        for end in range(s + 1, e + 1):
            for k in range(min(found.shape[1], end - low)):
                piece = found[:, k, end - 1 - k - low]
                if k == 0 or piece.max() >= 0:
                    alpha[:, past - 1 + end - s] += alpha[:, past - 1 + end - 1 - k - s] * probability[piece]
        scale = alpha[:, -1]
        log += np.log(scale)
        held = alpha[:, -lattice.longest :] / scale[:, None]
    return log


def _shares(found: np.ndarray, p: np.ndarray):
    """(pieces, share of the word's probability that goes through each) at all places of words of one length.

    In logarithms where products would underflow.
    """
    words, most, n = found.shape
    there = (found >= 0).any(axis=0)
    with np.errstate(divide="ignore"):
        log = np.log(np.append(p, 0.0))
    far = n > STEP
    alpha, beta = np.full((2, words, n + 1), -np.inf) if far else np.zeros((2, words, n + 1))
    value, add, times = (log, np.logaddexp, np.add) if far else (np.exp(log), np.add, np.multiply)
    alpha[:, 0] = beta[:, n] = 0.0 if far else 1.0
    spots = [(start, k) for start in range(n) for k in range(min(most, n - start)) if there[k, start]]
    for start, k in sorted(spots, key=lambda x: x[0] + x[1]):
        alpha[:, start + k + 1] = add(alpha[:, start + k + 1], times(alpha[:, start], value[found[:, k, start]]))
    for start, k in reversed(spots):
        beta[:, start] = add(beta[:, start], times(beta[:, start + k + 1], value[found[:, k, start]]))
    for start, k in spots:
        at = found[:, k, start]
        through = times(times(alpha[:, start], value[at]), beta[:, start + k + 1])
        yield at, np.exp(through - alpha[:, n]) if far else through / alpha[:, n]


def fit(counts: list[Counter], lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """(pieces, languages): probabilities by expectation-maximisation over all cuts of the words."""
    probability = np.zeros((lattice.size, len(counts)))
    for k, own in enumerate(counts):
        words = list(own)
        times = np.array([own[w] for w in words], float)
        p = np.full(lattice.size, 1.0 / lattice.size)
        for _ in range(rounds):
            expected = np.full(lattice.size + 1, SMOOTHING)
            for i, letters in by_length(words):
                for at, share in _shares(lattice.find(letters), p):
                    expected += np.bincount(np.where(at < 0, lattice.size, at), share * times[i], lattice.size + 1)
            p = expected[:-1] / expected[:-1].sum()
        probability[:, k] = p
    return probability


def sampled_words(docs: DataFrame, sample_docs: int) -> dict[str, Counter]:
    """Word counts of each language over a sample of its documents (doc_id, text, lang), taken by a hash of id and text."""
    share = [(r["lang"], min(1.0, sample_docs / r["n"])) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not share:
        return {}
    rates = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, rate double"))  # a row for each language
    sample = docs.join(rates, "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    words = sample.select("lang", F.explode(F.split(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    out: dict[str, Counter] = {}
    for r in words.groupBy("lang", "word").agg(F.count("*").alias("n")).toLocalIterator():
        out.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return out


class Model:
    def __init__(self, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, file: str = VOCABULARY):
        """Fit on about ``sample_docs`` documents of each language of ``docs`` (doc_id, text, lang)."""
        self.file = file
        found = sampled_words(docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), sample_docs)
        self.languages = sorted(x for x in found if found[x])
        counts: list[Counter] = []
        for lang in self.languages:
            own: Counter = Counter()
            for word, n in found[lang].items():
                own[b" " + word.encode().lower()] += n
            counts.append(own)
        lattice = Lattice(pieces(file))
        self.probability = fit(counts, lattice) if counts else np.zeros((lattice.size, 0))


_lattices: dict[str, Lattice] = {}


def _lattice(file: str) -> Lattice:
    if file not in _lattices:
        _lattices[file] = Lattice(pieces(file))
    return _lattices[file]


class WordMemory:
    """Scores of words seen by this task: a bounded memory, emptied when full."""

    def __init__(self, lattice: Lattice, probability: np.ndarray, most: int | None = None):
        self.lattice, self.probability = lattice, probability
        self.most = most or max(1000, MEMORY // max(probability.shape[1], 1))  # words
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, probability.shape[1]))

    def totals(self, lists: list[list[bytes]]) -> np.ndarray:
        """(texts, languages): sums over each text's words. Texts go together while their words fit the memory."""
        out, start = np.zeros((len(lists), self.probability.shape[1])), 0
        while start < len(lists):
            stop, held = start + 1, len(lists[start])
            while stop < len(lists) and held + len(lists[stop]) <= self.most:
                held += len(lists[stop])
                stop += 1
            for at in range(0, max(held, 1), self.most):  # more than once only for one very long text
                part = lists[start:stop] if held <= self.most else [lists[start][at : at + self.most]]
                flat = [w for words in part for w in words]
                if flat:
                    sizes = np.array([len(w) for w in part])
                    full = np.flatnonzero(sizes)
                    firsts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    out[start + full] += np.add.reduceat(self._rows(flat), firsts, axis=0)
            start = stop
        return out

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """A row of scores for each word."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, self.rows, new = {}, self.rows[:0], list(dict.fromkeys(words))
        if new:
            rows = word_logs([b" " + w for w in new], self.lattice, self.probability)
            used = len(self.known)
            self.known.update(zip(new, range(used, used + len(new)), strict=True))
            if len(self.known) > len(self.rows):
                grown = np.zeros((min(self.most, 2 * len(self.known) + 1024), rows.shape[1]))
                grown[:used] = self.rows[:used]
                self.rows = grown
            self.rows[used : used + len(new)] = rows
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the posterior of the best language under equal priors."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    languages, file = model.languages, model.file
    shared = spark.sparkContext.broadcast(model.probability)  # pieces x languages, both bounded

    def run(batches):
        memory = WordMemory(_lattice(file), shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            new_lists, letters = [], []
            for t in texts:
                letters.append(bool(t) and any(map(str.isalpha, t)))
                new_lists.append(common.words_of(t.encode()) if letters[-1] else [])
            logs = memory.totals(new_lists) if languages else np.zeros((len(texts), 0))
            names, scores = [], []
            for row, has in zip(logs, letters, strict=True):
                if not has or not languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(row - row[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_marginal_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.in_fold("doc_id", FOLDS, HELD_OUT)
    found = predict(docs, Model(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
