"""Benchmark decontamination: SimHash of item-sized windows, then exact shingle similarity.

A document holds an item if some window of as many words as the item (the whole
document, if it is shorter) has a weighted Jaccard similarity of at least 0.75
with it over five-word shingles, weighted by how often each occurs.

Windows are found in steps, none of which loses a match but the fingerprints' radius:

1. At that similarity three quarters of a window's shingles are benchmark shingles;
   other windows get no fingerprint. This cuts nearly all windows of clean texts.
2. A window and an item of n shingles share t = ceil(2 n * 0.75 / 1.75) of them at
   least, so one of the window's first n - t + 1 is the item's: only items listed
   under those shingles are probed. This cuts the pairs to items that have text
   in common; a pair list is made PAIRS at a time.
3. The multi-index: fingerprints of BITS bits are compared in BLOCKS blocks, and a
   pair goes on if some block differs by at most NEAR bits. As BLOCKS * (NEAR + 1)
   is above RADIUS, every pair within RADIUS has such a block; about 27 of 100
   random pairs do. The whole fingerprints then decide on RADIUS.
4. The exact similarity decides.

RADIUS is where a window at the threshold has a fingerprint farther off with
probability 7e-5. Windows and items of other sizes (documents shorter than the
item) are not told apart by step 2 and go through 3 and 4.

The benchmark is held by every task, at most ITEMS and ITEM_BYTES at a time: more
items are more passes, each settled before the next, so no task or driver holds
two parts. Defined results: documents or items without words match nothing; items
of fewer than five words are one shingle; a null doc_id or item_id is reported as
null; rows that repeat are each reported; of equally similar windows the first is
reported; an empty documents or benchmark table gives no matches; a very long text
is taken in stretches; other columns of documents pass through `decontaminated`.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common

WIDTH, PERCENT = 5, 75
BITS, BLOCKS, NEAR, RADIUS = 128, 8, 4, 39
ITEMS, ITEM_BYTES = 20_000, 32 << 20
#: Pairs of windows and items compared at once.
PAIRS = 500_000
#: Words of a document whose windows are made at once.
STRETCH = 20_000

_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def votes(shingles: np.ndarray) -> np.ndarray:
    """(shingles, BITS): +1 or -1 for each bit of each shingle's hash."""
    hashes = np.stack([common.mixed(shingles + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(BITS // 64)], 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(windows, BLOCKS) 16-bit blocks: the sign of each bit's sum of votes; of its neighbour's where they cancel out, so that bits are not biased."""
    return np.packbits(np.where(sums == 0, np.roll(sums, 1, axis=1), sums) > 0, axis=1).view(np.uint16)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs of fingerprints (rows of ``a`` and ``b``) within RADIUS, by way of the blocks."""
    left = np.zeros(len(a), bool)
    for k in range(BLOCKS):
        left |= _POPCOUNT[a[:, k] ^ b[:, k]] <= NEAR
    at = np.flatnonzero(left)
    return at[_POPCOUNT[a[at] ^ b[at]].sum(1) <= RADIUS]


class Items:
    """Benchmark items by their number of words, with the block tables of their fingerprints."""

    def __init__(self, rows: list[tuple], width: int = WIDTH, percent: int = PERCENT):
        self.width, self.percent = width, percent
        by_size: dict[int, list] = defaultdict(list)
        every: list[np.ndarray] = []
        for item, text in rows:
            words = common.hashed(common.words_of(text))
            if not len(words):
                continue
            shingles = common.shingle_hashes(words, width)
            every.append(shingles)
            by_size[len(words)].append((item, Counter(shingles.tolist()), fingerprints(votes(shingles).sum(0, keepdims=True))[0]))
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.groups = {}
        for size, items in sorted(by_size.items()):
            prints = np.stack([x[2] for x in items])
            # the items of this size that each of their shingles occurs in
            listed = np.array([(x, i) for i, item in enumerate(items) for x in item[1]], np.uint64).reshape(-1, 2)
            listed = listed[np.argsort(listed[:, 0], kind="stable")]
            self.groups[size] = (items, prints, listed[:, 0], listed[:, 1].astype(np.int64))

    def probed(self, size: int, shingles: np.ndarray, starts: np.ndarray, n: int):
        """(windows, items) to compare, about PAIRS at a time; windows are places in ``starts``."""
        items, _, keys, of = self.groups[size]
        if n != size - self.width + 1:  # the document is shorter than the items: one window
            yield np.zeros(len(items), np.int64), np.arange(len(items))
            return
        first = n - -(-2 * n * self.percent // (100 + self.percent)) + 1
        low, high = np.searchsorted(keys, shingles), np.searchsorted(keys, shingles, "right")
        counts = np.concatenate([[0], np.cumsum(high - low)])
        per_window = counts[starts + first] - counts[starts]
        upto = np.cumsum(per_window)
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            own = np.flatnonzero(per_window[at:end]) + at
            places = (starts[own][:, None] + np.arange(first)).ravel()
            times = high[places] - low[places]
            w = np.repeat(np.repeat(own, first), times)
            begins = np.repeat(low[places] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            pairs = np.unique(w * len(items) + of[begins + np.arange(len(w))])
            if len(pairs):
                yield pairs // len(items), pairs % len(items)
            at = end

    def matches(self, text: bytes | None) -> list[tuple]:
        """(item, first word, words, similarity) of the best window for each item that the text holds."""
        words = common.hashed(common.words_of(text))
        best: dict[tuple[int, int], tuple] = {}
        if not len(words) or not len(self.shingles):
            return []
        for size in self.groups:
            if size < self.width or len(words) < self.width:  # one shingle: equal or not
                self._whole(size, words, best)
        if len(words) >= self.width:
            self._windows(words, best)
        found = [(self.groups[size][0][i][0], start, n, similarity) for (size, i), (similarity, start, n) in best.items()]
        return sorted(found, key=lambda x: (x[1], x[0] is None, x[0] or 0))

    def _whole(self, size: int, words: np.ndarray, best: dict) -> None:
        n = min(size, len(words))
        shingles = common.shingle_hashes(words, n) if n < self.width else None
        if shingles is None:
            return
        for i, (_, own, _) in enumerate(self.groups[size][0]):
            if len(own) == 1:
                at = np.flatnonzero(shingles == np.uint64(next(iter(own))))
                if len(at):
                    best[size, i] = (1.0, int(at[0]), n)

    def _windows(self, words: np.ndarray, best: dict) -> None:
        shingles = common.shingle_hashes(words, self.width)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        hit = self.shingles[at] == shingles
        if not hit.any():
            return
        longest = max(self.groups)
        spots = np.flatnonzero(hit)
        # stretches of the text around hits, each with room for the longest window
        cuts = np.flatnonzero(np.diff(spots) > longest)
        for first, last in zip(spots[np.concatenate([[0], cuts + 1])], spots[np.concatenate([cuts, [len(spots) - 1]])], strict=True):
            low, high = max(0, first - longest), min(len(shingles), last + longest)
            for start in range(low, high, STRETCH):
                self._stretch(shingles, hit, start, min(high, start + STRETCH + longest), best)

    def _stretch(self, shingles: np.ndarray, hit: np.ndarray, low: int, high: int, best: dict) -> None:
        part = shingles[low:high]
        hits = np.concatenate([[0], np.cumsum(hit[low:high])])
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(votes(part), axis=0, dtype=np.int32)])
        for size, (items, prints, _, _) in self.groups.items():
            n = size - self.width + 1  # shingles in a window
            if n < 1:
                continue
            if n > len(shingles):
                if low == 0 and high == len(shingles):
                    starts, n = np.zeros(1, np.int64), len(shingles)
                else:
                    continue
            elif n > len(part):
                continue
            else:
                starts = np.arange(len(part) - n + 1)
            starts = starts[100 * (hits[starts + n] - hits[starts]) >= self.percent * n]
            if not len(starts):
                continue
            own_prints = fingerprints(sums[starts + n] - sums[starts])
            pairs = [(w[k], i[k]) for w, i in self.probed(size, part, starts, n) for k in [close(own_prints[w], prints[i])]]
            for a, k in [x for w, i in pairs for x in zip(starts[w].tolist(), i.tolist(), strict=True)]:
                own = items[k][1]
                here = Counter(part[a : a + n].tolist())
                shared = sum(min(c, own[s]) for s, c in here.items() if s in own)
                union = n + sum(own.values()) - shared
                if 100 * shared >= self.percent * union:
                    found = (shared / union, low + a, n + self.width - 1)
                    old = best.get((size, k))
                    if old is None or (found[0], -found[1]) > (old[0], -old[1]):
                        best[size, k] = found


_MATCH = "array<struct<item_id:long,first_word:long,n_words:long,similarity:double>>"


def _finder(shared):
    """A column function: the matches of each text with the broadcast items."""

    @F.arrow_udf(_MATCH)
    def run(texts: pa.Array) -> pa.Array:
        names = ("item_id", "first_word", "n_words", "similarity")
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
        return pa.array([[dict(zip(names, m, strict=True)) for m in shared.value.matches(t)] for t in texts.to_pylist()], kind)

    return run


def _passes(benchmark: DataFrame, items: int = ITEMS, item_bytes: int = ITEM_BYTES):
    """The benchmark as parts that tasks can hold, one after another."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // items), -(-size // item_bytes))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield n, Items(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))


def with_matches(docs: DataFrame, benchmark: DataFrame, into: str = "matches") -> DataFrame:
    """``docs`` with an array of the items that each text holds; all columns pass through.

    One part of the benchmark is one lazy projection. With more, each pass over the
    documents is settled, its part is given up, and the table before it is removed.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    columns, out, old = docs.columns, docs, None
    for k, (n, part) in enumerate(_passes(benchmark)):
        shared = spark.sparkContext.broadcast(part)
        found = _finder(shared)(F.col("text").cast("binary"))
        out = out.select(*columns, (F.concat(into, found) if k else found).alias(into))
        if n > 1:
            out = common.settle(out, "matches")
            shared.destroy()
            if old is not None:
                common.unsettle(old)
            old = out
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity of each item that each document holds."""
    found = with_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    name = common.free_name(docs, "__matches")
    return with_matches(docs, benchmark, name).filter(F.size(name) == 0).drop(name)


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
