"""Prediction by partial matching over bytes, on sorted arrays.

A symbol is a byte of the token stream (words joined by one space, closed by a
newline, which is the end symbol). Documents start after ``order`` newlines, so
every position has a full context. Only counts of (order+1)-grams are kept. The
count of a shorter gram is the number of different grams one byte longer that end
in it (update exclusion: a short context learns a symbol once for each longer
context that had not seen it). The symbols seen after a context are always among
those seen after its suffixes, so the exclusion set at an order is the set of
symbols seen one order above.

Escape estimation: every symbol seen after a context gives up DISCOUNT of its
count. After T symbols of D kinds, a symbol seen c times has (c - DISCOUNT) / T
and the escape DISCOUNT * D / T, both after exclusion.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the alphabet: all bytes (the newline is the end symbol).
ALPHABET = 256
DISCOUNT = 0.3


def gram_codes(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(order+1)-gram codes of all positions, and the number of positions of each stream."""
    pad = b"\n" * order
    joined = np.frombuffer(pad + pad.join(streams) if streams else b"", np.uint8)
    sizes = np.array([len(s) for s in streams], np.int64)
    if not len(streams):
        return np.zeros(0, np.uint64), sizes
    n = len(joined) - order
    codes = np.zeros(n, np.uint64)
    for j in range(order + 1):
        codes <<= np.uint64(8)
        codes |= joined[j : j + n]
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + order)])
    if order and len(streams) > 1:  # positions whose symbol is padding go
        keep = np.ones(n, bool)
        cut = (starts[1:] - order)[:, None] + np.arange(order)
        keep[cut.ravel()] = False
        codes = codes[keep]
    return codes, sizes


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sum of their counts."""
    if not len(codes):
        return codes.astype(np.uint64), counts.astype(np.int64)
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.concatenate([[True], codes[1:] != codes[:-1]])
    at = np.flatnonzero(first)
    return codes[at], np.add.reduceat(counts.astype(np.int64), at)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def shorter(grams: np.ndarray, k: int) -> np.ndarray:
    """The last k + 1 bytes of each gram."""
    return grams & np.uint64((1 << (8 * (k + 1))) - 1)


class Trie:
    """The context trie as one level of sorted arrays for each order.

    ``lows`` gives the levels below ``from_order`` (built from all grams), so a
    part that holds only the grams of some contexts of ``from_order`` bytes still
    escapes to the whole corpus's short contexts.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, lows: Trie | None = None, from_order: int = 0):
        self.order = order
        low = from_order if lows is not None else 0
        self.levels: list[dict] = [lows.levels[k] for k in range(low)] + [{} for _ in range(low, order + 1)]
        grams, n = summed(codes, counts)
        for k in range(order, low - 1, -1):
            if k < order:
                grams, n = summed(shorter(grams, k), np.ones(len(grams), np.int64))
            ctx = grams >> np.uint64(8)
            contexts, total = summed(ctx, n)
            _, kinds = summed(ctx, np.ones(len(ctx), np.int64))
            self.levels[k] = {"grams": grams, "n": n, "ctx": contexts, "total": total, "kinds": kinds}
        for k in range(max(low, 1), order + 1):  # what the context's symbols have one order below
            level, up = self.levels[k], self.levels[k - 1]
            below = up["n"][np.maximum(_find(up["grams"], shorter(level["grams"], k - 1)), 0)] if len(level["grams"]) else level["n"]
            _, level["below"] = summed(level["grams"] >> np.uint64(8), below)

    def size(self) -> int:
        return sum(len(x["grams"]) for x in self.levels)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the bytes before it."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))  # whose symbol has not been coded yet
        n_up = np.zeros(len(codes), np.int64)  # counts and kinds excluded at the present order
        k_up = np.zeros(len(codes), np.int64)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(left):
                break
            gram = shorter(codes[left], k)
            at = _find(level["ctx"], gram >> np.uint64(8))
            there = at >= 0
            i = np.maximum(at, 0)
            if not len(level["ctx"]):
                continue
            total = np.where(there, level["total"][i] - n_up[left], 0)
            kinds = np.where(there, level["kinds"][i] - k_up[left], 0)
            g = _find(level["grams"], gram)
            coded = g >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log10((level["n"][np.maximum(g, 0)] - DISCOUNT) / total)
                miss = np.where(kinds > 0, np.log10(DISCOUNT * kinds / total), 0.0)
            out[left] += np.where(coded, hit, miss)
            if k:
                n_up[left] = np.where(there, level["below"][i], 0)
                k_up[left] = np.where(there, level["kinds"][i], 0)
            else:
                k_up[left] = np.where(there, level["kinds"][i], 0)
            left = left[~coded]
        if len(left):
            out[left] -= np.log10(np.maximum(ALPHABET - k_up[left], 1))
        return out
