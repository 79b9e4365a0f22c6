"""Suffix arrays by the difference-cover algorithm (modulo 3), over NumPy arrays.

Suffixes at places 1 and 2 modulo 3 are sorted by triples; if triples are not all
distinct the algorithm recurses on their names; the remaining suffixes are sorted by
(symbol, rank of the next suffix) and merged in.
"""

from __future__ import annotations

import numpy as np


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names 1, 2, ... of the values, and how many."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(values) else np.zeros(0, bool)
    names = np.empty(len(values), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def _combine(high: np.ndarray, low: np.ndarray, bound: int) -> np.ndarray:
    """One number that orders as (high, low); ``low`` is below ``bound``."""
    if len(high) and int(high.max()) >= (1 << 62) // max(bound, 1):
        high = _dense(high)[0]
    return high * bound + low


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank (from 0) of every suffix of a string of integers of 0 or more."""
    n = len(symbols)
    if n < 3:
        order = sorted(range(n), key=lambda i: tuple(symbols[i:].tolist()))
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(n)
        return ranks
    s, size = _dense(symbols.astype(np.int64))
    bound = max(size, n) + 2
    s = np.concatenate([s, np.zeros(3, np.int64)])
    # sample: places 1 and 2 modulo 3 (and place n if n is 1 modulo 3, so that the parts keep apart)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = _combine(_combine(s[sample], s[sample + 1], bound), s[sample + 2], bound)
    names, distinct = _dense(triples)
    below = names - 1 if distinct == len(sample) else suffix_ranks(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = below + 1
    by_rank = np.empty(len(sample), np.int64)
    by_rank[below] = sample
    by_rank = by_rank[by_rank < n]
    zeros = np.arange(0, n, 3)
    key0 = _combine(s[zeros], rank[zeros + 1], bound)
    order0 = np.argsort(key0, kind="stable")
    zeros, key0 = zeros[order0], key0[order0]
    # merge: against places 1 modulo 3 by (symbol, rank of the next), against 2 modulo 3 by two symbols and a rank
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    both = _dense(np.concatenate([_combine(s[x], s[x + 1], bound) for x in (zeros, two)]))[0]
    far0, far2 = _combine(both[: len(zeros)], rank[zeros + 2], bound), _combine(both[len(zeros) :], rank[two + 2], bound)
    near1 = _combine(s[one], rank[one + 1], bound)
    # the same order must hold for both sides of a comparison
    near = _dense(np.concatenate([key0, near1]))[0]
    far = _dense(np.concatenate([far0, far2]))[0]
    before = np.searchsorted(near[len(zeros) :], near[: len(zeros)]) + np.searchsorted(far[len(zeros) :], far[: len(zeros)])
    place0 = np.arange(len(zeros)) + before
    taken = np.zeros(n, bool)
    taken[place0] = True
    out = np.empty(n, np.int64)
    out[zeros] = place0
    out[by_rank] = np.flatnonzero(~taken)
    return out


def order_rows(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of an integer matrix: the suffix array of all rows, each closed by a smallest symbol, at the rows' starts."""
    n, width = rows.shape
    if n < 2:
        return np.arange(n)
    names = _dense(rows.ravel())[0].reshape(n, width)
    string = np.concatenate([names, np.zeros((n, 1), np.int64)], 1).ravel()
    return np.argsort(suffix_ranks(string)[:: width + 1], kind="stable")
