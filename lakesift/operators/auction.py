"""Optimal alignment of wide tables without a matrix (U5, E10): an auction.

The columns of the narrower table bid for columns of the wider one; a bid raises
a price by the advantage over the second best column plus epsilon.  Columns of
the wider table that stay unmatched are taken by stand-ins of no value, which
act as one bidder: together they take the cheapest columns.  Epsilon scaling:
each phase starts from the prices of the one before with a smaller epsilon; at
the end the total is below the optimum by ``columns x epsilon`` at most.

A bidder's scores are computed when it bids, from the columns' features and the
pair's overlaps, so memory is that of the features, not of n x m scores, and work
is bids x columns instead of n^2 x m.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lakesift.config import CARDINALITY_WEIGHT, JACCARD_WEIGHT, NORM_EPSILON

#: First epsilon, the divisor between phases, and the last one (times columns:
#: the distance to the optimum that is allowed for).
FIRST, DIVISOR, LAST = 0.1, 8.0, 1e-10


def auction(row: Callable[[int], np.ndarray], n: int, m: int) -> tuple[float, np.ndarray]:
    """(total, column of each row) of an optimal assignment of all ``n <= m`` rows;
    ``row(i)`` gives the scores of row i."""
    if n == 0 or m == 0:
        return 0.0, np.zeros(0, np.int64)
    price, last = np.zeros(m), max(LAST / m, 1e-13)
    epsilon = FIRST
    while True:
        column = _phase(row, n, m, price, epsilon)
        if epsilon <= last:
            return float(sum(row(i)[j] for i, j in enumerate(column))), column
        epsilon = max(epsilon / DIVISOR, last)


def _phase(row, n: int, m: int, price: np.ndarray, epsilon: float) -> np.ndarray:
    """Bids until every row and every stand-in has a column; ``price`` is raised in place."""
    column, owner, taken = np.full(n, -1), np.full(m, -1), np.zeros(m, bool)
    free = list(range(n - 1, -1, -1))
    while True:
        while free:
            i = free.pop()
            gain = row(i) - price
            j = int(gain.argmax())
            best, gain[j] = gain[j], -np.inf
            second = gain.max() if m > 1 else best
            price[j] += best - second + epsilon
            if owner[j] >= 0:
                column[owner[j]] = -1
                free.append(int(owner[j]))
            owner[j], column[i], taken[j] = i, j, False
        need = m - n - int(taken.sum())
        if need <= 0:
            return column
        others = np.flatnonzero(~taken)
        others = others[np.argsort(price[others], kind="stable")]
        cheap = others[:need]
        level = (price[others[need]] if need < len(others) else price[cheap].max()) + epsilon
        price[cheap] = np.maximum(level, price[cheap] + epsilon)
        taken[cheap] = True
        for j in cheap[owner[cheap] >= 0]:
            column[owner[j]] = -1
            free.append(int(owner[j]))
            owner[j] = -1


def union_rows(type_q, type_c, card_q, card_c, size_q, size_c, i, j, k) -> Callable[[int], np.ndarray]:
    """U1-U3 scores of one column against all of the other table's, from the
    columns' features and the non-zero overlaps (i, j, k)."""
    order = np.argsort(i, kind="stable")
    i, j, k = i[order], j[order], k[order].astype(np.float64)
    start = np.searchsorted(i, np.arange(len(type_q) + 1))
    empty = size_c == 0

    def row(q: int) -> np.ndarray:
        at = slice(start[q], start[q + 1])
        jaccard = np.where(empty, 1.0 if size_q[q] == 0 else 0.0, 0.0)
        if size_q[q] > 0:
            jaccard[j[at]] = k[at] / (size_q[q] + size_c[j[at]] - k[at])
        score = JACCARD_WEIGHT * jaccard + CARDINALITY_WEIGHT * (1.0 - np.abs(card_q[q] - card_c))
        return np.where(type_c == type_q[q], score, 0.0)

    return row


def cosine_rows(eq: np.ndarray, ec: np.ndarray) -> Callable[[int], np.ndarray]:
    """E8 scores of one column against all of the other table's."""
    nq, nc = np.sqrt((eq * eq).sum(axis=1)), np.sqrt((ec * ec).sum(axis=1))
    usable = nc >= NORM_EPSILON

    def row(q: int) -> np.ndarray:
        if nq[q] < NORM_EPSILON:
            return np.zeros(len(ec))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(usable, np.clip(ec @ eq[q] / (nq[q] * nc), 0.0, 1.0), 0.0)

    return row
