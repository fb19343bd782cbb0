"""Alignment by auction against the exact kernel."""

import numpy as np
import pandas as pd
import pytest

from lakesift.operators import align
from lakesift.operators.auction import auction, cosine_rows, union_rows


def features(r, n, ties):
    card = r.random(n)
    return r.integers(0, 2, n), np.round(card, 1) if ties else card, r.integers(0, 40, n)


@pytest.mark.parametrize("n,m,ties", [(1, 1, False), (1, 5, True), (7, 7, True), (12, 30, True), (60, 90, False), (600, 900, False), (600, 900, True)])
def test_totals_equal_the_kernel(n, m, ties):
    r = np.random.default_rng(n + m)
    (tq, cq, sq), (tc, cc, sc) = features(r, n, ties), features(r, m, ties)
    i, j = np.nonzero((r.random((n, m)) < 0.05) & (tq[:, None] == tc[None]) & (sq[:, None] > 0) & (sc[None] > 0))
    k = np.minimum(np.minimum(sq[i], sc[j]), r.integers(1, 40, len(i)))
    dense = np.zeros((n, m))
    dense[i, j] = k
    matrix = align.union_matrix(tq, tc, cq, cc, sq, sc, dense)
    row = union_rows(tq, tc, cq, cc, sq, sc, i, j, k)
    assert np.allclose([row(x) for x in range(n)], matrix, atol=1e-15)
    total, column = auction(row, n, m)
    assert abs(total - align.max_assignment(matrix)[0]) < 1e-9
    assert len(set(column.tolist())) == n


def test_cosine_totals_equal_the_kernel():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, (80, 12)).astype(float), r.integers(0, 4, (130, 12)).astype(float)
    a[3] = 0
    b[5] = 0
    row, matrix = cosine_rows(a, b), align.cosine_matrix(a, b)
    assert np.allclose([row(x) for x in range(80)], matrix)
    assert abs(auction(row, 80, 130)[0] - align.max_assignment(matrix)[0]) < 1e-9


@pytest.mark.parametrize("self_pair", [False, True])
def test_wide_pairs_score_as_narrow_ones(monkeypatch, self_pair):
    r = np.random.default_rng(2)

    def table(n):
        t, card, size = features(r, n, True)
        return align.TableCols(pd.DataFrame({"col": range(n), "type_code": t, "card": card, "n_values": size, "emb": list(r.random((n, 6)))}))

    q = table(23)
    c = q if self_pair else table(14)
    i, j = np.nonzero(r.random((len(q), len(c))) < 0.3)
    if self_pair:
        i, j = i[i <= j], j[i <= j]
    good = (q.n_values[i] > 0) & (c.n_values[j] > 0)
    i, j = i[good], j[good]
    kk = pd.DataFrame({"col": i, "col2": j, "k": np.minimum(q.n_values[i], c.n_values[j])})
    want = align.score_one(0, 0 if self_pair else 1, q, c, kk, True)
    monkeypatch.setattr(align, "WIDE_CELLS", 10)
    got = align.score_one(0, 0 if self_pair else 1, q, c, kk, True)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
