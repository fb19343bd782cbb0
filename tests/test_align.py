"""Alignment kernel (U5/E10) and matrix helpers - pure numpy."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesift.operators.align import cosine_matrix, max_assignment, union_matrix


def brute(a):
    a = np.asarray(a, dtype=float)
    n, m = a.shape
    if n > m:
        a = a.T
        n, m = m, n
    best = 0.0
    for cols in itertools.permutations(range(m), n):
        best = max(best, sum(a[i, c] for i, c in enumerate(cols)))
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.data())
def test_assignment_equals_brute_force(n, m, data):
    vals = data.draw(st.lists(st.floats(0, 1, allow_nan=False), min_size=n * m, max_size=n * m))
    a = np.array(vals).reshape(n, m)
    total, rows, cols = max_assignment(a)
    assert abs(total - brute(a)) < 1e-9
    assert len(rows) == min(n, m)
    assert len(set(rows.tolist())) == len(rows) and len(set(cols.tolist())) == len(cols)
    assert abs(a[rows, cols].sum() - total) < 1e-9


def test_greedy_is_not_optimal_2x3_and_3x2():
    # greedy takes 0.9 first and ends with 0.9 + 0.1; optimum is 0.8 + 0.8
    a = np.array([[0.9, 0.8, 0.0], [0.8, 0.1, 0.0]])
    assert abs(max_assignment(a)[0] - 1.6) < 1e-12
    assert abs(max_assignment(a.T)[0] - 1.6) < 1e-12


def test_assignment_at_least_greedy():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.random((5, 7))
        greedy, used = 0.0, set()
        for i in range(5):
            j = max((j for j in range(7) if j not in used), key=lambda j: a[i, j])
            used.add(j)
            greedy += a[i, j]
        assert max_assignment(a)[0] >= greedy - 1e-12


def test_empty_matrix():
    assert max_assignment(np.zeros((0, 3)))[0] == 0.0


def test_union_matrix_empty_set_rules_and_types():
    tq = np.array([1, 1, 0])
    tc = np.array([1, 0])
    card_q = np.array([0.0, 0.5, 0.2])
    card_c = np.array([0.0, 0.2])
    size_q = np.array([0, 4, 3])
    size_c = np.array([0, 3])
    k = np.zeros((3, 2))
    k[2, 1] = 3
    s = union_matrix(tq, tc, card_q, card_c, size_q, size_c, k)
    assert s[0, 0] == 1.0                        # both empty: Jaccard 1, card sim 1
    assert abs(s[1, 0] - 0.3 * 0.5) < 1e-12      # one empty: Jaccard 0
    assert s[0, 1] == 0.0 and s[1, 1] == 0.0     # type mismatch
    assert abs(s[2, 1] - 1.0) < 1e-12            # equal sets, equal cardinality


def test_cosine_guard_and_clamp():
    eq = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])
    ec = np.array([[-1.0, 0.0], [2.0, 0.0]])
    c = cosine_matrix(eq, ec)
    assert c[0, 0] == 0.0 and c[0, 1] == 0.0     # zero norm
    assert c[1, 0] == 0.0                        # opposite: clamped to 0
    assert abs(c[1, 1] - 1.0) < 1e-12            # equal direction
    assert 0.0 <= c.min() and c.max() <= 1.0


def test_block_kernel_self_pair_and_cross_pair():
    import pandas as pd

    from lakesift.operators.align import KIND_COLUMN, KIND_OVERLAP, KIND_PAIR, score_block_group

    def col(t, c, type_code, card, n, emb):
        return dict(kind=KIND_COLUMN, table_idx=t, q_idx=None, c_idx=None, col=c, col2=None,
                    type_code=type_code, card=card, n_values=n, k=None, gated=None, emb=emb)

    def pair(q, c, gated):
        return dict(kind=KIND_PAIR, table_idx=None, q_idx=q, c_idx=c, col=None, col2=None,
                    type_code=None, card=None, n_values=None, k=None, gated=gated, emb=None)

    def ov(q, c, i, j, k):
        return dict(kind=KIND_OVERLAP, table_idx=None, q_idx=q, c_idx=c, col=i, col2=j,
                    type_code=None, card=None, n_values=None, k=k, gated=None, emb=None)

    rows = [col(0, 0, 1, 0.5, 4, [1.0, 0.0]), col(0, 1, 0, 0.2, 3, [0.0, 1.0]),
            col(1, 0, 1, 0.5, 4, [1.0, 1.0]),
            pair(0, 0, True), pair(0, 1, False),
            ov(0, 0, 0, 0, 4), ov(0, 0, 1, 1, 3), ov(0, 1, 0, 0, 2)]
    out = score_block_group(pd.DataFrame(rows)).set_index(["q_idx", "c_idx"])
    self_pair = out.loc[(0, 0)]
    assert abs(self_pair.unionability - 1.0) < 1e-12
    assert abs(self_pair.semantic_union - 1.0) < 1e-12 and abs(self_pair.semantic_join - 1.0) < 1e-12
    cross = out.loc[(0, 1)]
    # best: col 0 <-> col 0, Jaccard 2 / 6, card sim 1; coverage 1/2
    assert abs(cross.unionability - (0.7 * (2 / 6) + 0.3) * 0.5) < 1e-12
    assert cross.semantic_join == 0.0 and cross.semantic_union == 0.0   # not gated
