"""Optimal one-to-one column alignment (U5, E10) as a grouped Spark job.

The per-pair matrices are small (columns of two tables) but there are many
pairs, so the work is parallel over pairs.  Pairs are grouped in blocks: a
group holds the column rows of two blocks of tables (each sent once per
block pair, not once per table pair), the pairs to score and their non-zero
overlap counts.  Dense matrices are built inside the task - no column cross
product is materialised by Spark - and solved by an exact maximum-weight
assignment in numpy (shortest augmenting paths with dual potentials,
O(n^2 m)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lakesift.config import CARDINALITY_WEIGHT, JACCARD_WEIGHT, NORM_EPSILON
from lakesift.operators.auction import auction, cosine_rows, union_rows


def max_assignment(score: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Maximum-weight assignment of a rectangular matrix.

    Returns (total, rows, cols) with ``min(n, m)`` assigned cells.  The total
    is unique even when the optimal assignment is not.
    """
    a = np.asarray(score, dtype=np.float64)
    if a.ndim != 2 or a.size == 0:
        return 0.0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    transposed = a.shape[0] > a.shape[1]
    if transposed:
        a = a.T
    n, m = a.shape
    # Fast path: if the row maxima sit in distinct columns, the sum of row
    # maxima is an upper bound that is attained.
    best = a.argmax(axis=1)
    if np.unique(best).size == n:
        rows, cols = np.arange(n), best
    else:
        rows, cols = _shortest_augmenting_path(-a)
    total = float(a[rows, cols].sum())
    if transposed:
        rows, cols = cols, rows
    order = np.argsort(rows, kind="stable")
    return total, rows[order], cols[order]


def _shortest_augmenting_path(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost assignment of every row of ``cost`` (n <= m)."""
    n, m = cost.shape
    inf = np.inf
    u = np.zeros(n + 1)
    v = np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=np.int64)  # owner[j] = 1-based row on column j, 0 = free
    way = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        minv = np.full(m + 1, inf)
        used = np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used
            free[0] = False
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free[1:] & (reduced < minv[1:])
            minv[1:][better] = reduced[better]
            way[1:][better] = j0
            cand = np.where(free[1:], minv[1:], inf)
            j1 = int(np.argmin(cand)) + 1
            delta = cand[j1 - 1]
            idx = np.nonzero(used)[0]
            u[owner[idx]] += delta
            v[idx] -= delta
            minv[free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    cols = np.nonzero(owner[1:])[0]
    rows = owner[1:][cols] - 1
    return rows, cols


def jaccard_matrix(size_q, size_c, k) -> np.ndarray:
    """U1 from set sizes and the dense intersection sizes."""
    sq = size_q[:, None].astype(np.float64)
    sc = size_c[None, :].astype(np.float64)
    union = sq + sc - k
    with np.errstate(divide="ignore", invalid="ignore"):
        jac = np.where(union > 0, k / np.where(union > 0, union, 1.0), 0.0)
    return np.where((sq == 0) & (sc == 0), 1.0, np.where((sq == 0) | (sc == 0), 0.0, jac))


def union_matrix(type_q, type_c, card_q, card_c, size_q, size_c, k) -> np.ndarray:
    """U1-U3 for all column pairs of one table pair.

    ``k`` is the dense intersection-size matrix; Jaccard of two empty sets is
    1.0 and of one empty set 0.0; type mismatch scores 0.0."""
    jac = jaccard_matrix(size_q, size_c, k)
    card_sim = 1.0 - np.abs(card_q[:, None] - card_c[None, :])
    score = JACCARD_WEIGHT * jac + CARDINALITY_WEIGHT * card_sim
    return np.where(type_q[:, None] == type_c[None, :], score, 0.0)


def cosine_matrix(eq: np.ndarray, ec: np.ndarray) -> np.ndarray:
    """Clamped cosine of every row of ``eq`` with every row of ``ec``."""
    nq = np.sqrt((eq * eq).sum(axis=1))
    nc = np.sqrt((ec * ec).sum(axis=1))
    dot = eq @ ec.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = dot / (nq[:, None] * nc[None, :])
    ok = (nq[:, None] >= NORM_EPSILON) & (nc[None, :] >= NORM_EPSILON)
    return np.where(ok, np.clip(cos, 0.0, 1.0), 0.0)


PAIR_SCORE_SCHEMA = ("q_idx int, c_idx int, n_q int, n_c int, union_total double, "
                     "unionability double, semantic_join double, semantic_union double")


class TableCols:
    """One table's columns as arrays, built once per group and reused by every
    pair the table takes part in."""

    __slots__ = ("cols", "type_code", "card", "n_values", "emb")

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("col")
        self.cols = rows["col"].to_numpy(dtype=np.int64)
        self.type_code = rows["type_code"].to_numpy()
        self.card = rows["card"].to_numpy(dtype=np.float64)
        self.n_values = rows["n_values"].to_numpy()
        self.emb = None
        if "emb" in rows.columns and len(rows):
            e = rows["emb"].to_numpy()
            width = next((len(x) for x in e if x is not None), 0)
            if width:  # a column without a vector has cosine 0 with all others
                self.emb = np.stack([np.zeros(width) if x is None else np.asarray(x, dtype=np.float64) for x in e])

    def __len__(self) -> int:
        return len(self.cols)


def score_one(q_idx: int, c_idx: int, tq: TableCols, tc: TableCols,
              kk: pd.DataFrame | None, semantic: bool) -> dict:
    """U1-U8 and E8-E10 for one table pair.

    ``tq`` / ``tc``: the columns of the two tables; ``kk``: their non-zero
    overlaps (``col`` of the query table, ``col2`` of the candidate, ``k``).
    For a self pair only ``col <= col2`` overlaps are given; the matrix is
    mirrored."""
    n_q, n_c = len(tq), len(tc)
    out = dict(q_idx=q_idx, c_idx=c_idx, n_q=n_q, n_c=n_c, union_total=0.0,
               unionability=0.0, semantic_join=0.0, semantic_union=0.0)
    if n_q == 0 or n_c == 0:
        return out
    if n_q * n_c > WIDE_CELLS:
        return out | score_wide(q_idx, c_idx, tq, tc, kk, semantic)
    k = np.zeros((n_q, n_c))
    if kk is not None and len(kk):
        # positions are 0..n-1, in the order of the rows
        ii, jj = kk["col"].to_numpy(dtype=np.int64), kk["col2"].to_numpy(dtype=np.int64)
        kv = kk["k"].to_numpy(dtype=np.float64)
        k[ii, jj] = kv
        if q_idx == c_idx:
            k[jj, ii] = kv
    s = union_matrix(tq.type_code, tc.type_code, tq.card, tc.card, tq.n_values, tc.n_values, k)
    total, _, _ = max_assignment(s)
    lo, hi = min(n_q, n_c), max(n_q, n_c)
    out["union_total"] = total
    # U6 x U7: mean aligned similarity times coverage
    out["unionability"] = (total / lo) * (lo / hi)
    if semantic and tq.emb is not None and tc.emb is not None:
        sem = cosine_matrix(tq.emb, tc.emb)
        out["semantic_join"] = float(sem.max())
        stotal, _, _ = max_assignment(sem)
        out["semantic_union"] = stotal / lo
    return out


#: Scores of a pair that are held as a matrix; a wider pair is scored row by row.
WIDE_CELLS = 1 << 20


def score_wide(q_idx: int, c_idx: int, tq: TableCols, tc: TableCols, kk: pd.DataFrame | None, semantic: bool) -> dict:
    """:func:`score_one` without matrices: alignments by auction, scores row by row."""
    n_q, n_c = len(tq), len(tc)
    lo, hi = min(n_q, n_c), max(n_q, n_c)
    i = j = k = np.zeros(0, np.int64)
    if kk is not None and len(kk):
        i, j, k = (kk[c].to_numpy(dtype=np.int64) for c in ("col", "col2", "k"))
        if q_idx == c_idx:
            off = i != j
            i, j, k = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([k, k[off]])
    a, b = (tq, tc) if n_q <= n_c else (tc, tq)
    if n_q > n_c:
        i, j = j, i
    total, _ = auction(union_rows(a.type_code, b.type_code, a.card, b.card, a.n_values, b.n_values, i, j, k), lo, hi)
    out = dict(union_total=total, unionability=(total / lo) * (lo / hi))
    if semantic and tq.emb is not None and tc.emb is not None:
        row = cosine_rows(a.emb, b.emb)
        out["semantic_join"] = float(max(row(x).max() for x in range(lo)))
        out["semantic_union"] = auction(row, lo, hi)[0] / lo
    return out


# Row kinds of a block group.
KIND_COLUMN, KIND_PAIR, KIND_OVERLAP = 0, 2, 3


def block_pairs(pdf: pd.DataFrame):
    """(q, c, columns of q, columns of c, overlaps, gated) of each table pair of a
    block pair (tables ``bq*B .. bq*B+B-1`` x ``bc*B ..``).

    Rows: ``kind`` 0 = a column of a table of either block (sent once per
    block pair, with its embedding when a pair of the block passes the gate),
    2 = a table pair of the block to score (``gated``), 3 = a non-zero overlap.
    Each table's columns travel once per block pair instead of once per
    table pair."""
    kind = pdf["kind"].to_numpy()
    cols = pdf[kind == KIND_COLUMN]
    tables = {int(t): TableCols(g) for t, g in cols.groupby("table_idx")}
    ov = pdf[kind == KIND_OVERLAP]
    overlaps = {(int(q), int(c)): g for (q, c), g in ov.groupby(["q_idx", "c_idx"])} if len(ov) else {}
    empty = TableCols(cols.iloc[0:0])
    for q, c, gated in pdf.loc[kind == KIND_PAIR, ["q_idx", "c_idx", "gated"]].itertuples(index=False):
        q, c = int(q), int(c)
        yield q, c, tables.get(q, empty), tables.get(c, empty), overlaps.get((q, c)), bool(gated)


def score_block_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kernel for one block pair: U1-U8 and E8-E10 of its table pairs."""
    out = [score_one(*pair) for pair in block_pairs(pdf)]
    return pd.DataFrame(out, columns=[f.split()[0] for f in PAIR_SCORE_SCHEMA.split(", ")])


#: Scores of a packed row.
PACKED_CELLS = 1 << 17
PACKED_SCHEMA = "q_idx int, c_idx int, n_c int, start int, cells binary"


def pack_matrices(kind: str):
    """Kernel for one block pair that gives its column matrices (U4, E8) packed:
    whole rows of a matrix in one value, ``PACKED_CELLS`` scores about.  ``kind``:
    ``jaccard`` (NaN where types differ), ``union`` or ``cosine`` (of pairs that
    pass the gate)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, c, tq, tc, kk, gated in block_pairs(pdf):
            n_q, n_c = len(tq), len(tc)
            if not n_q or not n_c or (kind == "cosine" and not (gated and tq.emb is not None and tc.emb is not None)):
                continue
            step = max(1, PACKED_CELLS // n_c)
            for start in range(0, n_q, step):
                part = slice(start, min(n_q, start + step))
                if kind == "cosine":
                    cells = cosine_matrix(tq.emb[part], tc.emb)
                else:
                    k = _dense_overlap(kk, part, n_c, q == c)
                    if kind == "jaccard":
                        same = tq.type_code[part][:, None] == tc.type_code[None, :]
                        cells = np.where(same, jaccard_matrix(tq.n_values[part], tc.n_values, k), np.nan)
                    else:
                        cells = union_matrix(tq.type_code[part], tc.type_code, tq.card[part], tc.card, tq.n_values[part], tc.n_values, k)
                out.append((q, c, n_c, start, cells.astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PACKED_SCHEMA.split(", ")])

    return pack


def _dense_overlap(kk: pd.DataFrame | None, part: slice, n_c: int, self_pair: bool) -> np.ndarray:
    """Intersection sizes of some rows of a pair."""
    k = np.zeros((part.stop - part.start, n_c))
    if kk is not None and len(kk):
        i, j, n = (kk[c].to_numpy(dtype=np.int64) for c in ("col", "col2", "k"))
        if self_pair:
            i, j, n = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([n, n])
        here = (i >= part.start) & (i < part.stop)
        k[i[here] - part.start, j[here]] = n[here]
    return k


def expand_matrices(packed: DataFrame) -> DataFrame:
    """(q_idx, c_idx, q_col, c_col, score) of both orders of every pair; NaN cells
    give no row."""

    def run(batches):
        for batch in batches:
            for q, c, n_c, start, cells in zip(*(col.to_pylist() for col in batch.columns)):
                score = np.frombuffer(cells, "<f8")
                at = np.flatnonzero(~np.isnan(score)).astype(np.int32)
                i, j = start + at // n_c, at % n_c
                for x, y, a, b in ((q, c, i, j), (c, q, j, i))[: 1 if q == c else 2]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), x, np.int32)), pa.array(np.full(len(at), y, np.int32)),
                         pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(score[at])],
                        ["q_idx", "c_idx", "q_col", "c_col", "score"])

    return packed.mapInArrow(run, "q_idx int, c_idx int, q_col int, c_col int, score double")
