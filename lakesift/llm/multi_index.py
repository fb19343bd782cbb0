"""Hard negatives by exact search in an inverted multi-index.

Vectors are cut in two halves.  A codebook of centroids for each half is fitted
on a bounded sample; every row is then put in the cell of its two nearest
centroids, and each centroid gets its radius, the largest distance of a row's
half to it.  For an anchor, the inner product with any row of a cell is at most
the sum of two half bounds (product with the centroid, plus the anchor's norm
times the radius).  A multi-sequence heap gives the cells in the order of these
sums without making all of them.

A search asks for the best rows of score windows: the positives of an anchor
are the best rows of its label in an open window, the negatives the best rows
of other labels below and above shares of each positive's score.  It goes in
rounds: each anchor takes cells from its heap, more in each round, and leaves
out cells whose lower bound lies above its windows; cells meet their anchors in
a cogroup by shard (a bounded range of cells; a cell of many rows has several
shards, and a shard that many anchors ask for is dealt out in copies).  An
anchor stops when all its windows are certified: the next cell's bound is below
the window, or below the last of the rows found.  So results are exact; the
sample only decides how early the search stops.

Arithmetic: components are floored integers and scores exact integers (float64
products while they stay below 2**53, else Python integers; a score that does
not fit a long is an error).  Bounds carry a slack above rounding errors.

Edge cases: rows with a null label, a null vector or a null or non-finite
component take no part; a shorter vector counts as filled up with zeros;
repeated rows are rows of their own, and an anchor is never its own positive;
a null id is never an anchor and comes last in ties; anchors without positives
give no rows; an empty window gives none; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import on_workers, small_side, staged

#: Rows that the codebooks are fitted on, at most (the smallest by hash).
SAMPLE = 20_000
#: Rows of a cell, about, and centroids of a half at most.
CELL_ROWS = 200
MAX_CODES = 512
#: Rows of a shard, and anchors that a shard's copy serves, about.
SHARD_ROWS = 1 << 14
SHARD_ANCHORS = 1 << 11
#: Rows that an anchor's first round reads, and the growth of the next.
FIRST_ROWS = 1 << 13
GROWTH = 16
#: Scores that a worker holds at once.
BLOCK_SCORES = 1 << 21
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Mining:
    """Anchors are the ids divisible by ``every``; each of an anchor's first
    ``positives`` rows of its label gets the first ``negatives`` rows of other
    labels with scores from ``low_pct`` to ``high_pct`` per cent of its own.
    Ids divisible by ``shift_every`` move to the next of ``labels`` labels."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low_pct: int = 30
    high_pct: int = 90
    scale: int = 256
    shift_every: int = 7
    labels: int = 10


# --- codebooks and bounds ---------------------------------------------------------

def fit_codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread rows; never empty for a non-empty ``x``."""
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the distance to it."""
    at = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(axis=1))


def half_bounds(q: np.ndarray, codes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of ``q`` with the rows of each centroid."""
    norm = np.sqrt(q @ q)
    middle, reach = codes @ q, norm * radius
    slack = 1e-9 * (norm * (np.sqrt((codes * codes).sum(axis=1)) + radius) + 1)
    return middle - reach - slack, middle + reach + slack


def multi_sequence(a: np.ndarray, b: np.ndarray):
    """(a[i] + b[j], i, j) in descending order of the sums, from a heap: the next
    in j follows each pair, the next in i those with the first j only."""
    ia, ib = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = [float(a[i]) for i in ia], [float(b[j]) for j in ib]
    heap = [(-(a[0] + b[0]), 0, 0)] if a and b else []
    while heap:
        s, i, j = heappop(heap)
        yield -s, ia[i], ib[j]
        if j + 1 < len(b):
            heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, n in enumerate(sizes):
        out[i, :n] = values[at[i] - at[0]: at[i] - at[0] + n]
    return out


def products(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(r.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ r.astype(object).T
    if exact.size and (exact.min() < LOW or exact.max() > HIGH):
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


# --- index ------------------------------------------------------------------------

def clean_rows(vectors: DataFrame, mining: Mining, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """row (a number of its own), id, label, v (floored integers) of all rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fit = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False)))
    label, key = F.col(label_col).cast("long"), F.col(id_col)
    moved = F.when(key % mining.shift_every == 0, (label + 1) % mining.labels).otherwise(label)
    return vectors.where(fit).select(
        F.monotonically_increasing_id().alias("row"), key.cast("long").alias("id"), moved.alias("label"),
        F.transform(x, lambda e: F.floor(e * mining.scale)).alias("v"))


@dataclass
class Cells:
    """Centroids and radii of both halves, and the cells' rows and shards."""

    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray   # rows of a cell
    first: np.ndarray   # first shard of a cell
    pieces: np.ndarray  # shards of a cell


@dataclass
class Index:
    """``rows`` with their cell and shard, and what the anchors' heaps need."""

    rows: DataFrame
    cells: Cells


def build_index(rows: DataFrame) -> Index:
    """Fit the codebooks, assign every row, deal cells to shards."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(2, width or 0)
    half, k = width // 2, int(np.clip(np.sqrt(n / CELL_ROWS), 2, MAX_CODES))
    picked = rows.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    sample = matrix(picked["v"], width).astype(np.float64) if n else np.zeros((1, width))
    codes = fit_codebook(sample[:, :half], k), fit_codebook(sample[:, half:], k)
    wide = len(codes[1])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(3), width).astype(np.float64)
                (a, da), (b, db) = nearest(x[:, :half], codes[0]), nearest(x[:, half:], codes[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(a * wide + b), pa.array(da), pa.array(db)], ["row", "id", "label", "v", "cell", "da", "db"])

    rows = staged(rows.mapInArrow(assign, "row bigint, id bigint, label bigint, v array<bigint>, cell bigint, da double, db double"), "cells")
    # a row for each cell: MAX_CODES ** 2 at most
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("da").alias("da"), F.max("db").alias("db")).collect()
    cells = np.zeros(len(codes[0]) * wide, np.int64)
    radii = np.zeros(len(codes[0])), np.zeros(wide)
    for r in stats:
        cells[r["cell"]] = r["n"]
        a, b = divmod(r["cell"], wide)
        radii[0][a], radii[1][b] = max(radii[0][a], r["da"]), max(radii[1][b], r["db"])
    pieces = np.maximum(1, -(-cells // SHARD_ROWS))
    first, shard, size = np.zeros(len(cells), np.int64), 0, 0
    for c in range(len(cells)):
        if size and (size + cells[c] > SHARD_ROWS):
            shard, size = shard + 1, 0
        first[c] = shard
        size += cells[c]
        if pieces[c] > 1:
            shard, size = shard + int(pieces[c]), 0
    dealt = [(c, int(first[c]), int(pieces[c])) for c in np.flatnonzero(cells).tolist()]
    dealt = rows.sparkSession.createDataFrame(dealt, "cell bigint, first bigint, pieces bigint")
    rows = rows.join(F.broadcast(dealt), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")))
    return Index(rows.select("shard", "cell", "row", "id", "label", "v"), Cells(width, codes, radii, cells, first, pieces))


# --- search -----------------------------------------------------------------------

_VISIT = "row bigint, id bigint, label bigint, v array<bigint>, lows array<bigint>, highs array<bigint>, lasts array<bigint>, " \
         "at bigint, shard bigint, cells array<bigint>"


def visits(anchors: DataFrame, index: Cells, budget: int) -> DataFrame:
    """(shard, anchor, cells) of the next cells of each anchor, ``budget`` rows or
    more; ``at`` counts the cells that its heap has given so far.  An anchor whose
    windows are all certified gives no rows."""
    width, half, wide = index.width, index.width // 2, len(index.codes[1])

    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("i", "at", "shard", "cells")}
            for i, (v, lows, highs, lasts, at) in enumerate(zip(
                    matrix(batch.column(3), width).astype(np.float64), *(batch.column(j).to_pylist() for j in range(4, 8)))):
                floor, ceiling = min(map(max, lows, lasts)), max(highs)
                (la, ua), (lb, ub) = (half_bounds(q, c, r) for q, c, r in zip((v[:half], v[half:]), index.codes, index.radii))
                found, seen, rows = {}, 0, 0
                for bound, a, b in multi_sequence(ua, ub):
                    if bound < floor or rows >= budget:
                        break
                    seen += 1
                    cell = a * wide + b
                    if seen <= at or not index.cells[cell] or la[a] + lb[b] > ceiling:
                        continue
                    rows += int(index.cells[cell])
                    for shard in range(index.first[cell], index.first[cell] + index.pieces[cell]):
                        found.setdefault(shard, []).append(cell)
                for shard, cells in found.items():
                    out["i"].append(i)
                    out["at"].append(seen)
                    out["shard"].append(shard)
                    out["cells"].append(cells)
            if out["i"]:
                own = [batch.column(j).take(pa.array(out["i"])) for j in range(7)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(out["at"], pa.int64()), pa.array(out["shard"], pa.int64()), pa.array(out["cells"], pa.list_(pa.int64()))],
                    ["row", "id", "label", "v", "lows", "highs", "lasts", "at", "shard", "cells"])

    names = ("row", "id", "label", "v", "lows", "highs", "lasts", "at")
    return anchors.select(*names).mapInArrow(run, _VISIT)


def _best_of(width: int, k: int, same: bool):
    """Cogroup of the anchors and the rows of a shard: the ``k`` best rows of
    each window among the cells that the anchor visits."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = {"anchor": pa.int64(), "w": pa.int32(), "score": pa.int64(), "id": pa.int64(), "row": pa.int64()}
        nothing = pa.table({n: pa.array([], t) for n, t in names.items()})
        if not len(asked) or not len(rows):
            return nothing
        rows = rows.sort_by("cell")
        cell, label, number = (rows[c].to_numpy() for c in ("cell", "label", "row"))
        ids = rows["id"].combine_chunks()
        key, unnamed = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        r, a = matrix(rows["v"], width), matrix(asked["v"], width)
        own, own_label = asked["row"].to_numpy(), asked["label"].to_numpy()
        # windows that an anchor doesn't have are empty
        n_windows = max(len(x) for x in asked["lows"].to_pylist())
        filled = lambda c, v: np.array([[*x, *[v] * (n_windows - len(x))] for x in asked[c].to_pylist()], np.int64)
        low, high = np.maximum(filled("lows", HIGH), filled("lasts", LOW)), filled("highs", LOW)
        wants: dict[int, list[int]] = {}
        for i, cells in enumerate(asked["cells"].to_pylist()):
            for c in cells:
                wants.setdefault(c, []).append(i)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        spans = {int(cell[s]): (int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(cell)])}
        held: list[tuple] = []

        def reduced():
            """The best of each window; windows with enough rows ask for no less."""
            i, w, score, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number[at], key[at], unnamed[at], np.invert(score), w, i))
            i, w, score, at = i[order], w[order], score[order], at[order]
            group = i * n_windows + w
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(group)) - np.repeat(head, np.diff([*head, len(group)]))
            full = place == k - 1
            low[i[full], w[full]] = np.maximum(low[i[full], w[full]], score[full])
            keep = place < k
            return i[keep], w[keep], score[keep], at[keep]

        for c, who in wants.items():
            if c not in spans:
                continue
            s, e = spans[c]
            step = max(1, BLOCK_SCORES // (e - s))
            for j in range(0, len(who), step):
                some = np.array(who[j: j + step])
                score = products(a[some], r[s:e])
                good = (label[None, s:e] == own_label[some][:, None]) == same
                if same:
                    good &= number[None, s:e] != own[some][:, None]
                size = 0
                for w in range(n_windows):
                    i, at = np.nonzero(good & (score >= low[some, w][:, None]) & (score <= high[some, w][:, None]))
                    if len(i):
                        held.append((some[i], np.full(len(i), w), score[i, at], at + s))
                        size += len(i)
                if size:
                    held = [reduced()]
        if not held:
            return nothing
        i, w, score, at = held[0]
        return pa.table({"anchor": pa.array(own[i]), "w": pa.array(w.astype(np.int32)), "score": pa.array(score),
                         "id": ids.take(pa.array(at)), "row": pa.array(number[at])})

    return run


def search(anchors: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(anchor, w, score, id, row, rank): the ``k`` best rows of the windows ``w``
    (``lows[w]`` to ``highs[w]``) of each anchor, of its label (``same``) or of others."""
    best = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    state = anchors.withColumns({"at": F.lit(0).cast("long"), "lasts": F.transform("lows", lambda x: F.lit(LOW))})
    found, budget = None, FIRST_ROWS
    while True:
        asked = staged(visits(state, index.cells, budget), "visits")
        loads = staged(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ANCHORS).cast("long").alias("copies")), "loads")
        n_loads, n_copies = loads.agg(F.count(F.lit(1)), F.sum("copies")).first()
        if not n_loads:
            break
        copied = loads.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        left = asked.join(small_side(loads, n_loads, 16), "shard").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")))
        right = index.rows.join(small_side(copied, n_copies, 16), "shard")
        got = left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInArrow(
            _best_of(index.cells.width, k, same), "anchor bigint, w int, score bigint, id bigint, row bigint")
        all_ = got if found is None else got.unionByName(found.drop("rank"))
        found = staged(all_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        # each window's last row bounds what the next round asks for
        last = found.where(F.col("rank") == k).groupBy(F.col("anchor").alias("row")).agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
        seen = asked.groupBy("row").agg(F.max("at").alias("seen"))
        state = state.join(seen, "row").join(last, "row", "left").select(
            *[c for c in state.columns if c not in ("at", "lasts")], F.col("seen").alias("at"),
            F.transform("lows", lambda x, i: F.coalesce(F.element_at("full", i), F.lit(LOW))).alias("lasts"))
        state = staged(state, "state")
        budget *= GROWTH
    if found is None:
        return anchors.sparkSession.createDataFrame([], "anchor bigint, w int, score bigint, id bigint, row bigint, rank int")
    return found


def hard_negatives(
    vectors: DataFrame, mining: Mining = Mining(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    on_workers(vectors.sparkSession)
    rows = staged(clean_rows(vectors, mining, id_col, vec_col, label_col), "vectors")
    index = build_index(rows)
    anchors = rows.where(F.col("id") % mining.every == 0)
    open_ = lambda x: F.array(F.lit(x).cast("long"))
    positives = search(anchors.withColumns({"lows": open_(LOW), "highs": open_(HIGH)}), index, mining.positives, True)
    positives = positives.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # whole scores from low_pct to high_pct per cent: floors by quotient and rest
    floor = lambda s, pct: f"({s} - pmod({s}, 100)) div 100 * {pct} + (pmod({s}, 100) * {pct}) div 100"
    part = lambda pct, up: f"transform(scores, s -> {'-(' + floor('(-s)', pct) + ')' if up else floor('s', pct)})"
    windows = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    windows = windows.withColumn("scores", F.col("p.positive_score")).withColumns(
        {"lows": F.expr(part(mining.low_pct, True)), "highs": F.expr(part(mining.high_pct, False))})
    asked = anchors.join(windows.select("row", "lows", "highs"), "row")
    found = search(staged(asked, "anchors"), index, mining.negatives, False)
    out = found.join(positives, ["anchor", "w"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
