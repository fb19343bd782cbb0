"""Dense text vectors learned from the lake itself.

Tokens that stand near one another in the lake's sample values, or under the
same column name, co-occur.  The counts come from plain aggregations and are
weighted by positive pointwise mutual information (PPMI).  The symmetric sparse
matrix of the weights is factorised by block power iteration: the matrix and the
basis are cut into blocks of tokens, a round is one join of matrix blocks with
basis blocks and a sum per row block, and only matrices of the factors' own size
(a few dozen squared) reach the driver, which orthonormalises through them.  A
token's vector is its row of the leading singular vectors, scaled by the roots of
the singular values; a text's vector is the sum of its tokens' vectors, rare
tokens weighing more.

Nothing grows in one task: windows make a bounded number of pairs for each
token, a block holds ``BLOCK_TOKENS`` tokens, and sums over an entity's tokens
are made in salted parts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.functions import text as tx
from lakesift.operators import semantic as sm
from lakesift.operators.profile import Profiles
from lakesift.plans.util import cut_lineage, ship_package

#: Tokens of a block, and parts of an entity's sum.
BLOCK_TOKENS = 8192
PARTS = 16


@dataclass(frozen=True)
class DenseConfig:
    """Distance of co-occurring tokens, least meetings of a token that gets a
    vector, length of the vectors, factors besides these in the iteration, the
    change of the singular values (against the largest) at which it ends, and its
    rounds at most; ``rare``: see :func:`text_vectors`."""

    window: int = 4
    min_count: int = 20
    dim: int = 48
    more: int = 8
    tolerance: float = 1e-3
    rounds: int = 8
    rare: float = 1e-3


# -- co-occurrence ------------------------------------------------------------------

def token_pairs(samples: DataFrame, columns: DataFrame, cfg: DenseConfig) -> DataFrame:
    """(a, b, n), a < b: how often two tokens co-occur: within ``window`` tokens of
    a sample value, or as a token of a column's values and one of its name."""
    toks = samples.select("table_idx", "col_idx", tx.tokens(F.col("value")).alias("t"))

    def at(distance: int):
        ends = F.size("t") - 1 - distance
        pair = lambda i: F.struct(F.get("t", i).alias("x"), F.get("t", i + distance).alias("y"))
        return F.when(ends >= 0, F.transform(F.sequence(F.lit(0), ends), pair)).otherwise(
            F.array().cast("array<struct<x:string,y:string>>"))

    near = toks.select(F.inline(F.concat(*(at(d) for d in range(1, cfg.window + 1)))))
    names = columns.select("table_idx", "col_idx", F.explode(F.array_distinct(tx.tokens(F.col("column_name")))).alias("y"))
    held = toks.select("table_idx", "col_idx", F.explode("t").alias("x")).groupBy("table_idx", "col_idx", "x").agg(F.count(F.lit(1)).alias("m"))
    named = held.join(names, ["table_idx", "col_idx"]).select("x", "y", "m")
    both = near.select("x", "y", F.lit(1).cast("long").alias("m")).unionByName(named).where("x != y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("m").alias("n"))


def ppmi(pairs: DataFrame, cfg: DenseConfig) -> DataFrame:
    """(a, b, w), both orders: ln(n_ab N / (n_a n_b)) where it is positive, of
    tokens that occur in ``min_count`` pairs; n_a and N are sums over these pairs."""
    both = pairs.unionByName(pairs.selectExpr("b a", "a b", "n"))
    often = both.groupBy("a").agg(F.sum("n").alias("s")).where(F.col("s") >= cfg.min_count).select("a")
    kept = both.join(often, "a").join(often.select(F.col("a").alias("b")), "b")
    sums = kept.groupBy("a").agg(F.sum("n").alias("na"))
    total = sums.agg(F.sum("na").alias("total"))
    weighed = kept.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").join(F.broadcast(total))
    w = F.log(F.col("n") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    return weighed.select("a", "b", w.alias("w")).where("w > 0")


# -- factorisation ------------------------------------------------------------------

def number_tokens(weights: DataFrame) -> tuple[DataFrame, int]:
    """(token, block, place): blocks by hash, places within a block by token."""
    tokens = cut_lineage(weights.select(F.col("a").alias("token")).distinct())
    n = tokens.count()
    blocks = max(1, -(-n // BLOCK_TOKENS))
    tokens = tokens.withColumn("block", F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("token")) - 1
    return cut_lineage(tokens.withColumn("place", place)), n


def matrix_blocks(weights: DataFrame, tokens: DataFrame) -> DataFrame:
    """(bi, bj, i, j, w): a block of the matrix in one row, as packed arrays."""
    side = lambda name, block, place: tokens.select(
        F.col("token").alias(name), F.col("block").alias(block), F.col("place").alias(place))
    numbered = weights.join(side("a", "bi", "i"), "a").join(side("b", "bj", "j"), "b").select("bi", "bj", "i", "j", "w")

    def pack(rows: pa.Table) -> pa.Table:
        i, j, w = (rows[c].to_numpy() for c in "ijw")
        order = np.lexsort((j, i))
        return pa.table({"bi": rows["bi"][:1], "bj": rows["bj"][:1], "i": [i[order].astype("<i4").tobytes()],
                         "j": [j[order].astype("<i4").tobytes()], "w": [w[order].tobytes()]},
                        schema=pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("i", pa.binary()), ("j", pa.binary()), ("w", pa.binary())]))

    return cut_lineage(numbered.groupBy("bi", "bj").applyInArrow(pack, "bi int, bj int, i binary, j binary, w binary"))


_BASIS = "block int, n int, q binary"


def start_basis(tokens: DataFrame, k: int) -> DataFrame:
    """Random columns, the same in every run."""
    def run(batches):
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = np.random.default_rng([7, block]).normal(size=(n, k))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "n": pa.array([n], pa.int32()), "q": [q.tobytes()]})

    return tokens.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("n")).mapInArrow(run, _BASIS)


def multiply(matrix: DataFrame, basis: DataFrame, m: np.ndarray) -> DataFrame:
    """The blocks of matrix times basis times the small matrix ``m``."""
    k = m.shape[0]

    def products(batches):
        for batch in batches:
            for r in batch.to_pylist():
                i, j, w = np.frombuffer(r["i"], "<i4"), np.frombuffer(r["j"], "<i4"), np.frombuffer(r["w"])
                q = np.frombuffer(r["q"]).reshape(-1, k)
                head = np.flatnonzero(np.diff(i, prepend=-1))
                part = np.add.reduceat(w[:, None] * q[j], head, axis=0)
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([r["bi"]], pa.int32()), "i": [i[head].tobytes()], "p": [part.tobytes()]})

    def added(rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        out = np.zeros((n, k))
        for i, p in zip(rows["i"].to_pylist(), rows["p"].to_pylist()):
            if i is not None:
                out[np.frombuffer(i, "<i4")] += np.frombuffer(p).reshape(-1, k)
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int32()), "q": [(out @ m).tobytes()]})

    parts = matrix.join(basis.select(F.col("block").alias("bj"), "q"), "bj").select("bi", "i", "j", "w", "q").mapInArrow(
        products, "block int, i binary, p binary")
    return basis.select("block", "n").join(parts, "block", "left").groupBy("block").applyInArrow(added, _BASIS)


def inner(left: DataFrame, right: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """left^T right and right^T right, k x k: summed over blocks, a row a task."""
    def run(batches):
        a, b = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[c]).reshape(-1, k) for c in "qr")
                a += x.T @ y
                b += y.T @ y
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]})

    both = left.select("block", "q").join(right.select("block", F.col("q").alias("r")), "block").select("q", "r")
    rows = both.mapInArrow(run, "a binary, b binary").collect()
    return tuple(sum((np.frombuffer(r[c]).reshape(k, k) for r in rows), np.zeros((k, k))) for c in "ab")


def turn(basis: DataFrame, m: np.ndarray) -> DataFrame:
    """The blocks of basis times a small matrix."""
    k = m.shape[0]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q"]).reshape(-1, k) @ m
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int32()), "n": pa.array([r["n"]], pa.int32()), "q": [q.tobytes()]})

    return basis.mapInArrow(run, _BASIS)


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Matrix that makes columns with this Gram matrix orthonormal; directions
    that vanish get no weight."""
    values, vectors = np.linalg.eigh(_even(gram))
    good = values > values.max(initial=0) * 1e-14
    scale = np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    return vectors * scale


def factorise(matrix: DataFrame, tokens: DataFrame, n: int, cfg: DenseConfig) -> tuple[DataFrame, np.ndarray]:
    """(blocks of the leading singular vectors, singular values) of the symmetric
    matrix, by subspace iteration with Rayleigh-Ritz values.  A round is a product
    and the small matrices that orthonormalise it within the next one."""
    k = min(n, cfg.dim + cfg.more)
    basis = cut_lineage(start_basis(tokens, k))
    m, before = _whitening(inner(basis, basis, k)[1]), None
    for number in range(cfg.rounds):
        image = cut_lineage(multiply(matrix, basis, m))
        across, gram = inner(basis, image, k)
        ritz, vectors = np.linalg.eigh(_even(m.T @ across))
        order = np.argsort(-np.abs(ritz), kind="stable")[: cfg.dim]
        values = np.abs(ritz[order])
        if number + 1 == cfg.rounds or before is not None and np.all(np.abs(values - before) <= cfg.tolerance * max(values[0], 1e-300)):
            break
        basis, m, before = image, _whitening(gram), values
    return turn(basis, m @ vectors[:, order]), values


def _even(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def token_vectors(weights: DataFrame, cfg: DenseConfig) -> DataFrame:
    """(token, vec): rows of the leading singular vectors, times the roots of the
    singular values."""
    ship_package(weights.sparkSession)
    weights = cut_lineage(weights)
    tokens, n = number_tokens(weights)
    if not n:
        return weights.sparkSession.createDataFrame([], "token string, vec array<double>")
    basis, values = factorise(matrix_blocks(weights, tokens), tokens, n, cfg)
    width, scale = len(values), np.sqrt(values)

    def run(batches):
        for batch in batches:
            for block, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = np.frombuffer(q).reshape(-1, width) * scale
                rows = pa.FixedSizeListArray.from_arrays(pa.array(q.reshape(-1)), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), block, np.int32)), pa.array(np.arange(len(q), dtype=np.int32)), rows], ["block", "place", "vec"])

    rows = basis.select("block", "q").mapInArrow(run, "block int, place int, vec array<double>")
    return tokens.join(rows, ["block", "place"]).select("token", "vec")


# -- texts --------------------------------------------------------------------------

def token_counts(df: DataFrame, keys: list[str], text: F.Column) -> DataFrame:
    return df.select(*keys, F.explode(tx.tokens(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def column_tokens(prof: Profiles, samples: DataFrame) -> DataFrame:
    """(table_idx, col_idx, token, n) of every column text."""
    keys = ["table_idx", "col_idx"]
    heads = token_counts(prof.columns, keys, sm.column_header(prof.columns))
    return heads.unionByName(token_counts(samples, keys, F.col("value"))).groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def table_tokens(tables: DataFrame, prof: Profiles, samples: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """(table_idx, token, n) of every table text."""
    columns = prof.columns.where(sm.in_table_text(cfg))
    named = tables.where(F.col("status") == "ok")
    heads = token_counts(columns, ["table_idx"], sm.table_column_header())
    values = samples.join(columns.select("table_idx", "col_idx"), ["table_idx", "col_idx"])
    parts = (token_counts(named, ["table_idx"], F.concat(F.lit("Table: "), F.col("table_name"))), heads,
             token_counts(values, ["table_idx"], F.col("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table_idx", "token").agg(F.sum("n").alias("n"))


def text_vectors(counts: DataFrame, keys: list[str], vectors: DataFrame, entities: DataFrame, cfg: DenseConfig) -> DataFrame:
    """(keys, vec array<float>, norm) of every entity from its token counts
    (keys, token, n): sums of the tokens' vectors, each times its count and
    ``rare / (rare + share of the token)``; entities without known tokens have
    the zero vector."""
    share = counts.groupBy("token").agg(F.sum("n").alias("s")).join(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    weight = F.lit(cfg.rare) / (F.lit(cfg.rare) + F.col("s") / F.col("all"))
    weighed = vectors.join(share.select("token", weight.alias("g")), "token")
    part = F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int").alias("part")
    rows = counts.join(weighed, "token").select(*keys, part, (F.col("n") * F.col("g")).alias("f"), "vec")

    def added(weights: str | None):
        def run(group: pa.Table) -> pa.Table:
            v = np.array(group["vec"].to_pylist(), np.float64)
            total = (v if weights is None else v * group[weights].to_numpy()[:, None]).sum(axis=0)
            return pa.table({**{c: group[c][:1] for c in keys}, "vec": pa.array([total.tolist()], pa.list_(pa.float64()))})
        return run

    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in keys) + ", vec array<double>"
    parts = rows.groupBy(*keys, "part").applyInArrow(added("f"), schema)
    sums = parts.groupBy(*keys).applyInArrow(added(None), schema)
    full = entities.select(*keys).join(sums, keys, "left").withColumn(
        "vec", F.transform(F.coalesce("vec", F.array_repeat(F.lit(0.0), cfg.dim)), lambda x: x.cast("float")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return full.withColumn("norm", norm)
