"""Table pairs (J0) and the pair-symmetry helpers.

Every score is symmetric in (query, candidate), so the plan works on the
upper triangle ``q_idx <= c_idx`` and mirrors at the end: half the work,
the same output.  Pairs are unranked from a distributed range of numbers
whose output *is* the required result set (one row per pair): no list of tables
and no join makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.plans.util import maybe_broadcast


def upper_pairs(spark: SparkSession, n_tables: int, failed: list[int], cfg: ScoreConfig) -> DataFrame:
    """Unordered pairs ``(q_idx <= c_idx)`` of loaded tables that S4/S5 can use.

    An unordered pair {a, b} is needed when one of its two orientations passes
    the query prefix (S4: ``q < num_queries``) and the candidate cap (S5:
    ``c < max_candidates``, numbered over *all* listed files): these are the
    pairs with ``a < low`` and ``a <= b < high`` for the smaller and the larger
    of the two limits.  Their numbers 0, 1, ... in row order are a distributed
    range; each is turned into its pair by arithmetic, so no list of tables is
    in the plan but that of the tables that failed."""
    limits = [min(n_tables, x or n_tables) for x in (cfg.num_queries, cfg.max_candidates)]
    low, high = min(limits), max(limits)
    pairs = unranked(spark.range(low * high - low * (low - 1) // 2), high).drop("id")
    if failed:
        pairs = pairs.where(~F.col("q_idx").isin(failed) & ~F.col("c_idx").isin(failed))
    return pairs


def unranked(ids: DataFrame, high: int) -> DataFrame:
    """(id, q_idx, c_idx): pair number ``id`` of the pairs ``q <= c < high`` in row
    order.  Row q starts at q * high - q (q - 1) / 2; the root is a guess that is
    one off at most, and whole numbers put it right."""
    start = lambda q: f"({q} * {high}L - ({q} * ({q} - 1)) div 2)"
    root = f"sqrt({2 * high + 1}D * {2 * high + 1}D - 8D * id)"
    guess = ids.selectExpr("id", f"greatest(0L, cast(floor(({2 * high + 1}D - {root}) / 2) as bigint) - 1) as g")
    rows = guess.selectExpr("id", f"g + int({start('(g + 1)')} <= id) + int({start('(g + 2)')} <= id) as q")
    return rows.selectExpr("id", "cast(q as int) as q_idx", f"cast(id - {start('q')} + q as int) as c_idx")


def mirror(df: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """Ordered pairs from the upper triangle: add (c, q) for q < c, then apply S4/S5."""
    other = [c for c in df.columns if c not in ("q_idx", "c_idx")]
    one = F.struct(F.col("q_idx").alias("q"), F.col("c_idx").alias("c"))
    two = F.struct(F.col("c_idx").alias("q"), F.col("q_idx").alias("c"))
    turned = F.explode(F.when(F.col("q_idx") < F.col("c_idx"), F.array(one, two)).otherwise(F.array(one)))
    out = df.select(turned.alias("_pair"), *other).select(
        F.col("_pair.q").alias("q_idx"), F.col("_pair.c").alias("c_idx"), *other)
    if cfg.num_queries:
        out = out.where(F.col("q_idx") < cfg.num_queries)
    if cfg.max_candidates:
        out = out.where(F.col("c_idx") < cfg.max_candidates)
    return out


def with_names(df: DataFrame, tables: DataFrame, n_tables: int,
               limit_bytes: int = 64 << 20) -> DataFrame:
    """Attach ``query_table`` / ``candidate_table`` from the table dimension
    (``n_tables`` rows, broadcast under the size limit)."""
    names = maybe_broadcast(tables.select("table_idx", "table_name"), 128 * n_tables, limit_bytes)
    return (
        df.join(names.select(F.col("table_idx").alias("q_idx"), F.col("table_name").alias("query_table")), "q_idx")
        .join(names.select(F.col("table_idx").alias("c_idx"), F.col("table_name").alias("candidate_table")), "c_idx")
    )


def mirror_column_pairs(df: DataFrame) -> DataFrame:
    """Ordered column pairs from the upper form ``(q_idx, q_col) <= (c_idx, c_col)``."""
    other = [c for c in df.columns if c not in ("q_idx", "c_idx", "q_col", "c_col")]
    strict = (F.col("q_idx") < F.col("c_idx")) | (
        (F.col("q_idx") == F.col("c_idx")) & (F.col("q_col") < F.col("c_col")))
    swapped = df.where(strict).select(
        F.col("c_idx").alias("q_idx"), F.col("q_idx").alias("c_idx"),
        F.col("c_col").alias("q_col"), F.col("q_col").alias("c_col"), *other)
    return df.unionByName(swapped)
