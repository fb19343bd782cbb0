"""Value overlap (J2) and joinability.

J2 is an inverted-index self equi-join of the top-k value sets on
``(inferred_type, value)``: only column pairs that share a value meet, so the
column cross product is never formed.  The one intersection table serves
both joinability (after the F2/F3 eligibility filter) and the Jaccard part of
unionability.

Skew: a value such as ``0`` or ``1`` can sit in a large share of all
columns.  Its posting list is split into ``S`` salt slices on each side; the
pair (a, b) meets only in task ``(slice(a), slice(b))``, so the |P|^2 pair
work of a hot value is spread over S^2 tasks and every pair is still counted
exactly once.  Counts are partially aggregated before the pair shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.operators.profile import Profiles
from lakesift.plans.util import maybe_broadcast


def hot_values(values: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """Values shared by more than ``hot_value_postings`` columns.

    Their number is at most (columns x top_k) / hot_value_postings, which
    bounds the broadcast below."""
    return (values.groupBy("inferred_type", "value").agg(F.count(F.lit(1)).alias("postings"))
            .where(F.col("postings") > cfg.hot_value_postings)
            .select("inferred_type", "value", F.lit(True).alias("hot")))


def value_overlap(prof: Profiles, n_columns: int, cfg: ScoreConfig) -> DataFrame:
    """``(q_idx, c_idx, q_col, c_col, k)`` with k = |A ∩ B| > 0, for every
    same-type column pair with ``(q_idx, q_col) <= (c_idx, c_col)``."""
    vals = prof.values.select("table_idx", "col_idx", "inferred_type", "value")
    s = max(1, int(cfg.value_salt_buckets))
    if s > 1:
        max_hot = max(1, n_columns * cfg.top_k // max(1, cfg.hot_value_postings))
        hot = maybe_broadcast(hot_values(vals, cfg), 64 * max_hot, cfg.broadcast_limit_bytes)
        vals = vals.join(hot, ["inferred_type", "value"], "left")
        is_hot = F.coalesce(F.col("hot"), F.lit(False))
        own = F.when(is_hot, F.pmod(F.hash("table_idx", "col_idx"), F.lit(s))).otherwise(F.lit(0))
        fan = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(s - 1))).otherwise(F.array(F.lit(0))))
        left = vals.select(F.col("table_idx").alias("q_idx"), F.col("col_idx").alias("q_col"),
                           "inferred_type", "value", own.alias("salt_q"), fan.alias("salt_c"))
        right = vals.select(F.col("table_idx").alias("c_idx"), F.col("col_idx").alias("c_col"),
                            "inferred_type", "value", fan.alias("salt_q"), own.alias("salt_c"))
        keys = ["inferred_type", "value", "salt_q", "salt_c"]
    else:
        left = vals.select(F.col("table_idx").alias("q_idx"), F.col("col_idx").alias("q_col"),
                           "inferred_type", "value")
        right = vals.select(F.col("table_idx").alias("c_idx"), F.col("col_idx").alias("c_col"),
                            "inferred_type", "value")
        keys = ["inferred_type", "value"]
    upper = (F.col("q_idx") < F.col("c_idx")) | (
        (F.col("q_idx") == F.col("c_idx")) & (F.col("q_col") <= F.col("c_col")))
    return (left.join(right, keys).where(upper)
            .groupBy("q_idx", "c_idx", "q_col", "c_col")
            .agg(F.count(F.lit(1)).alias("k")))


def join_eligible(prof: Profiles, cfg: ScoreConfig) -> DataFrame:
    """F2 + F3: columns a join may use, with their value-set size."""
    p = prof.columns
    high_card_numeric = (F.col("inferred_type") == "numeric") & (
        F.col("cardinality_ratio") > cfg.numeric_cardinality_cutoff)
    return p.where(~high_card_numeric & (F.col("n_values") > 0)).select(
        "table_idx", "col_idx", "n_values")


def column_containment(overlap: DataFrame, prof: Profiles, n_columns: int,
                       cfg: ScoreConfig) -> DataFrame:
    """J3/J4 per eligible column pair: ``containment_q = k/|A|``, ``containment_c = k/|B|``."""
    elig = maybe_broadcast(join_eligible(prof, cfg), 24 * n_columns, cfg.broadcast_limit_bytes)
    q = elig.select(F.col("table_idx").alias("q_idx"), F.col("col_idx").alias("q_col"),
                    F.col("n_values").alias("q_size"))
    c = elig.select(F.col("table_idx").alias("c_idx"), F.col("col_idx").alias("c_col"),
                    F.col("n_values").alias("c_size"))
    return (overlap.join(q, ["q_idx", "q_col"]).join(c, ["c_idx", "c_col"])
            .select("q_idx", "c_idx", "q_col", "c_col", "k",
                    (F.col("k") / F.col("q_size")).alias("containment_q"),
                    (F.col("k") / F.col("c_size")).alias("containment_c")))


def joinability(pairs: DataFrame, overlap: DataFrame, prof: Profiles, n_columns: int,
                cfg: ScoreConfig) -> DataFrame:
    """Max over eligible same-type column pairs of max(J3, J4); 0.0 if none."""
    best = (column_containment(overlap, prof, n_columns, cfg)
            .groupBy("q_idx", "c_idx")
            .agg(F.max(F.greatest("containment_q", "containment_c")).alias("joinability")))
    return (pairs.join(best, ["q_idx", "c_idx"], "left")
            .select("q_idx", "c_idx", F.coalesce(F.col("joinability"), F.lit(0.0)).alias("joinability")))
