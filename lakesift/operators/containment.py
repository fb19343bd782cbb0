"""Best containment of every table pair by rounds of prefixes (J5 alone).

The joinability of two tables is their best column pair's, so most column pairs
need no count.  Each column's values are ordered by how many columns hold them,
rarest first.  If a column of n values shares a share t of them with a larger
one, it shares one of its first ``n - ceil(t n) + 1`` values.  A round with bound t
therefore meets all column pairs that reach t by joining these short prefixes
with the posting lists; only they are counted, and a table pair whose best
reaches t is settled, since no other of its column pairs can beat it.  The next
round has a lower bound and longer prefixes, and leaves out settled pairs and
tables without open ones.  Frequent values, whose posting lists are long, come
last in the order, so they are met only for pairs that nothing else settled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.operators.joinability import join_eligible
from lakesift.operators.profile import Profiles
from lakesift.plans.util import cut_lineage

#: Bounds of the rounds; the last one meets every column pair with a shared value.
BOUNDS = (0.8, 0.4, 0.15, 0.0)


@dataclass
class Best:
    """``scores``: (q_idx, c_idx, joinability), q <= c, of pairs above 0;
    ``counted``: column pairs that each round counted."""

    scores: DataFrame
    counted: list[int] = field(default_factory=list)


def ranked_values(prof: Profiles, cfg: ScoreConfig) -> DataFrame:
    """(t, c, kind, value, n, r) of columns that a join may use: ``r`` is the place
    of a value in its column, held by the fewest columns first."""
    vals = prof.values.select(F.col("table_idx").alias("t"), F.col("col_idx").alias("c"), F.col("inferred_type").alias("kind"), "value")
    sizes = join_eligible(prof, cfg).select(F.col("table_idx").alias("t"), F.col("col_idx").alias("c"), F.col("n_values").alias("n"))
    vals = vals.join(sizes, ["t", "c"])
    held = vals.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("t", "c").orderBy("held", "value")
    return vals.join(held, ["kind", "value"]).withColumn("r", F.row_number().over(order)).select("t", "c", "kind", "value", "n", "r")


def best_containment(prof: Profiles, cfg: ScoreConfig, bounds: tuple[float, ...] = BOUNDS) -> Best:
    """J5 of every table pair with a shared value, exact."""
    vals = cut_lineage(ranked_values(prof, cfg))
    sets = cut_lineage(vals.groupBy("t", "c").agg(F.collect_list("value").alias("vs"), F.first("n").alias("n")))
    # a column contains itself
    settled = vals.select(F.col("t").alias("q_idx"), F.col("t").alias("c_idx"), F.lit(1.0).alias("joinability")).distinct()
    tables = vals.select("t").distinct().count()
    best = Best(settled)
    for bound in bounds:
        left = F.greatest(F.lit(1), F.ceil(F.col("n") * bound - 1e-9))
        probe, index = vals.where(F.col("r") <= F.col("n") - left + 1), vals
        if best.counted:
            # tables that have an open pair: settled with fewer tables than there are
            done = best.scores.where("q_idx != c_idx")
            done = done.selectExpr("q_idx t").unionByName(done.selectExpr("c_idx t")).groupBy("t").count()
            full = done.where(F.col("count") >= tables - 1).select("t")
            probe, index = probe.join(full, "t", "left_anti"), index.join(full, "t", "left_anti")
        a = probe.select(F.col("t").alias("ta"), F.col("c").alias("ca"), "kind", "value", F.col("n").alias("na"))
        b = index.select(F.col("t").alias("tb"), F.col("c").alias("cb"), "kind", "value", F.col("n").alias("nb"))
        met = a.join(b, ["kind", "value"]).where("na <= nb and ta != tb").select("ta", "ca", "tb", "cb").distinct()
        met = met.withColumns({"q_idx": F.least("ta", "tb"), "c_idx": F.greatest("ta", "tb")})
        met = cut_lineage(met.join(best.scores.select("q_idx", "c_idx"), ["q_idx", "c_idx"], "left_anti"))
        best.counted.append(met.count())
        side = lambda s: sets.select(F.col("t").alias(f"t{s}"), F.col("c").alias(f"c{s}"), F.col("vs").alias(f"v{s}"))
        k = F.size(F.array_intersect("va", "vb"))
        scored = met.join(side("a"), ["ta", "ca"]).join(side("b"), ["tb", "cb"]).select(
            "q_idx", "c_idx", (k / F.least(F.size("va"), F.size("vb"))).alias("joinability"))
        found = scored.groupBy("q_idx", "c_idx").agg(F.max("joinability").alias("joinability")).where(F.col("joinability") >= bound)
        best.scores = cut_lineage(best.scores.unionByName(found))
    return best
