"""Labels and output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.config import CLEAN_DIGITS, OUTPUT_COLUMNS, OUTPUT_DIGITS, ScoreConfig

SCORE_COLUMNS = ("similarity", "joinability", "unionability", "semantic_table",
                 "semantic_join", "semantic_union")


def clean(c) -> F.Column:
    """A score with summation-order noise removed (see ``CLEAN_DIGITS``)."""
    return F.round(c if isinstance(c, F.Column) else F.col(c), CLEAN_DIGITS)


def stable_round(c, digits: int) -> F.Column:
    return F.round(clean(c), digits)


def label(scores: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """L1-L4 on unrounded scores, then L5 rounding of the six scores."""
    scores = scores.select(*[clean(c).alias(c) if c in SCORE_COLUMNS else F.col(c)
                             for c in scores.columns])
    is_join = ((F.col("joinability") >= cfg.join_threshold)
               & (F.col("semantic_join") >= cfg.semantic_threshold)).cast("int")
    is_union = ((F.col("unionability") >= cfg.union_threshold)
                & (F.col("semantic_union") >= cfg.semantic_threshold)).cast("int")
    labelled = scores.select(
        "*",
        F.greatest("joinability", "unionability").alias("similarity"),
        is_join.alias("is_join_gt"),
        is_union.alias("is_union_gt"),
    ).withColumn("is_ground_truth", F.greatest("is_join_gt", "is_union_gt"))
    return labelled.select(
        "q_idx", "c_idx",
        *[stable_round(c, OUTPUT_DIGITS).alias(c) if c in SCORE_COLUMNS else F.col(c)
          for c in OUTPUT_COLUMNS],
    )


def summary(labels: DataFrame) -> DataFrame:
    """Positive pairs and total pairs."""
    return labels.agg(F.sum("is_ground_truth").cast("long").alias("positive_pairs"),
                      F.count(F.lit(1)).alias("total_pairs"))


def write_labels(labels: DataFrame, path: str, fmt: str = "csv") -> None:
    """Header + the 11 output columns, overwriting, in listing order."""
    out = labels.orderBy("q_idx", "c_idx").select(*OUTPUT_COLUMNS)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
