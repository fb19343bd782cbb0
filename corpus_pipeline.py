"""The corpus pipeline: five stages over ``documents``, each written and read again.

quality rules -> exact dedup -> n-gram Jaccard join -> mix -> byte-level BPE.
Each stage works on all that the one before kept; all but the last return the
columns of its input.  Counted as part of ``lakesift.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import exact_dedup, mixing, ngram_join, quality
from lakesift.llm.common import scratch, small_side, staged, table
from lakesift.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are cut, documents that lose too much go."""
    return quality.clean(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.survivors(docs, spark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word grams,
    similarity 0.8): the one with the smallest id, null ids last, then by hash
    of its text (rows equal in both count as one); documents without words stay."""
    with scratch(spark):  # only the rows that go are read later
        found = staged(ngram_join.ngram_jaccard(docs, ngram_join.Join(words=5, pct=80)), "near").where("n_shingles > 0")
        # the first row of each group, by partial aggregation
        place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
        heads = found.groupBy("component_class").agg(F.min(place).alias("head"))
        goes = found.withColumn("place", place).join(heads, "component_class").where("place != head")
        goes = goes.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
        goes = staged(goes, "near-goes", keep=True)
    here = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(small_side(goes, goes.count(), 24), here, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document of two epochs comes twice."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of each row."""
    return byte_bpe(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

#: The BPE stage can't be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, f"stage{number}")
    return docs
