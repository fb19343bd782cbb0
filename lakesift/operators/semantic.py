"""Semantic texts, embeddings and cosines.

Texts (E2, E3) are built with ``collect_list`` over at most
``sample_values`` values per column.  The built-in *hashed* embedder never
materialises those texts: because every separator of the texts
(``": "``, ``" | "``, ``", "``, ``"("``) is a non-token character, the token
bag of a text is the sum of the token bags of its parts.  Tokens are
therefore produced per sample value in parallel and summed per
``(entity, bucket)``; the result equals embedding the full text.

Cosines of table vectors (E6) come from a block matrix product; column
cosines (E8) are computed inside the pair alignment kernel with one matrix
product per table pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.config import NO_MODEL_TABLE_SCORE, NORM_EPSILON, ScoreConfig
from lakesift.functions import text as tx
from lakesift.operators import pairs as pr, profile as pf
from lakesift.operators.profile import Profiles
from lakesift.plans.util import ship_package


def sample_ranks(raw: DataFrame, cfg: ScoreConfig, kinds: DataFrame | None = None) -> DataFrame:
    """E1 without texts: ``(table_idx, col_idx, first, freq, pos)`` of the first
    ``sample_values`` distinct lower-cased (not stripped) values of every column
    in first-appearance order.

    ``raw`` are the raw value counts with their first ordinal, ``kinds`` the
    columns of distinct forms (profile.py)."""
    w = Window.partitionBy("table_idx", "col_idx").orderBy("first")
    return (pf.counted(raw, F.lower, kinds).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= cfg.sample_values))


def sample_values(raw: DataFrame, cfg: ScoreConfig, n_columns: int) -> DataFrame:
    """``(table_idx, col_idx, value, pos, freq, first)``."""
    return pf.with_text(sample_ranks(raw, cfg), raw, F.lower, n_columns * cfg.sample_values * pf.RANK_BYTES, cfg.broadcast_limit_bytes)


def _joined_values(samples: DataFrame) -> DataFrame:
    """``(table_idx, col_idx, values_text)`` = the sample values joined by ', '."""
    return (samples.groupBy("table_idx", "col_idx")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("vs"))
            .select("table_idx", "col_idx",
                    F.array_join(F.transform("vs", lambda s: s["value"]), ", ").alias("values_text")))


def column_header(prof_columns: DataFrame) -> F.Column:
    """Text of a column before its values."""
    # The words and separators of the embedding texts.
    empty = F.col("n_non_null") == 0
    return F.when(empty, F.concat(F.lit("Column: "), F.col("column_name"), F.lit(" | Type: empty"))) \
        .otherwise(F.concat(F.lit("Column: "), F.col("column_name"), F.lit(" | Type: "),
                            F.col("inferred_type"), F.lit(" | Values: ")))


def column_texts(prof: Profiles, samples: DataFrame) -> DataFrame:
    """``(table_idx, col_idx, column_text)`` for every column."""
    return (prof.columns.join(_joined_values(samples), ["table_idx", "col_idx"], "left")
            .select("table_idx", "col_idx",
                    F.when(F.col("n_non_null") == 0, column_header(prof.columns))
                    .otherwise(F.concat(column_header(prof.columns),
                                        F.coalesce(F.col("values_text"), F.lit(""))))
                    .alias("column_text")))


def table_column_header() -> F.Column:
    """Text of a column before its values in the text of its table."""
    # The separators of the embedding texts.
    return F.concat(F.col("column_name"), F.lit("("), F.col("inferred_type"), F.lit("): "))


def in_table_text(cfg: ScoreConfig) -> F.Column:
    """R3 + F7: first ``table_text_columns`` columns by position, empty ones left out."""
    return (F.col("col_idx") < cfg.table_text_columns) & (F.col("n_non_null") > 0)


def table_texts(tables: DataFrame, prof: Profiles, samples: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """``(table_idx, table_text)``."""
    parts = (prof.columns.where(in_table_text(cfg))
             .join(_joined_values(samples), ["table_idx", "col_idx"], "left")
             .select("table_idx", "col_idx",
                     F.concat(table_column_header(),
                              F.coalesce(F.col("values_text"), F.lit(""))).alias("part")))
    per_table = (parts.groupBy("table_idx")
                 .agg(F.array_sort(F.collect_list(F.struct("col_idx", "part"))).alias("ps")))
    return (tables.where(F.col("status") == "ok").select("table_idx", "table_name")
            .join(per_table, "table_idx", "left")
            .select("table_idx",
                    F.array_join(F.concat(F.array(F.concat(F.lit("Table: "), F.col("table_name"))),
                                          F.coalesce(F.transform("ps", lambda s: s["part"]),
                                                     F.array().cast("array<string>"))),
                                 " | ").alias("table_text")))


# -- hashed embedder ------------------------------------------------------------

def token_bag(df: DataFrame, keys: list[str], text: F.Column, dim: int) -> DataFrame:
    """``(keys..., bucket, weight)``: feature-hashed token counts of ``text``."""
    return (df.select(*keys, F.explode(tx.tokens(text)).alias("tok"))
            .select(*keys, tx.token_bucket(F.col("tok"), dim).alias("bucket"))
            .groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("weight")))


def sample_bags(samples: DataFrame, dim: int) -> DataFrame:
    """Token bags of the sample values, per column."""
    return token_bag(samples, ["table_idx", "col_idx"], F.col("value"), dim)


def column_bags(prof: Profiles, samples: DataFrame, cfg: ScoreConfig,
                value_bags: DataFrame | None = None) -> DataFrame:
    """E7 sparse: ``(table_idx, col_idx, bucket, weight)`` of every column text."""
    dim = cfg.embedding_dim
    vb = value_bags if value_bags is not None else sample_bags(samples, dim)
    head = token_bag(prof.columns, ["table_idx", "col_idx"], column_header(prof.columns), dim)
    return (head.unionByName(vb).groupBy("table_idx", "col_idx", "bucket")
            .agg(F.sum("weight").alias("weight")))


def table_bags(tables: DataFrame, prof: Profiles, samples: DataFrame, cfg: ScoreConfig,
               value_bags: DataFrame | None = None) -> DataFrame:
    """E3 + E4 sparse: ``(table_idx, bucket, weight)`` of every table text."""
    dim = cfg.embedding_dim
    vb = value_bags if value_bags is not None else sample_bags(samples, dim)
    cols = prof.columns.where(in_table_text(cfg)).select("table_idx", "col_idx", "column_name",
                                                         "inferred_type")
    name = token_bag(tables.where(F.col("status") == "ok"), ["table_idx"],
                     F.concat(F.lit("Table: "), F.col("table_name")), dim)
    heads = token_bag(cols, ["table_idx", "col_idx"], table_column_header(), dim)
    vals = vb.join(cols.select("table_idx", "col_idx"), ["table_idx", "col_idx"])
    return (name.unionByName(heads.drop("col_idx")).unionByName(vals.drop("col_idx"))
            .groupBy("table_idx", "bucket").agg(F.sum("weight").alias("weight")))


def dense(bags: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Sparse bags -> ``(keys..., vec array<float>, norm double)``; at most
    ``dim`` entries are collected per entity."""
    m = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("weight").cast("float"))))
    return (bags.groupBy(*keys)
            .agg(m.alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
            .select(*keys,
                    F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0.0).cast("float")))
                    .alias("vec"),
                    "norm"))


def dot(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def clamped_cosine(dotp: F.Column, norm_a: F.Column, norm_b: F.Column) -> F.Column:
    """E5: 0.0 when a norm is below 1e-9, else the cosine clamped to [0, 1]."""
    return F.when((norm_a < NORM_EPSILON) | (norm_b < NORM_EPSILON), F.lit(0.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dotp / (norm_a * norm_b))))


#: Tables of a block of the product.
BLOCK_TABLES = 256


def packed_blocks(vectors: DataFrame) -> DataFrame:
    """(blk, ids, vecs, norms): the vectors of ``BLOCK_TABLES`` tables in one row."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("table_idx")
        vecs = rows["vec"].combine_chunks()
        flat = vecs.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        return pa.table({"blk": rows["blk"][:1], "ids": [rows["table_idx"].to_numpy().astype("<i4").tobytes()],
                         "vecs": [flat.tobytes()], "norms": [rows["norm"].to_numpy().astype("<f8").tobytes()]},
                        schema=pa.schema([("blk", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("norms", pa.binary())]))

    blk = F.floor(F.col("table_idx") / BLOCK_TABLES).cast("int").alias("blk")
    return vectors.select(blk, "table_idx", "vec", "norm").groupBy("blk").applyInArrow(pack, "blk int, ids binary, vecs binary, norms binary")


def block_products(batches):
    """(q_idx, c_idx, semantic_table), q_idx <= c_idx, of two packed blocks a row."""
    for batch in batches:
        for r in batch.to_pylist():
            (iq, vq, nq), (ic, vc, nc) = (
                (np.frombuffer(r[f"{s}_ids"], "<i4"), np.frombuffer(r[f"{s}_vecs"], "<f4"), np.frombuffer(r[f"{s}_norms"], "<f8")) for s in "qc")
            dots = vq.reshape(len(iq), -1).astype(np.float64) @ vc.reshape(len(ic), -1).astype(np.float64).T
            with np.errstate(divide="ignore", invalid="ignore"):
                cos = np.clip(dots / (nq[:, None] * nc[None, :]), 0.0, 1.0)
            cos = np.where((nq[:, None] < NORM_EPSILON) | (nc[None, :] < NORM_EPSILON), 0.0, cos)
            q, c = np.nonzero(iq[:, None] <= ic[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(iq[q]), pa.array(ic[c]), pa.array(cos[q, c])], ["q_idx", "c_idx", "semantic_table"])


def table_semantic(pairs: DataFrame, table_vecs: DataFrame | None, n_tables: int,
                   cfg: ScoreConfig) -> DataFrame:
    """E6 for every pair: ``(q_idx, c_idx, semantic_table)``; 0.5 without a model.

    A block matrix product: vectors travel packed, once per pair of blocks of
    tables, and only numbers come out; no vector is on a pair's row.  Prefixes
    (S4, S5) leave out blocks of tables, then tables."""
    if table_vecs is None:
        return pairs.select("q_idx", "c_idx", F.lit(NO_MODEL_TABLE_SCORE).alias("semantic_table"))
    spark = pairs.sparkSession
    ship_package(spark)
    limits = [min(n_tables, x or n_tables) for x in (cfg.num_queries, cfg.max_candidates)]
    low, high = min(limits), max(limits)
    rows, columns = -(-low // BLOCK_TABLES), -(-high // BLOCK_TABLES)
    blocks = packed_blocks(table_vecs.where(F.col("table_idx") < high))
    end = lambda s, at: blocks.select(F.col("blk").alias(at), *(F.col(c).alias(f"{s}_{c}") for c in ("ids", "vecs", "norms")))
    numbers = spark.range(rows * columns - rows * (rows - 1) // 2)
    both = pr.unranked(numbers, columns).drop("id").join(end("q", "q_idx"), "q_idx").join(end("c", "c_idx"), "c_idx").drop("q_idx", "c_idx")
    scores = both.mapInArrow(block_products, "q_idx int, c_idx int, semantic_table double")
    return scores.where(F.col("q_idx") < low) if low < n_tables else scores


# -- model embedder -------------------------------------------------------------

def model_vectors(texts: DataFrame, keys: list[str], text_col: str, embed_batch) -> DataFrame:
    """E4 with a user model: ``embed_batch(list[str]) -> sequence of vectors``.

    Runs as an Arrow-batched pandas UDF, so the model is called once per
    batch of texts in each Python worker (load it lazily inside
    ``embed_batch``).  Returns ``(keys..., vec array<float>, norm double)``."""
    @F.pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        out = embed_batch(s.tolist())
        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in out])

    v = texts.select(*keys, encode(F.col(text_col)).alias("vec"))
    return v.select(*keys, "vec", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("norm"))
