"""Job parameters.

Everything a user tunes lives in :class:`ScoreConfig`; operators receive it
explicitly instead of reading module globals.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the labelling rules being reproduced, or the
# scores and labels change: top-k 200, join threshold 0.15, union threshold
# 0.20, semantic threshold 0.40, table-semantic gate 0.25, numeric
# cardinality cut-off 0.8 (strict >), union weights 0.7 Jaccard + 0.3
# cardinality, 500 sample values per column, first 8 columns in the table
# text, 384-dimensional embeddings, cosine norm guard 1e-9, scores rounded to
# 3 digits in the output.
# ---------------------------------------------------------------------------
TOP_K = 200
JOIN_THRESHOLD = 0.15
UNION_THRESHOLD = 0.20
SEMANTIC_THRESHOLD = 0.40
SEMANTIC_GATE = 0.25
NUMERIC_CARDINALITY_CUTOFF = 0.8
JACCARD_WEIGHT = 0.7
CARDINALITY_WEIGHT = 0.3
SAMPLE_VALUES = 500
TABLE_TEXT_COLUMNS = 8
EMBEDDING_DIM = 384
NORM_EPSILON = 1e-9
OUTPUT_DIGITS = 3
# Scores are first rounded to this many decimals before thresholds and
# output rounding, so that float noise from summation order (last-bit
# differences between equivalent plans) can never flip a label or the 3rd
# digit at an exact half.
CLEAN_DIGITS = 12
# Table semantic score used when no embedder is configured.
NO_MODEL_TABLE_SCORE = 0.5

# Output schema of the labelling job, in order.
OUTPUT_COLUMNS = (
    "query_table",
    "candidate_table",
    "similarity",
    "joinability",
    "unionability",
    "semantic_table",
    "semantic_join",
    "semantic_union",
    "is_join_gt",
    "is_union_gt",
    "is_ground_truth",
)


@dataclass(frozen=True)
class ScoreConfig:
    top_k: int = TOP_K
    join_threshold: float = JOIN_THRESHOLD
    union_threshold: float = UNION_THRESHOLD
    semantic_threshold: float = SEMANTIC_THRESHOLD
    semantic_gate: float = SEMANTIC_GATE
    numeric_cardinality_cutoff: float = NUMERIC_CARDINALITY_CUTOFF
    sample_values: int = SAMPLE_VALUES
    table_text_columns: int = TABLE_TEXT_COLUMNS
    embedding_dim: int = EMBEDDING_DIM
    # "hashed" (built-in lexical embedder), "dense" or a DenseConfig (vectors
    # from the lake's own token co-occurrences, see dense.py), "none" (no model:
    # constant table score, no column scores) or a callable embedder, see semantic.py.
    embedder: object = "hashed"
    # First n tables as queries, first m listed files as candidates.
    num_queries: int | None = None
    max_candidates: int | None = None
    # Skew: a value shared by more columns than this is split over
    # ``value_salt_buckets`` x ``value_salt_buckets`` join tasks.
    hot_value_postings: int = 2000
    value_salt_buckets: int = 8
    # Largest dimension table (estimated bytes) that is broadcast.
    broadcast_limit_bytes: int = 64 << 20
    # Tables per profile job: a lake with more tables is profiled in batches
    # whose small outputs are appended to one table in the checkpoint folder,
    # so no single plan unions more than this many table scans.
    profile_batch_tables: int = 256
    # Pair kernel blocking: most tables and columns of a block (a group scores
    # all pairs of two blocks) and block pairs per task.
    pair_block_tables: int = 32
    pair_block_columns: int = 512
    blocks_per_task: int = 4
