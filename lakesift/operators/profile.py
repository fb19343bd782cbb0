"""Column profiles.

Plan: one scan of ``cells`` feeds a single raw-frequency aggregation keyed by
``(table_idx, col_idx, value)`` (partial aggregation map-side, so a hot value
or a column that holds a third of the lake collapses before the shuffle).
Everything else is derived from that aggregate:

* column statistics (row count, non-null count, distinct raw values, type
  test on *distinct* values only) - a second, tiny aggregation;
* normalised frequencies and the top-k value set - regrouped by digests of
  the normalised values, so texts are shuffled once only, and not at all for
  columns of numbers and times, whose texts stay distinct; the ranking window
  runs after a partial ``WindowGroupLimit`` so each column group holds at most
  ``k x shuffle partitions`` rows of a few bytes, whatever the column's distinct
  count; the texts of the kept ones are fetched by the row they first stand in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.functions import text as tx
from lakesift.plans.util import maybe_broadcast
from lakesift.sources.lake import ROW_MARK


def raw_value_counts(cells: DataFrame) -> DataFrame:
    """P5 on raw text: ``(table_idx, col_idx, value, n, first)`` over non-null
    cells with row ordinals; ``first`` is the value's first position, so the same
    single shuffle also feeds the E1 samples."""
    return cells.groupBy("table_idx", "col_idx", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def column_stats(raw: DataFrame) -> DataFrame:
    """P1, P3, P8 per column (columns without any value are filled in by
    :func:`assemble`).

    The type tests run once per *distinct* raw value.  They are evaluated
    for every column and resolved against the column's source class in
    :func:`assemble`, so this aggregate reads ``raw`` alone - which keeps its
    ``raw`` subplan identical to the other consumers' (one shared shuffle)."""
    return (
        raw.groupBy("table_idx", "col_idx")
        .agg(
            F.sum("n").alias("n_non_null"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.bool_and(tx.is_numeric_text(F.col("value"))).alias("all_numeric_text"),
            F.bool_and(tx.is_boolean_text(F.col("value"))).alias("all_boolean_text"),
            # every consumer of ``raw`` reads ``first``: their subplans stay equal
            F.min("first").alias("first"),
        )
    )


def csv_row_counts(raw: DataFrame) -> DataFrame:
    """P1 of CSV tables from their row marks."""
    return raw.where(F.col("col_idx") == ROW_MARK).select("table_idx", F.col("n").alias("n_rows"))


def csv_typed(raw: DataFrame, limit_bytes: int, n_columns: int) -> DataFrame:
    """Raw counts of CSV tables after each column is read as a whole: whole
    numbers (floats if a cell is missing), floats, booleans, else text.  Texts
    of one value (``1.50`` and ``1.5``) become one."""
    cells = raw.where(F.col("col_idx") >= 0)
    kinds = cells.groupBy("table_idx", "col_idx").agg(
        F.bool_and(tx.is_integer_text(F.col("value"))).alias("ints"),
        F.bool_and(tx.is_numeric_text(F.col("value"))).alias("numbers"),
        F.bool_and(tx.is_boolean_text(F.col("value"))).alias("booleans"),
        F.sum("n").alias("filled")).join(csv_row_counts(raw), "table_idx")
    kind = (F.when(F.col("ints") & (F.col("filled") == F.col("n_rows")), "int")
            .when(F.col("numbers"), "float").when(F.col("booleans"), "bool").otherwise("text"))
    kinds = maybe_broadcast(kinds.select("table_idx", "col_idx", kind.alias("kind")), 64 * n_columns, limit_bytes)
    typed = cells.join(kinds, ["table_idx", "col_idx"]).withColumn("value", tx.typed_text(F.col("value"), F.col("kind")))
    return typed.groupBy("table_idx", "col_idx", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def inferred_type(src_class, n_non_null, all_numeric_text, all_boolean_text):
    """P3: 'numeric' iff every non-null value is a number; empty -> 'string'.
    A CSV column of only true/false values is a number class, missing cells or not."""
    num = (
        (src_class == tx.SRC_NUMERIC)
        | (src_class.isin(tx.SRC_TEXT, tx.SRC_CSV) & F.coalesce(all_numeric_text, F.lit(False)))
        | ((src_class == tx.SRC_CSV) & F.coalesce(all_boolean_text, F.lit(False)))
    )
    return F.when((n_non_null > 0) & num, F.lit("numeric")).otherwise(F.lit("string"))


def digest(text: F.Column) -> list[F.Column]:
    """128 bits that stand for a text as a grouping key (``d1``, ``d2``); a third
    digest (``d3``) tells two texts apart that would share them."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second"), text).alias("d2"), F.hash(F.lit("third"), text).alias("d3")]


def counted(raw: DataFrame, form, kinds: DataFrame | None = None) -> DataFrame:
    """(table_idx, col_idx, freq, first) of the values' ``form``: raw
    counts regrouped by digests, so no text is shuffled again.  ``first`` names
    the row whose value has this form (a row has one value in a column), by which
    :func:`with_text` finds the text of those that are kept.

    ``kinds`` (table_idx, col_idx, distinct_forms) tells the columns whose values
    keep apart in every form (:func:`text.forms_stay_distinct`): their raw counts
    are the forms' and aren't shuffled again.  (Inner joins: a semi join would
    move below the aggregation of ``raw``, which then has to run once more.)"""
    if kinds is not None:
        known = raw.join(kinds, ["table_idx", "col_idx"])
        apart = known.where("distinct_forms").select("table_idx", "col_idx", F.col("n").alias("freq"), "first")
        return apart.unionByName(counted(known.where("not distinct_forms").drop("distinct_forms"), form))
    grouped = raw.select("table_idx", "col_idx", *digest(form(F.col("value"))), "n", "first").groupBy(
        "table_idx", "col_idx", "d1", "d2").agg(
        F.sum("n").alias("freq"), F.min("first").alias("first"), F.min("d3").alias("low"), F.max("d3").alias("high"))
    clash = F.raise_error(F.lit("two values of a column share 128 bits of digests")).cast("bigint")
    return grouped.select("table_idx", "col_idx", F.when(F.col("low") == F.col("high"), F.col("freq")).otherwise(clash).alias("freq"), "first")


def top_ranks(raw: DataFrame, top_k: int, kinds: DataFrame | None = None) -> DataFrame:
    """P4-P7 without texts: ``(table_idx, col_idx, first, freq, rank)`` of the k
    most frequent normalised values.  Equal counts keep first-appearance order
    (the earliest row holding the normalised value first), as a stable frequency
    sort of the values in table order would."""
    w = Window.partitionBy("table_idx", "col_idx").orderBy(F.desc("freq"), F.asc("first"))
    return counted(raw, tx.normalize_value, kinds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def with_text(ranks: DataFrame, raw: DataFrame, form, est_bytes: int, limit_bytes: int) -> DataFrame:
    """``ranks`` with ``value``, the ``form`` of the raw value at their first row
    (and ``n``, its count: all columns of ``raw`` are read, and in its order, so
    that this subplan equals the others')."""
    texts = raw.select("table_idx", "col_idx", "value", "n", "first")
    found = texts.join(maybe_broadcast(ranks, est_bytes, limit_bytes), ["table_idx", "col_idx", "first"])
    return found.withColumn("value", form(F.col("value")))


#: Bytes of a rank row as broadcast.
RANK_BYTES = 48


def top_values(raw: DataFrame, cfg: ScoreConfig, n_columns: int) -> DataFrame:
    """``(table_idx, col_idx, value, freq, rank)`` for the k most frequent
    normalised values."""
    return with_text(top_ranks(raw, cfg.top_k), raw, tx.normalize_value, n_columns * cfg.top_k * RANK_BYTES, cfg.broadcast_limit_bytes)


KIND_STATS, KIND_TOP, KIND_SAMPLE, KIND_ROWS = 0, 1, 2, 3


def bundle(raw: DataFrame, table_rows: DataFrame, cfg: ScoreConfig, n_columns: int,
           sample_ranks: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Stats, top-k values and (optionally) E1 samples of every column as *one*
    DataFrame, so that a single job - reusing the one shuffle of ``raw`` -
    materialises all of them (see :func:`split_bundle`).

    kind 0: b=n_non_null, c=n_distinct, d=first row, type-test flags
    kind 3: a=n_rows of the table (col_idx -1)
    kind 1: value, a=freq, b=rank, d=first position of the value
    kind 2: value, a=occurrences, b=pos, d=first position

    Every branch outputs both the counts and the first positions of ``raw``,
    so column pruning leaves the ``raw`` subplans identical and the
    job shuffles ``raw`` once (ReusedExchange).  Texts of both rankings are
    fetched in one join with ``raw``.
    """
    def shape(df, kind, value=None, a=None, b=None, c=None, d=None, num=None, boo=None):
        lit_l = F.lit(None).cast("long")
        return df.select(
            (kind if isinstance(kind, F.Column) else F.lit(kind)).alias("kind"), "table_idx", "col_idx",
            (value if value is not None else F.lit(None).cast("string")).alias("value"),
            (a if a is not None else lit_l).cast("long").alias("a"),
            (b if b is not None else lit_l).cast("long").alias("b"),
            (c if c is not None else lit_l).cast("long").alias("c"),
            (d if d is not None else lit_l).cast("long").alias("d"),
            (num if num is not None else F.lit(None).cast("boolean")).alias("all_numeric_text"),
            (boo if boo is not None else F.lit(None).cast("boolean")).alias("all_boolean_text"))

    st = column_stats(raw)
    rows = table_rows.withColumn("col_idx", F.lit(-1))
    out = shape(rows, KIND_ROWS, a=F.col("n_rows")).unionByName(
        shape(st, KIND_STATS, b=F.col("n_non_null"), c=F.col("n_distinct"),
              d=F.col("first"), num=F.col("all_numeric_text"), boo=F.col("all_boolean_text")))
    ranks = top_ranks(raw, cfg.top_k, kinds).select("table_idx", "col_idx", "first", F.lit(KIND_TOP).alias("kind"), "freq", "rank")
    per_column = cfg.top_k
    if sample_ranks is not None:
        ranks = ranks.unionByName(sample_ranks.select(
            "table_idx", "col_idx", "first", F.lit(KIND_SAMPLE).alias("kind"), "freq", F.col("pos").alias("rank")))
        per_column += cfg.sample_values
    form = lambda v: F.when(F.col("kind") == KIND_TOP, tx.normalize_value(v)).otherwise(F.lower(v))
    named = with_text(ranks, raw, form, n_columns * per_column * RANK_BYTES, cfg.broadcast_limit_bytes)
    named = shape(named, F.col("kind"), value=F.col("value"), a=F.col("freq"), b=F.col("rank"), c=F.col("n"), d=F.col("first"))
    return out.unionByName(named)


def split_bundle(b: DataFrame, columns: DataFrame) -> tuple["Profiles", DataFrame]:
    """(profiles, samples) from a materialised :func:`bundle`."""
    rows = b.where(F.col("kind") == KIND_ROWS).select("table_idx", F.col("a").alias("n_rows"))
    stats = b.where(F.col("kind") == KIND_STATS).select(
        "table_idx", "col_idx", F.col("b").alias("n_non_null"),
        F.col("c").alias("n_distinct"), "all_numeric_text", "all_boolean_text")
    top = b.where(F.col("kind") == KIND_TOP).select(
        "table_idx", "col_idx", "value", F.col("a").alias("freq"), F.col("b").cast("int").alias("rank"))
    samples = b.where(F.col("kind") == KIND_SAMPLE).select(
        "table_idx", "col_idx", "value", F.col("b").cast("int").alias("pos"))
    return assemble(columns, rows, stats, top), samples


@dataclass
class Profiles:
    """Profile outputs reused by every score.

    ``columns``: table_idx, col_idx, column_name, src_class, inferred_type,
    n_rows, n_non_null, n_distinct, cardinality_ratio, null_ratio, n_values.
    ``values``: table_idx, col_idx, inferred_type, value, freq, rank.
    """

    columns: DataFrame
    values: DataFrame


def profile(raw: DataFrame, columns: DataFrame, table_rows: DataFrame, cfg: ScoreConfig, n_columns: int) -> Profiles:
    """P10 from the raw value counts of :func:`raw_value_counts`."""
    return assemble(columns, table_rows, column_stats(raw), top_values(raw, cfg, n_columns))


def assemble(columns: DataFrame, table_rows: DataFrame, stats: DataFrame, top: DataFrame) -> Profiles:
    """P10: column dimension + table row counts + statistics + top-k set sizes."""
    set_sizes = top.groupBy("table_idx", "col_idx").agg(F.count(F.lit(1)).alias("n_values"))
    nn = F.coalesce(F.col("n_non_null"), F.lit(0))
    rows = F.coalesce(F.col("n_rows"), F.lit(0))
    prof = (
        columns.join(table_rows, "table_idx", "left")
        .join(stats, ["table_idx", "col_idx"], "left")
        .join(set_sizes, ["table_idx", "col_idx"], "left")
        .select(
            "table_idx", "col_idx", "column_name", "src_class",
            inferred_type(F.col("src_class"), nn, F.col("all_numeric_text"),
                          F.col("all_boolean_text")).alias("inferred_type"),
            rows.alias("n_rows"),
            nn.alias("n_non_null"),
            F.coalesce(F.col("n_distinct"), F.lit(0)).alias("n_distinct"),
            # Distinct raw values / non-null count (0.0 for an empty column)
            F.when(nn > 0, F.col("n_distinct") / nn).otherwise(F.lit(0.0)).alias("cardinality_ratio"),
            # Empty column (also a 0-row table) -> 1.0
            F.when(nn > 0, (rows - nn) / rows).otherwise(F.lit(1.0)).alias("null_ratio"),
            F.coalesce(F.col("n_values"), F.lit(0)).cast("int").alias("n_values"),
        )
    )
    vals = top.join(prof.select("table_idx", "col_idx", "inferred_type"), ["table_idx", "col_idx"])
    return Profiles(columns=prof, values=vals.select(
        "table_idx", "col_idx", "inferred_type", "value", "freq", "rank"))
