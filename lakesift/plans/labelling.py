"""The labelling job: every ordered table pair of a lake -> scores and labels.

Stages (each one a set-at-a-time Spark plan over all tables / pairs):

1. ``raw``: one scan of every table, unpivoted to cells, one aggregation by
   ``(table, column, raw value)`` carrying count and first row position.
2. Profiles, top-k value sets and first-appearance samples from ``raw``.
3. Value overlap (inverted-index join) -> joinability.
4. Hashed token bags -> table and column vectors -> table cosines (gate).
5. One grouped kernel per block pair of tables: unionability alignment, and
   for gated pairs the column cosine matrix, its max and its alignment.
6. Labels, mirrored to both orientations, rounded.

With ``materialize=True`` the small stage outputs are checkpointed in the
session's checkpoint folder, so a lost executor never forces a re-scan of
the lake.  ``raw`` itself is never cached: its three consumers (statistics,
top-k, samples) run in one job that reuses its single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.config import ScoreConfig
from lakesift.functions import text as tx
from lakesift.operators import align, joinability as jn, labels as lb, pairs as pr
from lakesift.operators import profile as pf, semantic as sm
from lakesift.plans.util import cut_lineage, maybe_broadcast, remove_path, scratch_path, ship_package
from lakesift.sources.lake import BAD_MARK, Lake
from lakesift.sources.manifest import MANIFEST_SCHEMA, read_failure, scanned_rows

@dataclass
class LakeState:
    """Intermediate DataFrames of one lake, built lazily and shared by queries."""

    lake: Lake
    cfg: ScoreConfig
    materialize: bool = True

    def __post_init__(self):
        self.spark = self.lake.spark
        self._cache: dict[str, object] = {}
        self.n_tables = self.lake.n_tables()
        self._made: list[str] = []

    #: What the profile, and what the vectors depend on besides; shared by
    #: states of other thresholds, prefixes or embedders.
    PROFILE_FIELDS = ("top_k", "sample_values", "profile_batch_tables")
    SHARED = ("csv", "settled", "raw", "profile_outputs", "tables", "columns", "value_bags", "overlap")
    VECTOR_FIELDS = ("embedder", "embedding_dim", "table_text_columns")
    VECTORS = ("hashed_vectors", "dense_vectors", "table_vectors", "column_vectors")

    def with_config(self, cfg: ScoreConfig) -> "LakeState":
        """The state of the same lake under other parameters: the profile (and
        the vectors, if they don't depend on what differs) is not made again."""
        same = lambda fields: all(getattr(cfg, f) == getattr(self.cfg, f) for f in fields)
        if not same(self.PROFILE_FIELDS):
            return LakeState(self.lake, cfg, materialize=self.materialize)
        self._profile_outputs()
        self.overlap, self.tables, self.columns
        other = LakeState(self.lake, cfg, materialize=self.materialize)
        keys = self.SHARED + (self.VECTORS if same(self.VECTOR_FIELDS) else ())
        other._cache.update({k: self._cache[k] for k in keys if k in self._cache})
        return other

    @property
    def n_columns(self) -> int:
        return len(self.lake.column_rows())

    def _get(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def _cut(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.materialize else df

    # -- dimensions (after the scan, which may take tables out, S3) -----------
    @property
    def tables(self) -> DataFrame:
        self._settle()
        return self._get("tables", self.lake.table_dim)

    @property
    def columns(self) -> DataFrame:
        self._settle()
        return self._get("columns", self.lake.column_dim)

    # -- stage 1-2 -----------------------------------------------------------
    def _csv(self) -> tuple[DataFrame, DataFrame] | None:
        """(typed raw counts, row counts) of the CSV tables.  Their raw counts
        are written once: types need whole columns, and malformed rows fail
        their table."""
        def build():
            idx = [i for i in self.lake.ok_indices() if self.lake.tables[i].fmt == "csv"]
            parts = self._isolated(idx, lambda part: cut_lineage(
                pf.raw_value_counts(self.lake.cells(with_ord=True, subset=part, marks=True))))
            if not parts:
                return None
            raw = reduce(DataFrame.unionByName, parts)
            for r in raw.where(F.col("col_idx") == BAD_MARK).select("table_idx", "n").collect():
                self.lake.fail(r["table_idx"], f"{r['n']} rows with more fields than the header")
            left = self.lake.ok_indices()
            raw = raw.where(F.col("table_idx").isin(left))
            return pf.csv_typed(raw, self.cfg.broadcast_limit_bytes, self.n_columns), pf.csv_row_counts(raw)
        return self._get("csv", build)

    def _isolated(self, idx: list[int], run) -> list:
        """Results of ``run`` over batches of tables.  Where a batch fails since a
        file can't be read, the table of that file is taken out and the rest of
        the batch runs again (halved, if the error names no file of it).  All
        other errors - of the job, the cluster, its disks - are raised."""
        size, todo, out = max(1, self.cfg.profile_batch_tables), [], []
        for start in range(0, len(idx), size):
            todo.append(idx[start:start + size])
        while todo:
            part = todo.pop(0)
            try:
                out.append(run(part))
            except Exception as e:
                failure = read_failure(e)
                if failure is None:
                    raise
                at_fault = self.lake.table_of(failure.path, part) if len(part) > 1 else part[0]
                if at_fault is not None:
                    self.lake.fail(at_fault, failure.error)
                    left = [i for i in part if i != at_fault]
                    todo[:0] = [left] if left else []
                else:
                    half = len(part) // 2
                    todo[:0] = [part[:half], part[half:]]
        return out

    def _raw(self, subset: list[int]) -> tuple[DataFrame, DataFrame]:
        """Raw counts and row counts of some tables."""
        parquet = [i for i in subset if self.lake.tables[i].fmt == "parquet"]
        raw = pf.raw_value_counts(self.lake.cells(with_ord=True, subset=parquet))
        rows = self.lake.table_rows(parquet)
        csv = self._csv() if len(parquet) < len(subset) else None
        if csv:
            mine = F.col("table_idx").isin([i for i in subset if i not in set(parquet)])
            typed, counted = csv[0].where(mine), csv[1].where(mine)
            raw = raw.unionByName(typed) if parquet else typed
            rows = rows.unionByName(counted) if parquet else counted
        return raw, rows

    @property
    def raw(self) -> DataFrame:
        self._settle()
        return self._get("raw", lambda: self._raw(self.lake.ok_indices())[0])

    def _bundle(self, subset: list[int]) -> DataFrame:
        raw, rows = self._raw(subset)
        kinds = self._kinds(subset)
        return pf.bundle(raw, rows, self.cfg, self._width(subset), sample_ranks=sm.sample_ranks(raw, self.cfg, kinds), kinds=kinds)

    def _kinds(self, subset: list[int]) -> DataFrame:
        """(table_idx, col_idx, distinct_forms) of some tables' columns; all
        values of CSV tables are text."""
        rows = [(i, c, self.lake.tables[i].fmt == "parquet" and tx.forms_stay_distinct(dtype))
                for i in subset for c, (_, _, dtype) in enumerate(self.lake.loaded[i].columns)]
        kinds = self.spark.createDataFrame(rows, "table_idx int, col_idx int, distinct_forms boolean")
        return maybe_broadcast(kinds, 32 * len(rows), self.cfg.broadcast_limit_bytes)

    def _width(self, subset: list[int]) -> int:
        return sum(len(self.lake.loaded[i].columns) for i in subset)

    def _settle(self) -> None:
        """Scan the lake: after this it is known which tables can be read."""
        def build():
            self._csv()
            if not self.materialize:
                return ()
            # one job per batch of tables: a single scan + shuffle of ``raw``
            # feeds stats, top-k and samples; only the small bundle is written
            path = scratch_path(self.spark, "profile")
            self._made.append(path)

            def run(part):
                at = f"{path}/{part[0]}-{part[-1]}"
                self._bundle(part).write.mode("overwrite").parquet(at)
                return at
            return self._isolated(self.lake.ok_indices(), run)
        self._get("settled", build)

    def manifest(self) -> DataFrame:
        """S3: status of every listed table with its files, the rows that their
        footers tell and the rows that were read (CSV has no footers)."""
        def build():
            csv = self._csv()
            idx = [i for i in self.lake.ok_indices() if self.lake.tables[i].fmt == "parquet"]
            parts = self._isolated(idx, lambda part: scanned_rows([(i, self.lake.loaded[i].df) for i in part]).collect())
            rows = {r["table_idx"]: tuple(r)[1:] for part in parts for r in part}
            if csv:
                rows |= {r["table_idx"]: (len(self.lake.loaded[r["table_idx"]].df.inputFiles()), None, r["n_rows"])
                         for r in csv[1].collect() if r["table_idx"] in self.lake.loaded}
            ok = set(self.lake.ok_indices())
            return self.spark.createDataFrame(
                [(t.table_idx, t.name, "ok" if t.table_idx in ok else "error", self.lake.errors.get(t.table_idx),
                  *(rows.get(t.table_idx, (None,) * 3) if t.table_idx in ok else (None,) * 3)) for t in self.lake.tables], MANIFEST_SCHEMA)
        return self._get("manifest", build)

    def _profile_outputs(self):
        def build():
            if self.materialize:
                parts = self._cache["settled"]
                if parts:
                    return pf.split_bundle(self.spark.read.parquet(*parts), self.columns)
            raw, rows = self._raw(self.lake.ok_indices())
            return (pf.profile(raw, self.columns, rows, self.cfg, self.n_columns),
                    sm.sample_values(raw, self.cfg, self.n_columns))
        self._settle()
        return self._get("profile_outputs", build)

    @property
    def profiles(self) -> pf.Profiles:
        return self._profile_outputs()[0]

    @property
    def samples(self) -> DataFrame:
        return self._profile_outputs()[1]

    # -- stage 3 ---------------------------------------------------------------
    @property
    def pairs(self) -> DataFrame:
        self._settle()
        return self._get("pairs", lambda: pr.upper_pairs(self.spark, self.n_tables, sorted(self.lake.errors), self.cfg))

    @property
    def overlap(self) -> DataFrame:
        return self._get("overlap", lambda: self._cut(
            jn.value_overlap(self.profiles, self.n_columns, self.cfg)))

    @property
    def joinability(self) -> DataFrame:
        return self._get("joinability", lambda: jn.joinability(
            self.pairs, self.overlap, self.profiles, self.n_columns, self.cfg))

    # -- stage 4 ---------------------------------------------------------------
    @property
    def value_bags(self) -> DataFrame:
        return self._get("value_bags", lambda: sm.sample_bags(self.samples, self.cfg.embedding_dim))

    @property
    def hashed(self) -> bool:
        return self.cfg.embedder == "hashed"

    @property
    def model(self):
        e = self.cfg.embedder
        return e if callable(e) else None

    def _hashed_vectors(self) -> tuple[DataFrame, DataFrame]:
        """Table and column vectors of the hashed embedder, materialised in one
        job (both share the token aggregation of the sample values)."""
        def build():
            dim = self.cfg.embedding_dim
            tv = sm.dense(sm.table_bags(self.tables, self.profiles, self.samples, self.cfg, self.value_bags),
                          ["table_idx"], dim)
            cv = sm.dense(sm.column_bags(self.profiles, self.samples, self.cfg, self.value_bags),
                          ["table_idx", "col_idx"], dim)
            if not self.materialize:
                return tv, cv
            both = cut_lineage(tv.withColumn("col_idx", F.lit(-1)).unionByName(cv))
            return (both.where(F.col("col_idx") == -1).drop("col_idx"),
                    both.where(F.col("col_idx") >= 0))
        return self._get("hashed_vectors", build)

    def _dense_vectors(self) -> tuple[DataFrame, DataFrame]:
        """Table and column vectors from the lake's own co-occurrences."""
        def build():
            from lakesift.operators import dense as dn

            cfg = self.cfg.embedder if isinstance(self.cfg.embedder, dn.DenseConfig) else dn.DenseConfig()
            ship_package(self.spark)
            weights = dn.ppmi(dn.token_pairs(self.samples, self.profiles.columns, cfg), cfg)
            vectors = cut_lineage(dn.token_vectors(weights, cfg))
            tables = self.tables.where(F.col("status") == "ok")
            tv = dn.text_vectors(dn.table_tokens(self.tables, self.profiles, self.samples, self.cfg), ["table_idx"], vectors, tables, cfg)
            cv = dn.text_vectors(dn.column_tokens(self.profiles, self.samples), ["table_idx", "col_idx"], vectors, self.profiles.columns, cfg)
            return self._cut(tv), self._cut(cv)
        return self._get("dense_vectors", build)

    @property
    def dense(self) -> bool:
        from lakesift.operators.dense import DenseConfig

        return self.cfg.embedder == "dense" or isinstance(self.cfg.embedder, DenseConfig)

    @property
    def table_vectors(self) -> DataFrame | None:
        """E3+E4 per table; None without an embedder (E6 then scores 0.5)."""
        def build():
            if self.hashed:
                return self._hashed_vectors()[0]
            if self.dense:
                return self._dense_vectors()[0]
            if self.model is not None:
                ship_package(self.spark)
                texts = sm.table_texts(self.tables, self.profiles, self.samples, self.cfg)
                return self._cut(sm.model_vectors(texts, ["table_idx"], "table_text", self.model))
            return None
        return self._get("table_vectors", build)

    @property
    def column_vectors(self) -> DataFrame | None:
        """E2+E4 (E7) per column; None without an embedder (E11: scores 0)."""
        def build():
            if self.hashed:
                return self._hashed_vectors()[1]
            if self.dense:
                return self._dense_vectors()[1]
            if self.model is not None:
                ship_package(self.spark)
                texts = sm.column_texts(self.profiles, self.samples)
                return self._cut(sm.model_vectors(texts, ["table_idx", "col_idx"], "column_text", self.model))
            return None
        return self._get("column_vectors", build)

    @property
    def table_semantic(self) -> DataFrame:
        """E6 per upper-triangle pair; materialised once, as it feeds the gate of
        the pair kernel (block flags and pair rows) and the final scores."""
        return self._get("table_semantic", lambda: self._cut(sm.table_semantic(
            self.pairs, self.table_vectors, self.n_tables, self.cfg)))

    # -- stage 5 ---------------------------------------------------------------
    def pair_scores(self, with_semantic: bool = True) -> DataFrame:
        """``(q_idx, c_idx, n_q, n_c, union_total, unionability, semantic_join,
        semantic_union)`` for every upper-triangle pair."""
        key = f"pair_scores_{with_semantic}"
        return self._get(key, lambda: self._cut(self._block_groups(with_semantic).applyInPandas(
            align.score_block_group, align.PAIR_SCORE_SCHEMA)))

    def column_matrix(self, kind: str) -> DataFrame:
        """(q_idx, c_idx, q_col, c_col, score): the column matrices of every ordered
        table pair (U4; ``cosine``: E8 of pairs that pass the gate), packed by the
        pair kernel and expanded here."""
        packed = self._block_groups(kind == "cosine").applyInPandas(align.pack_matrices(kind), align.PACKED_SCHEMA)
        long = align.expand_matrices(packed)
        for name, limit in (("q_idx", self.cfg.num_queries), ("c_idx", self.cfg.max_candidates)):
            long = long.where(F.col(name) < limit) if limit else long
        return long

    def _block_groups(self, with_semantic: bool):
        """Stage 5 as a blocked grouped map: the groups of the pair kernel.

        Tables are cut into blocks of at most ``pair_block_tables`` tables and
        ``pair_block_columns`` columns (a wider table is a block of its own);
        one group per block pair ``(bq <= bc)`` receives the column rows of the tables of
        both blocks once (with embeddings only if a pair of the block passes
        the gate), its table pairs and their non-zero overlaps, and scores all
        its pairs.  A table's columns are shipped N / B times instead of N
        times (once per pair); a group holds at most the columns of two blocks
        and their overlaps, both bounded by the column budget."""
        cfg = self.cfg
        blocks_of = self._blocks()
        semantic = with_semantic and self.column_vectors is not None
        if semantic:
            pairs = self.table_semantic.select(
                "q_idx", "c_idx", (F.col("semantic_table") >= cfg.semantic_gate).alias("gated"))
        else:
            pairs = self.pairs.withColumn("gated", F.lit(False))
        dim = self.spark.createDataFrame(blocks_of, "table_idx int, blk int")
        dim = maybe_broadcast(dim, 16 * len(blocks_of), cfg.broadcast_limit_bytes)

        def in_blocks(df: DataFrame) -> DataFrame:
            for side, name in (("q_idx", "bq"), ("c_idx", "bc")):
                df = df.join(dim.select(F.col("table_idx").alias(side), F.col("blk").alias(name)), side)
            return df

        pairs = in_blocks(pairs)
        blocks = pairs.groupBy("bq", "bc").agg(F.max(F.col("gated").cast("int")).alias("any_gated"))

        feats = self.profiles.columns.select(
            "table_idx", "col_idx",
            F.when(F.col("inferred_type") == "numeric", 0).otherwise(1).alias("type_code"),
            F.col("cardinality_ratio").alias("card"), "n_values")
        per_col_bytes = 64
        if semantic:
            feats = feats.join(self.column_vectors.select("table_idx", "col_idx", F.col("vec").alias("emb")),
                               ["table_idx", "col_idx"], "left")
            per_col_bytes += 4 * cfg.embedding_dim + 64
        feats = maybe_broadcast(feats.join(dim, "table_idx"),
                                per_col_bytes * self.n_columns, cfg.broadcast_limit_bytes)

        null_i, null_l = F.lit(None).cast("int"), F.lit(None).cast("long")

        def columns_of(block_col: str, only_distinct: bool) -> DataFrame:
            b = blocks.where(F.col("bq") != F.col("bc")) if only_distinct else blocks
            j = b.join(feats, F.col(block_col) == F.col("blk"))
            cols = [F.col("bq"), F.col("bc"), F.lit(align.KIND_COLUMN).alias("kind"),
                    F.col("table_idx"), null_i.alias("q_idx"), null_i.alias("c_idx"),
                    F.col("col_idx").alias("col"), null_i.alias("col2"),
                    "type_code", "card", "n_values", null_l.alias("k"),
                    F.lit(None).cast("boolean").alias("gated")]
            if semantic:
                # embeddings travel only to blocks with a pair past the gate
                cols.append(F.when(F.col("any_gated") == 1, F.col("emb")).alias("emb"))
            return j.select(*cols)

        def shaped(df: DataFrame, kind: int, **given) -> DataFrame:
            base = dict(table_idx=null_i, q_idx=null_i, c_idx=null_i, col=null_i, col2=null_i,
                        type_code=null_i, card=F.lit(None).cast("double"), n_values=null_i,
                        k=null_l, gated=F.lit(None).cast("boolean"))
            base.update(given)
            cols = [F.col("bq"), F.col("bc"), F.lit(kind).alias("kind")] + \
                   [v.alias(n) for n, v in base.items()]
            if semantic:
                cols.append(F.lit(None).cast("array<float>").alias("emb"))
            return df.select(*cols)

        pair_rows = shaped(pairs, align.KIND_PAIR, q_idx=F.col("q_idx"), c_idx=F.col("c_idx"),
                           gated=F.col("gated"))
        ov = in_blocks(self.overlap)
        ov_rows = shaped(ov, align.KIND_OVERLAP, q_idx=F.col("q_idx"), c_idx=F.col("c_idx"),
                         col=F.col("q_col"), col2=F.col("c_col"), k=F.col("k"))
        rows = (columns_of("bq", False).unionByName(columns_of("bc", True))
                .unionByName(pair_rows).unionByName(ov_rows))
        ship_package(self.spark)
        # Spread block pairs over Python workers: their input is small per group,
        # so AQE would coalesce it into one task; the partition count grows with
        # the number of block pairs instead (groupBy reuses this partitioning).
        n_blocks = len({b for _, b in blocks_of})
        n_groups = n_blocks * (n_blocks + 1) // 2
        parts = max(1, min(n_groups, max(self.spark.sparkContext.defaultParallelism,
                                         -(-n_groups // cfg.blocks_per_task))))
        return rows.repartition(parts, "bq", "bc").groupBy("bq", "bc")

    def _blocks(self) -> list[tuple[int, int]]:
        """(table_idx, block) by running sums of tables and columns, in table order."""
        out, block, tables, columns = [], 0, 0, 0
        for i in self.lake.ok_indices():
            width = len(self.lake.loaded[i].columns)
            if tables and (tables >= self.cfg.pair_block_tables or columns + width > self.cfg.pair_block_columns):
                block, tables, columns = block + 1, 0, 0
            tables, columns = tables + 1, columns + width
            out.append((i, block))
        return out

    @property
    def unionability(self) -> DataFrame:
        return self.pair_scores(with_semantic=False).select("q_idx", "c_idx", "unionability")

    # -- stage 6 ---------------------------------------------------------------
    def scores(self) -> DataFrame:
        """Unrounded scores of every upper-triangle pair."""
        ps = self.pair_scores(with_semantic=True)
        return (self.joinability
                .join(self.table_semantic, ["q_idx", "c_idx"])
                .join(ps.select("q_idx", "c_idx", "unionability", "semantic_join", "semantic_union"),
                      ["q_idx", "c_idx"]))

    def labels(self) -> DataFrame:
        """Output rows (L6) for every ordered pair, with q_idx / c_idx kept."""
        def build():
            scored = self._cut(self.scores())
            named = pr.with_names(pr.mirror(scored, self.cfg), self.tables, self.n_tables,
                                  self.cfg.broadcast_limit_bytes)
            return lb.label(named, self.cfg)
        return self._get("labels", build)

    def release(self) -> None:
        """Remove the written profile tables; the state can't be used afterwards."""
        for path in self._made:
            remove_path(self.spark, path)
        self._made.clear()
        self._cache.clear()


def label_lake(lake: Lake, cfg: ScoreConfig | None = None, materialize: bool = True) -> DataFrame:
    """The whole job: returns the labelled pairs (query order not imposed)."""
    state = LakeState(lake, cfg or ScoreConfig(), materialize=materialize)
    return state.labels().drop("q_idx", "c_idx")
