"""Scores and labels: properties, boundaries, metamorphic checks."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.operators import labels as lb, semantic as sm
from lakesift.plans import queries as Q
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels_sf(spark):
    return [r.asDict() for r in Q.q_pair_labels(spark, SF).collect()]


def test_all_ordered_pairs(labels_sf):
    assert len(labels_sf) == 14 * 14
    assert len({(r["query_table"], r["candidate_table"]) for r in labels_sf}) == 196


def test_scores_in_unit_interval_and_symmetric(labels_sf):
    by = {(r["query_table"], r["candidate_table"]): r for r in labels_sf}
    for (q, c), r in by.items():
        for k in ("similarity", "joinability", "unionability", "semantic_table",
                  "semantic_join", "semantic_union"):
            assert 0.0 <= r[k] <= 1.0
        s = by[(c, q)]
        assert {k: v for k, v in r.items() if k not in ("query_table", "candidate_table")} == \
               {k: v for k, v in s.items() if k not in ("query_table", "candidate_table")}


def test_self_pairs(labels_sf):
    for r in labels_sf:
        if r["query_table"] == r["candidate_table"]:
            assert r["unionability"] == 1.0
            assert r["semantic_table"] == 1.0


def test_gate(labels_sf):
    for r in labels_sf:
        if r["semantic_table"] < 0.25:
            assert r["semantic_join"] == 0.0 and r["semantic_union"] == 0.0
        assert r["similarity"] == max(r["joinability"], r["unionability"])
        assert r["is_ground_truth"] == max(r["is_join_gt"], r["is_union_gt"])


def test_label_boundaries_use_unrounded_scores(spark):
    rows = [(0, 0, 0.15, 0.0, 0.5, 0.40, 0.0), (0, 1, 0.14996, 0.0, 0.5, 0.9, 0.0),
            (1, 0, 0.0, 0.20, 0.5, 0.0, 0.40), (1, 1, 0.0, 0.19999, 0.5, 0.0, 0.9),
            (2, 2, 0.9, 0.9, 0.5, 0.39999, 0.39999)]
    df = spark.createDataFrame(rows, "q_idx int, c_idx int, joinability double, unionability double, "
                                     "semantic_table double, semantic_join double, semantic_union double")
    df = df.withColumn("query_table", F.lit("q")).withColumn("candidate_table", F.lit("c"))
    out = {(r.q_idx, r.c_idx): r for r in lb.label(df, ScoreConfig()).collect()}
    assert out[(0, 0)].is_join_gt == 1
    assert out[(0, 1)].is_join_gt == 0 and out[(0, 1)].joinability == 0.15   # rounded after labelling
    assert out[(1, 0)].is_union_gt == 1
    assert out[(1, 1)].is_union_gt == 0 and out[(1, 1)].unionability == 0.2
    assert out[(2, 2)].is_ground_truth == 0


def test_numeric_cardinality_cutoff_is_strict(spark, lake_dir):
    # 5 rows, 4 distinct -> 0.8 (eligible); 5 distinct -> 1.0 (skipped)
    write_csv(lake_dir / "x.csv", ["k"], [["1"], ["2"], ["3"], ["4"], ["4"]])
    write_csv(lake_dir / "y.csv", ["k"], [["1"], ["2"], ["3"], ["4"], ["5"]])
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    j = {(r.q_idx, r.c_idx): r.joinability for r in st.joinability.collect()}
    assert j[(0, 0)] == 1.0
    assert j[(0, 1)] == 0.0       # y.k is a high-cardinality numeric column
    assert j[(1, 1)] == 0.0


def test_row_order_does_not_change_syntactic_scores(spark, tmp_path):
    rnd = random.Random(7)
    tables = {
        "p.csv": (["id", "cat", "val"], [[str(i), f"c{i % 7}", str(i % 11)] for i in range(60)]),
        "q.csv": (["cat", "n"], [[f"c{i % 5}", str(i % 13)] for i in range(40)]),
        "r.csv": (["n", "s"], [[str(i % 9), f"s{i % 4}"] for i in range(30)]),
    }
    scores = []
    for variant in ("a", "b"):
        d = tmp_path / variant
        d.mkdir()
        for name, (header, rows) in tables.items():
            rows = list(rows)
            if variant == "b":
                rnd.shuffle(rows)
            write_csv(d / name, header, rows)
        st = LakeState(Lake.from_folder(spark, str(d), fmt="csv"), ScoreConfig())
        j = {(r.q_idx, r.c_idx): r.joinability for r in st.joinability.collect()}
        u = {(r.q_idx, r.c_idx): r.unionability for r in st.unionability.collect()}
        scores.append((j, u))
    assert scores[0][0] == scores[1][0]
    for k, v in scores[0][1].items():
        assert abs(v - scores[1][1][k]) < 1e-12


def test_token_stream_embedding_equals_embedding_the_text(spark):
    st = Q.state(spark, SF)
    texts = sm.table_texts(st.tables, st.profiles, st.samples, st.cfg)
    direct = sm.token_bag(texts, ["table_idx"], F.col("table_text"), st.cfg.embedding_dim)
    stream = sm.table_bags(st.tables, st.profiles, st.samples, st.cfg)
    assert direct.exceptAll(stream).count() == 0 and stream.exceptAll(direct).count() == 0
    ctexts = sm.column_texts(st.profiles, st.samples)
    cdirect = sm.token_bag(ctexts, ["table_idx", "col_idx"], F.col("column_text"), st.cfg.embedding_dim)
    cstream = sm.column_bags(st.profiles, st.samples, st.cfg)
    assert cdirect.exceptAll(cstream).count() == 0 and cstream.exceptAll(cdirect).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["query_table", "candidate_table", "similarity", "joinability", "unionability",
                          "semantic_table", "semantic_join", "semantic_union", "is_join_gt",
                          "is_union_gt", "is_ground_truth"]
    assert df.count() == 196


def test_model_embedder_hook_and_no_model(spark):
    def letter_counts(texts):
        # toy model (local, so it is shipped by value): 26 letter counts per text
        out = []
        for t in texts:
            v = [0.0] * 26
            for ch in t.lower():
                if "a" <= ch <= "z":
                    v[ord(ch) - 97] += 1.0
            out.append(v)
        return out

    lake = Lake.from_paths(spark, Q.lake_paths(SF)[:3])
    st = LakeState(lake, ScoreConfig(embedder=letter_counts))
    rows = st.labels().collect()
    assert len(rows) == 9
    assert all(r.semantic_table > 0.5 for r in rows if r.query_table == r.candidate_table)
    st0 = LakeState(lake, ScoreConfig(embedder="none"))
    rows0 = st0.labels().collect()
    assert {r.semantic_table for r in rows0} == {0.5}
    assert {r.semantic_join for r in rows0} == {0.0} and {r.is_ground_truth for r in rows0} == {0}


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hot_value_salting_gives_the_same_overlap(spark):
    lake = Lake.from_paths(spark, Q.lake_paths(SF))
    plain = LakeState(lake, ScoreConfig(value_salt_buckets=1))
    # every value counts as hot and is split over 3 x 3 salt slices
    salted = LakeState(lake, ScoreConfig(hot_value_postings=0, value_salt_buckets=3), materialize=False)
    cols = ["q_idx", "c_idx", "q_col", "c_col", "k"]
    assert _rows(plain.overlap, cols) == _rows(salted.overlap, cols)
    plan = salted.overlap._jdf.queryExecution().optimizedPlan().toString()
    assert "salt_q" in plan and "salt_c" in plan


def test_no_broadcast_fallback_gives_the_same_scores(spark):
    lake = Lake.from_paths(spark, Q.lake_paths(SF)[:6])
    a = LakeState(lake, ScoreConfig())
    b = LakeState(lake, ScoreConfig(broadcast_limit_bytes=0))
    cols = ["query_table", "candidate_table", "joinability", "unionability", "semantic_table",
            "semantic_join", "semantic_union", "is_ground_truth"]
    assert _rows(a.labels(), cols) == _rows(b.labels(), cols)


def test_profile_in_table_batches_equals_one_job(spark):
    lake = Lake.from_paths(spark, Q.lake_paths(SF))
    one = LakeState(lake, ScoreConfig(), materialize=True)
    batched = LakeState(lake, ScoreConfig(profile_batch_tables=4), materialize=True)
    cols = ["table_idx", "col_idx", "inferred_type", "n_rows", "n_non_null", "n_distinct", "n_values"]
    assert _rows(one.profiles.columns, cols) == _rows(batched.profiles.columns, cols)
    vcols = ["table_idx", "col_idx", "value", "freq", "rank"]
    assert _rows(one.profiles.values, vcols) == _rows(batched.profiles.values, vcols)
    scols = ["table_idx", "col_idx", "value", "pos"]
    assert _rows(one.samples, scols) == _rows(batched.samples, scols)


def test_blocked_pair_kernel_equals_single_block(spark):
    lake = Lake.from_paths(spark, Q.lake_paths(SF))
    one = LakeState(lake, ScoreConfig(pair_block_tables=64))
    many = LakeState(lake, ScoreConfig(pair_block_tables=4))   # 4 blocks, 10 block pairs
    cols = ["q_idx", "c_idx", "n_q", "n_c", "unionability", "semantic_join", "semantic_union"]
    a = _rows(one.pair_scores(True), cols)
    b = _rows(many.pair_scores(True), cols)
    assert len(a) == 14 * 15 // 2
    assert [r[:4] for r in a] == [r[:4] for r in b]
    for x, y in zip(a, b):
        assert all(abs(u - v) < 1e-12 for u, v in zip(x[4:], y[4:]))


def test_renamed_and_permuted_columns_keep_syntactic_scores(spark, tmp_path):
    tables = {
        "p.csv": (["id", "cat", "val"], [[str(i), f"c{i % 7}", str(i % 11)] for i in range(60)]),
        "q.csv": (["cat", "n"], [[f"c{i % 5}", str(i % 13)] for i in range(40)]),
        "r.csv": (["n", "s", "t"], [[str(i % 9), f"s{i % 4}", f"t{i % 3}"] for i in range(30)]),
    }
    results = []
    for variant in ("plain", "renamed"):
        d = tmp_path / variant
        d.mkdir()
        for name, (header, rows) in tables.items():
            if variant == "renamed":
                order = list(reversed(range(len(header))))
                header = [f"x_{header[i]}_{k}" for k, i in enumerate(order)]
                rows = [[r[i] for i in order] for r in rows]
            write_csv(d / name, header, rows)
        st = LakeState(Lake.from_folder(spark, str(d), fmt="csv"), ScoreConfig())
        results.append({(r.query_table, r.candidate_table): (r.joinability, r.unionability)
                         for r in st.labels().collect()})
    assert results[0] == results[1]


def test_split_lake_parts_are_unionable(spark, tmp_path):
    d = tmp_path / "split"
    d.mkdir()
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    prios = sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect())
    for i, p in enumerate(prios):
        (orders.where(F.col("o_orderpriority") == p).coalesce(1)
         .write.parquet(str(d / f"part{i}")))
    import glob
    import shutil

    flat = tmp_path / "lake"
    flat.mkdir()
    for i in range(len(prios)):
        src = glob.glob(str(d / f"part{i}" / "*.parquet"))[0]
        shutil.copy(src, flat / f"orders_{i}.parquet")
    st = LakeState(Lake.from_folder(spark, str(flat), fmt="parquet"), ScoreConfig())
    rows = st.labels().collect()
    assert len(rows) == len(prios) ** 2
    for r in rows:
        assert r.unionability >= 0.2 and r.is_union_gt == 1 and r.is_ground_truth == 1


def test_blocks_hold_the_column_budget():
    from types import SimpleNamespace

    widths = [3, 600, 4, 200, 200, 200, 5, 5]
    lake = SimpleNamespace(ok_indices=lambda: list(range(len(widths))),
                           loaded={i: SimpleNamespace(columns=[0] * w) for i, w in enumerate(widths)})
    blocks = LakeState._blocks(SimpleNamespace(lake=lake, cfg=ScoreConfig(pair_block_tables=3)))
    assert blocks == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3), (7, 3)]
