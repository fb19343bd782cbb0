"""Lake loading (S1-S5, R1-R3) and column profiles (P1-P10) on hand-made CSV lakes."""

import pytest
from pyspark.sql import functions as F

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.functions import text as tx
from lakesift.operators import profile as pf, semantic as sm
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake, dedupe_names


@pytest.fixture
def edge_lake(spark, lake_dir):
    write_csv(lake_dir / "a_all_null.csv", ["a", "b"], [["", "1"], ["", "x"], ["", "2"]])
    write_csv(lake_dir / "b_header_only.csv", ["p", "q"], [])
    write_csv(lake_dir / "c_mixed_case.csv", ["k"], [["A"], ["a "], ["B"]])
    write_csv(lake_dir / "d_num_text.csv",
              ["v1", "v2", "v3", "v4", "v5", "v6", "v7"],
              [["1e5", "1,000", "5%", "true", "1d", "1_000", "2020-01-01"],
               [" 1 ", "2", "6", "false", "2", "3", "2020-01-02"],
               ["+2", "3", "7", "True", "3", "4", "2020-01-03"],
               [".5", "4", "8", "FALSE", "4", "5", "2020-01-04"]])
    write_csv(lake_dir / "e_na_tokens.csv", ["v", "flag"],
              [["NA", "true"], ["null", ""], ["x", "False"], ["n/a", "true"], ["", "false"]])
    with open(lake_dir / "f_dup_header.csv", "w") as f:
        f.write("a,a,b\n1,2,3\n4,5,6\n")
    (lake_dir / "g_empty.csv").write_text("")
    write_csv(lake_dir / "h_wide9.csv", [f"c{i}" for i in range(9)],
              [[f"v{i}{r}" if i != 3 else "" for i in range(9)] for r in range(3)])
    lake = Lake.from_folder(spark, str(lake_dir), fmt="csv")
    return LakeState(lake, ScoreConfig())


def profiles_by_name(st):
    tables = {r.table_idx: r.table_name for r in st.tables.collect()}
    return {(tables[r.table_idx], r.column_name): r for r in st.profiles.columns.collect()}


def test_listing_order_names_and_failed_table(edge_lake):
    st = edge_lake
    rows = sorted(st.tables.collect(), key=lambda r: r.table_idx)
    assert [r.table_name for r in rows] == [
        "a_all_null.csv", "b_header_only.csv", "c_mixed_case.csv", "d_num_text.csv",
        "e_na_tokens.csv", "f_dup_header.csv", "g_empty.csv", "h_wide9.csv"]
    status = {r.table_name: r.status for r in rows}
    assert status["g_empty.csv"] == "error"
    assert all(v == "ok" for k, v in status.items() if k != "g_empty.csv")


def test_all_null_and_header_only(edge_lake):
    p = profiles_by_name(edge_lake)
    a = p[("a_all_null.csv", "a")]
    assert (a.inferred_type, a.cardinality_ratio, a.null_ratio, a.n_values, a.n_rows) == ("string", 0.0, 1.0, 0, 3)
    b = p[("a_all_null.csv", "b")]
    assert b.inferred_type == "string" and b.n_non_null == 3
    for col in ("p", "q"):
        h = p[("b_header_only.csv", col)]
        assert (h.n_rows, h.inferred_type, h.null_ratio, h.n_values) == (0, "string", 1.0, 0)


def test_raw_cardinality_vs_normalised_set(edge_lake):
    c = profiles_by_name(edge_lake)[("c_mixed_case.csv", "k")]
    assert c.cardinality_ratio == 1.0            # 'A', 'a ', 'B' are 3 raw values
    assert c.n_values == 2                       # {'a', 'b'} after lower + strip
    vals = {r.value for r in edge_lake.profiles.values.where("table_idx = 2").collect()}
    assert vals == {"a", "b"}


def test_type_inference_of_text(edge_lake):
    p = profiles_by_name(edge_lake)
    got = {c: p[("d_num_text.csv", c)].inferred_type for c in ("v1", "v2", "v3", "v4", "v5", "v6", "v7")}
    assert got == {"v1": "numeric", "v2": "string", "v3": "string", "v4": "numeric",
                   "v5": "string", "v6": "string", "v7": "string"}


def test_na_tokens_are_nulls(edge_lake):
    p = profiles_by_name(edge_lake)
    e = p[("e_na_tokens.csv", "v")]
    assert (e.n_rows, e.n_non_null) == (5, 1)
    assert abs(e.null_ratio - 0.8) < 1e-12
    # booleans stay a number class with a missing cell
    assert p[("e_na_tokens.csv", "flag")].inferred_type == "numeric"


def test_duplicate_headers_renamed():
    assert dedupe_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]


def test_duplicate_header_table(edge_lake):
    names = sorted(k[1] for k in profiles_by_name(edge_lake) if k[0] == "f_dup_header.csv")
    assert names == ["a", "a.1", "b"]


def test_texts_first_appearance_and_column_cut(edge_lake):
    st = edge_lake
    texts = {(r.table_idx, r.col_idx): r.column_text
             for r in sm.column_texts(st.profiles, st.samples).collect()}
    assert texts[(2, 0)] == "Column: k | Type: string | Values: a, a , b"
    assert texts[(0, 0)] == "Column: a | Type: empty"
    ttext = {r.table_idx: r.table_text
             for r in sm.table_texts(st.tables, st.profiles, st.samples, st.cfg).collect()}
    t = ttext[7]
    assert t.startswith("Table: h_wide9.csv | c0(string): v00, v01, v02 | c1(string)")
    assert "c3(" not in t and "c8(" not in t and "c7(string): v70, v71, v72" in t
    assert ttext[1] == "Table: b_header_only.csv"


def test_top_k_ties_keep_first_appearance(spark, lake_dir):
    import random

    words = [f"w{i:03d}" for i in range(300)]
    random.Random(3).shuffle(words)
    rows = [["hot"], ["hot"]] + [[w] for w in words]        # 'hot' twice, 300 words once
    write_csv(lake_dir / "ties.csv", ["k"], rows)
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    got = [r.value for r in sorted(st.profiles.values.collect(), key=lambda r: r.rank)]
    assert got == ["hot"] + words[:199]
    assert st.profiles.columns.collect()[0].n_values == 200


def test_query_prefix_and_candidate_cap(spark, lake_dir):
    for name in ("a", "c", "d"):
        write_csv(lake_dir / f"{name}.csv", ["x"], [["1"], ["2"]])
    (lake_dir / "b.csv").write_text("")
    lake = Lake.from_folder(spark, str(lake_dir), fmt="csv")
    st = LakeState(lake, ScoreConfig(max_candidates=2))
    got = sorted((r.query_table, r.candidate_table) for r in st.labels().collect())
    # candidates = first 2 listed files (a, b); b failed to load
    assert got == [("a.csv", "a.csv"), ("c.csv", "a.csv"), ("d.csv", "a.csv")]
    st = LakeState(lake, ScoreConfig(num_queries=1))
    got = sorted((r.query_table, r.candidate_table) for r in st.labels().collect())
    assert got == [("a.csv", "a.csv"), ("a.csv", "c.csv"), ("a.csv", "d.csv")]


def test_csv_sink_header_and_order(spark, lake_dir, tmp_path):
    from lakesift.config import OUTPUT_COLUMNS
    from lakesift.operators import labels as lb

    for name in ("t1", "t2"):
        write_csv(lake_dir / f"{name}.csv", ["x", "y"], [["1", "a"], ["2", "b"], ["2", "c"]])
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    out = str(tmp_path / "out")
    lb.write_labels(st.labels(), out)
    import glob

    files = sorted(glob.glob(out + "/part-*.csv"))
    lines = [ln for f in files for ln in open(f).read().splitlines()]
    assert lines[0] == ",".join(OUTPUT_COLUMNS)
    body = [ln for ln in lines if not ln.startswith("query_table")]
    assert [ln.split(",")[:2] for ln in body] == [["t1.csv", "t1.csv"], ["t1.csv", "t2.csv"],
                                                 ["t2.csv", "t1.csv"], ["t2.csv", "t2.csv"]]


def test_float_nan_is_missing(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path / "pq"
    d.mkdir()
    pq.write_table(pa.table({"x": pa.array([1.5, float("nan"), None, 2.0], pa.float64()),
                             "s": pa.array(["a", "b", "c", "d"])}), str(d / "t.parquet"))
    st = LakeState(Lake.from_folder(spark, str(d), fmt="parquet"), ScoreConfig())
    x = {r.column_name: r for r in st.profiles.columns.collect()}["x"]
    assert (x.n_rows, x.n_non_null, x.inferred_type, x.n_values) == (4, 2, "numeric", 2)
    assert abs(x.null_ratio - 0.5) < 1e-12


def test_query_prefix_and_candidate_cap_together(spark, lake_dir):
    for name in ("a", "c", "d", "e"):
        write_csv(lake_dir / f"{name}.csv", ["x"], [["1"], ["2"]])
    (lake_dir / "b.csv").write_text("")
    lake = Lake.from_folder(spark, str(lake_dir), fmt="csv")       # a b(failed) c d e
    st = LakeState(lake, ScoreConfig(num_queries=3, max_candidates=4))
    got = sorted((r.query_table, r.candidate_table) for r in st.labels().collect())
    queries, candidates = ["a.csv", "c.csv"], ["a.csv", "c.csv", "d.csv"]
    assert got == sorted((q, c) for q in queries for c in candidates)


def test_scans_as_wide_as_the_session_are_not_spread(spark, tmp_path):
    wide = spark.sparkContext.defaultParallelism
    spark.range(wide * 100).repartition(wide).write.parquet(str(tmp_path / "wide.parquet"))
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "narrow.parquet"))
    lake = Lake.from_folder(spark, str(tmp_path), fmt="parquet", rebalance_bytes=1)
    parts = {t.name: lake._rebalance_parts(t, lake.loaded[t.table_idx]) for t in lake.tables}
    narrow = next(n for n in parts if "narrow" in n)
    assert parts.pop(narrow) == wide and list(parts.values()) == [0]


def test_columns_of_distinct_forms_are_ranked_without_regrouping(spark, tmp_path):
    rows = [(i % 7, float(i % 5) * 1e12 - 1e-9, i % 3 == 0, ["a", "A ", " a", "B", None][i % 5], f"2024-01-0{i % 9 + 1}") for i in range(300)]
    df = spark.createDataFrame(rows, "n int, x double, b boolean, s string, d string").withColumn("d", F.col("d").cast("date"))
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    st = LakeState(Lake.from_folder(spark, str(tmp_path), fmt="parquet"), ScoreConfig())
    raw, kinds = st._raw([0])[0], st._kinds([0])
    assert [r["distinct_forms"] for r in kinds.orderBy("col_idx").collect()] == [True, True, True, False, True]
    for form in (tx.normalize_value, F.lower):
        want, got = (sorted(map(tuple, pf.counted(raw, form, k).collect())) for k in (None, kinds))
        assert got == want
    # in the regrouping only the text column's values remain
    assert {r["col_idx"] for r in raw.join(kinds, ["table_idx", "col_idx"]).where("not distinct_forms").collect()} == {3}
