"""Loading of lakes: files that can't be read, errors of the job, part files, pairs."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.operators import pairs as pr
from lakesift.plans.labelling import LakeState
from lakesift.sources import lake as lk
from lakesift.sources.lake import Lake


def parquet_lake(folder, damaged=()):
    for t in range(4):
        table = pa.table({"a": [f"v{i % 9}" for i in range(500)], "b": list(range(t, 500 + t))})
        pq.write_table(table, folder / f"t{t}.parquet", compression="none", use_dictionary=False)
    for t in damaged:
        path = folder / f"t{t}.parquet"
        raw = bytearray(path.read_bytes())
        raw[4:400] = b"\xff" * 396  # the first page of a column; the footer is whole
        path.write_bytes(bytes(raw))
    return Lake.from_folder


@pytest.mark.parametrize("damaged", [(), (1,), (0, 3)])
def test_a_damaged_page_takes_out_its_table_only(spark, lake_dir, damaged):
    parquet_lake(lake_dir, damaged)
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="parquet"), ScoreConfig())
    rows = {r["table_idx"]: r for r in st.manifest().collect()}
    assert [rows[t]["status"] for t in range(4)] == ["error" if t in damaged else "ok" for t in range(4)]
    for t in range(4):
        if t in damaged:
            assert rows[t]["error"].startswith("FAILED_READ_FILE")
        else:
            assert (rows[t]["files"], rows[t]["footer_rows"], rows[t]["rows_read"], rows[t]["error"]) == (1, 500, 500, None)
    good = [t for t in range(4) if t not in damaged]
    assert st.labels().count() == len(good) ** 2


def test_the_profile_alone_finds_damaged_tables(spark, lake_dir):
    parquet_lake(lake_dir, (2,))
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="parquet"), ScoreConfig())
    assert st.labels().count() == 9
    assert {r["table_idx"]: r["status"] for r in st.tables.collect()}[2] == "error"


ERRORS = [
    lambda spark: (_ for _ in ()).throw(RuntimeError("java.lang.OutOfMemoryError at VectorizedParquetRecordReader.nextBatch")),
    lambda spark: spark.range(3).select(F.raise_error(F.lit("No space left on device, ParquetOutputWriter, FAILED_READ_FILE"))).collect(),
    lambda spark: spark.range(3).select(F.expr("1 / (id - id)")).collect(),
    lambda spark: spark.range(3).selectExpr("no_such_column").collect(),
]


@pytest.mark.parametrize("number", range(len(ERRORS)))
def test_errors_of_the_job_are_raised(spark, lake_dir, number):
    parquet_lake(lake_dir)
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="parquet"), ScoreConfig())
    with pytest.raises(Exception) as error:
        st._isolated([0, 1, 2, 3], lambda part: ERRORS[number](spark))
    assert "pytest" not in type(error.value).__module__ and not st.lake.errors


def test_part_files_of_another_column_order(spark, lake_dir):
    folder = lake_dir / "t.csv"
    folder.mkdir()
    write_csv(folder / "p0.csv", ["x", "y"], [["1", "a"], ["2", "b"]])
    write_csv(folder / "p1.csv", ["y", "x"], [["c", "3"], ["d", "4"]])
    write_csv(lake_dir / "u.csv", ["x", "y"], [[str(i + 1), c] for i, c in enumerate("abcd")])
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    values = {}
    for r in st.profiles.values.collect():
        values.setdefault((r["table_idx"], r["col_idx"]), []).append((r["rank"], r["value"]))
    assert {k: [v for _, v in sorted(x)] for k, x in values.items()} == {(t, c): list(v) for t in (0, 1) for c, v in ((0, "1234"), (1, "abcd"))}
    types = {(r["table_idx"], r["col_idx"]): r["inferred_type"] for r in st.profiles.columns.collect()}
    assert types == {(t, c): k for t in (0, 1) for c, k in ((0, "numeric"), (1, "string"))}


def test_part_files_of_other_columns_are_an_error(spark, lake_dir):
    folder = lake_dir / "t.csv"
    folder.mkdir()
    write_csv(folder / "p0.csv", ["x", "y"], [["1", "a"]])
    write_csv(folder / "p1.csv", ["x", "z"], [["2", "b"]])
    write_csv(lake_dir / "u.csv", ["x"], [["1"]])
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    assert "different columns" in st.lake.errors[0] and st.labels().count() == 1


def test_order_of_many_part_files(spark, lake_dir, monkeypatch):
    folder = lake_dir / "t.csv"
    folder.mkdir()
    for p in range(5):
        write_csv(folder / f"p{p}.csv", ["x"], [[f"v{(p * 7 + i) % 16}"] for i in range(6)])

    def samples():
        st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
        return sorted((r["pos"], r["value"]) for r in st.samples.collect())

    want = samples()
    seen = []
    for p in range(5):
        seen += [v for i in range(6) if (v := f"v{(p * 7 + i) % 16}") not in seen]
    assert [v for _, v in want] == seen
    monkeypatch.setattr(lk, "ORDER_FILES", 1)
    assert samples() == want


@pytest.mark.parametrize("n,queries,candidates,failed", [
    (1, None, None, []), (9, None, None, []), (9, 3, None, [2]), (9, None, 4, [0, 8]), (9, 2, 5, []), (9, 7, 3, [1]), (9, 20, 20, []), (700, 0, 0, [])])
def test_pairs_are_unranked_from_a_range(spark, n, queries, candidates, failed):
    cfg = ScoreConfig(num_queries=queries, max_candidates=candidates)
    got = [tuple(r) for r in pr.upper_pairs(spark, n, failed, cfg).collect()]
    limits = (queries or n, candidates or n)
    want = {(min(q, c), max(q, c)) for q in range(min(n, limits[0])) for c in range(min(n, limits[1])) if q not in failed and c not in failed}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_large_lake(spark):
    n = 3_000_000
    pairs = pr.upper_pairs(spark, n, [], ScoreConfig(num_queries=None))
    # the arithmetic at the ends of rows, far out
    total = n * (n + 1) // 2
    ids = [0, n - 1, n, 2 * n - 2, 2 * n - 1, total // 2, total - 3, total - 2, total - 1]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" in plan and "LocalRelation" not in plan
    rows = {}
    for a in (0, 1, n // 3, n - 2, n - 1):
        start = a * n - a * (a - 1) // 2
        rows[start], rows[start + n - a - 1] = (a, a), (a, n - 1)
    low = pr.unranked(spark.createDataFrame([(i,) for i in rows] + [(i,) for i in ids], "id bigint"), n)
    got = {r["id"]: (r["q_idx"], r["c_idx"]) for r in low.collect()}
    assert all(got[i] == rows[i] for i in rows)
    assert all(q * n - q * (q - 1) // 2 + c - q == i and q <= c < n for i, (q, c) in got.items())
