"""Operators that SQL can express: edge cases against DuckDB, and empty tables."""

import random
import textwrap

import pytest

from lakesift.llm import quality
from lakesift.llm.oracle import ORACLE_SQL
from lakesift.llm.queries import QUERIES

from .conftest import prose, same


@pytest.mark.parametrize("name", ["op3_quality_rules", "op8_source_mix"])
def test_edge_cases_equal_sql(spark, edges, duck, name):
    same(QUERIES[name](spark, edges), *duck(edges, ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_exact_dedup_edges(spark, edges):
    rows = QUERIES["op6_exact_dedup"](spark, edges).collect()
    docs = spark.read.parquet(f"{edges}/documents.parquet").select("doc_id", "text").collect()
    groups = {}
    for r in docs:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    assert len(rows) == len(docs)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in rows})
    for r in rows:
        ids = next(g for g in groups.values() if r["doc_id"] in g and len(g) == r["group_size"] and (
            r["keep_id"] == max((i for i in g if i is not None), default=None)))
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)


def test_exact_dedup_sets_digest_clashes_apart(spark, edges, monkeypatch):
    from pyspark.sql import functions as F

    from lakesift.llm import exact_dedup

    # all digests of equal length texts clash: the byte check must tell them apart
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.char_length(c).cast("string"))
    rows = exact_dedup.exact_dedup(spark, f"{edges}/documents.parquet").collect()
    monkeypatch.undo()
    texts = {}
    for r in spark.read.parquet(f"{edges}/documents.parquet").select("text").collect():
        texts[r["text"] or ""] = texts.get(r["text"] or "", 0) + 1
    assert sum(r["kept"] for r in rows) == len(texts)
    assert sorted(r["group_size"] for r in rows) == sorted(n for n in texts.values() for _ in range(n))


def test_exact_dedup_in_several_batches(spark, edges, monkeypatch):
    from pyspark.sql import functions as F

    from lakesift.llm import exact_dedup

    path = f"{edges}/documents.parquet"
    # several batches at the size of the projection
    assert exact_dedup.BYTES_PER_BATCH * 4 <= 30e9
    folders = []

    def scratch(spark, name, made=exact_dedup.scratch_path):
        folders.append(made(spark, name))
        return folders[-1]

    once = sorted(map(repr, exact_dedup.exact_dedup(spark, path).collect()))
    monkeypatch.setattr(exact_dedup, "BYTES_PER_BATCH", 1)
    monkeypatch.setattr(exact_dedup, "scratch_path", scratch)
    assert sorted(map(repr, exact_dedup.exact_dedup(spark, path).collect())) == once
    batches = spark.read.schema("digest string, n bigint, batch int").parquet(folders[0])
    assert batches.select("batch").distinct().count() > 1
    # texts of one batch met the state of another
    assert batches.groupBy("digest").agg(F.count_distinct("batch").alias("b")).where("b > 1").count() > 0


def test_clean_keeps_columns_and_cuts_lines(spark, edges):
    from lakesift.llm import quality

    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = quality.clean(docs)
    assert out.columns == docs.columns
    cut = out.where("doc_id = 13").first()
    assert "About" not in cut["text"] and cut["n_chars"] == len(cut["text"])
    assert out.where("doc_id = 11").first()["text"] == docs.where("doc_id = 11").first()["text"]
    assert out.where("doc_id in (0, 1, 2, 14, 18)").count() == 0


CLEAN = {
    "wrapped": "\n\n".join("\n".join(textwrap.wrap(" ".join(f"Word{i} of{k} prose." if i % 9 == 8 else f"word{i} of{k}" for i in range(40)), 70)) for k in range(3)),
    "hindi": "\n".join(" ".join(f"शब्द{k}{i}" for i in range(8)) + "।" for k in range(10)),
    "thai": "\n".join(" ".join(f"คำ{k}{i}" for i in range(8)) for k in range(10)),
    "verse": "\n\n".join("\n".join(f"line{k}{i} of{k}{i} some{k}{i} verse{k}{i}" + ("," if i < 3 else ".") for i in range(4)) for k in range(6)),
    "unended": "\n".join(" ".join(f"long{k}{i}" for i in range(12)) for k in range(6)),
    "windows": "\r\n".join(" ".join(f"{w}{k}" for w in "The sentence of number ends here now".split()) + "." for k in range(12)),
}


def test_clean_texts_of_any_layout_are_kept(spark):
    docs = spark.createDataFrame(list(CLEAN.items()), "doc_id string, text string")
    for row in quality.judge(docs).collect():
        assert row["kept"] and row["n_removed_lines"] == 0 and row["cleaned"] == CLEAN[row["doc_id"]], row


def test_blank_lines_stay_where_lines_are_cut(spark):
    text = prose(1, 2) + "\n\n" + "Home\nAbout us\n\n \n" + prose(3, 4) + "\n"
    (row,) = quality.judge(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert row["cleaned"] == text.replace("Home\nAbout us\n", "") and row["n_removed_lines"] == 2 and row["kept"]


def test_line_rules_equal_sql(spark, duck, tmp_path):
    r = random.Random(5)
    parts = ["Home | About | Contact | Login", "click here", "short", "A long line of words that has no end at all", "It ends.", "", " \t ", "BIG LETTERS ALL THE WAY UP",
             "#### $$$", "“Quoted.”", "हिंदी।", "ไทย", "完。", "Read more about it in the text below, if you like.", "x\r", "End.\r", "\x0b", "No end here »"]
    rows = [(i, "\n".join(r.choices(parts, k=r.randrange(12))) + r.choice(["", "\n", "\n\n"]) + prose(*range(r.randrange(6)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("pages", "embeddings"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/{t}.parquet")
    same(QUERIES["op3_quality_rules"](spark, str(tmp_path)), *duck(str(tmp_path), ORACLE_SQL["op3_quality_rules"]))
