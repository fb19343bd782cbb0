"""The pipeline: columns, decisions that take effect, and a whole run by brute force."""

import ast
import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from lakesift.llm import bpe, quality
from lakesift.llm.oracle import ORACLE_SQL
from lakesift.plans.util import ensure_checkpoint_dir

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, edges, tmp_path):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, edges)
        if i + 1 < len(P.STAGES):
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert 6 not in kept["quality rules"] or Counter(kept["exact dedup"])[6] <= 1
    assert len(set(kept["exact dedup"]) & {11, 12}) <= 1
    assert set(kept["n-gram Jaccard join"]) <= set(kept["exact dedup"])
    assert len(kept["byte-level BPE"]) == len(kept["mixing sources to target weights"])


def test_stages_on_an_empty_table(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs, empty).count() == 0, name


def test_run_by_brute_force(spark, duck, tmp_path):
    """Rows, digests, survivors and copies of a run, each stage done again by other
    means: equal texts in a dictionary, near copies by all pairs, the mix by SQL,
    tokens by the tokenizer library."""
    judged = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = {r["doc_id"]: r["cleaned"] for r in judged.where("kept").select("doc_id", "cleaned").collect()}
    last = {}
    for key in sorted(texts):
        last[texts[key]] = key
    rows = [(key, text) for text, key in last.items()]
    low = {}
    for line in brute(rows, 5, 80):
        key, size, head = ast.literal_eval(line)
        low[key] = head if size else key
    kept = [(key, text) for key, text in rows if low[key] == key]
    assert len(kept) < len(rows) < len(texts)

    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    mixed = spark.createDataFrame([(k, t, sources[k]) for k, t in kept], "doc_id bigint, text string, source string")
    mixed.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("pages", "embeddings"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/{t}.parquet")
    names, found = duck(str(tmp_path), ORACLE_SQL["op8_source_mix"])
    place = {n: i for i, n in enumerate(names)}
    copies = {r[place["doc_id"]]: r[place["taken"]] // r[place["size"]] if r[place["size"]] else 0 for r in found}

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, text in kept:
        ids = library.encode_ordinary(text)
        row = (key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * copies[key]
    assert sorted(want) == sorted(tuple(r) for r in P.run(spark, SF).collect())


def test_near_duplicates_leave_only_the_rows_that_go(spark, edges):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = P.near_duplicates(spark, docs, edges)
    left = [x for x in set(os.listdir(folder)) - before if not x.startswith("lakesift-pyfiles-")]
    assert len(left) == 1 and left[0].startswith("lakesift-near-goes-")
    assert 0 < kept.count() < docs.count()
