"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import (
    bpe, class_lm, divergence, exact_dedup, html_extract, license_scan, mixing, multi_index, ngram_join, pii, quality, setsketch, url_filter,
)
from lakesift.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"), ngram_join.Join(words=4, pct=85))
    return found.select("doc_id", "n_shingles", "component_id")


# The rules of the query.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.parse_rules(list(URL_RULES))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned")


def byte_bpe(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Digests of the ids and of the decoded bytes of each text."""
    path = public_tokenizers.path(ranks)
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return bpe.decode(tokens, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str, secret: bytes = b"key of the registered query") -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), secret)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.Mix(weights=(3.0, 1.0, 2.0), share=1.5, epochs=2)
    return mixing.mix(table(spark, sf_dir, "documents"), plan).drop("copies")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"), divergence.Audit(min_docs=30, smooth=5, top=50))


def op12_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents"), ngram_join.Join(words=2, pct=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = multi_index.Mining(every=100, positives=5, negatives=10, low_pct=30, high_pct=90)
    return multi_index.hard_negatives(table(spark, sf_dir, "embeddings"), plan)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_class_lm": op7_class_lm,
    "op8_source_mix": op8_source_mix,
    "op9_html_extract": op9_html_extract,
    "op10_license_scan": op10_license_scan,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_setsketch_dedup": op12_setsketch_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
