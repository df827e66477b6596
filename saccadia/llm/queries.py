"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia.llm import (
    alignment,
    bpe,
    classifier,
    graph_index,
    jaccard,
    keyed_ids,
    licenses,
    lines,
    oracles,
    packing,
    rules,
    spelling,
    storage,
    substrings,
    token_counts,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.nearest(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.apply_policy(rules.ledger(rules.measure(docs)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35, carry=["doc_id"]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.clean(docs).select("rest.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join_texts(table(spark, sf_dir, "documents"), n=3, percent=90)
    return joined.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_ids.stored(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_graph_neighbours, op3_quality_classifier, op4_quality_rules, op5_bpe, op6_token_counts, op7_license_scan,
    op8_substring_dedup, op9_line_dedup, op10_ngram_jaccard, op11_token_alignment, op12_keyed_ids, op13_spelling_variants,
)}
ORACLES: dict[str, str] = {
    "op4_quality_rules": oracles.QUALITY_RULES, "op8_substring_dedup": oracles.SUBSTRING_DEDUP, "op9_line_dedup": oracles.LINE_DEDUP,
    "op10_ngram_jaccard": oracles.NGRAM_JACCARD,
}
