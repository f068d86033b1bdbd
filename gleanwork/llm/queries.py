"""One query per operator, over whole tables, and the pipeline: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleanwork.llm import chunks, counts, lines, merkle, mixing, near, negatives, packing, pii, quality, substrings, toxicity, vectors
from gleanwork.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_quality_rules(spark, sf):
    rows = quality.ledger(table(spark, sf, "documents"))
    return rows.select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("v2").alias("kept"),
        "failed_rules",
        "n_lines",
        "n_upper",
        "n_stutter",
    )


@query
def op8_line_dedup(spark, sf):
    rows = lines.marked(table(spark, sf, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_removed", F.col("kept").alias("text"))


@query
def op2_source_mixing(spark, sf):
    return mixing.shares(table(spark, sf, "documents"))


@query
def op4_minhash_dedup(spark, sf):
    return near.near_duplicates(table(spark, sf, "documents"))


@query
def op7_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)


@query
def op9_toxicity(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_token_counts(spark, sf):
    return counts.corpus_totals(table(spark, sf, "documents"), fresh_path(spark, "rollup"))


@query
def op3_embedding_dedup(spark, sf):
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query
def op1_substring_dedup(spark, sf):
    rows = substrings.without_repeats(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_pii(spark, sf):
    rows = pii.personal_data(table(spark, sf, "documents"))
    base, every = pii.written(F.col("base")), pii.written(F.concat("base", "added"))
    return rows.select("doc_id", *[pii.count_of(kind) for kind in pii.BASE], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


@query
def op12_exact_dedup(spark, sf):
    return chunks.exact_groups(table(spark, sf, "documents"))


@query
def op11_merkle_manifest(spark, sf):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.when(crc % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf, "documents"), cut)


@query
def op13_hard_negatives(spark, sf):
    return negatives.hard_negatives(negatives.moved_labels(table(spark, sf, "embeddings")))


@query
def quality_ablation(spark, sf):
    """What each rule costs under each policy."""
    return quality.ablation(quality.ledger(table(spark, sf, "documents")))
