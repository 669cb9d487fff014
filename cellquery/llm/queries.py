"""The registered queries of this package: each operator on its whole table, and the pipeline."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquery.llm import (
    ann,
    centroids,
    decontaminate,
    lm,
    mixing,
    negatives,
    ngram_join,
    oracle,
    pivots,
    quality,
    sharding,
    substrings,
    suffixes,
    tokens,
)
from cellquery.session import ship

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        @functools.wraps(run)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = (shipped, sql)
        return run

    return register


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


@query("op1_histogram_mix", oracle.MIX)
def histogram_mix(table) -> DataFrame:
    return mixing.mix(table("documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query("op2_difference_cover_dedup", oracle.SUBSTRINGS)
def difference_cover_dedup(table) -> DataFrame:
    return substrings.remove_repeats(table("documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", F.col("sha").alias("kept_sha256")
    )


@query("op3_multiprobe_neighbours")
def multiprobe_neighbours(table) -> DataFrame:
    found = ann.nearest(table("embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op4_heap_merge_tokens")
def heap_merge_tokens(table) -> DataFrame:
    found = tokens.count_tokens(table("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


@query("op5_maxent_scores")
def maxent_scores(table) -> DataFrame:
    return lm.score_all(table("documents")).withColumnRenamed("id", "doc_id")


@query("op6_positional_hits", oracle.HITS)
def positional_hits(table) -> DataFrame:
    found = decontaminate.find_items(table("documents"), table("benchmark"))
    return decontaminate.digest(found).withColumn("doc_id", F.col("id").cast("long")).drop("id")


@query("op7_suffix_dedup")
def suffix_dedup(table) -> DataFrame:
    return suffixes.remove_repeats(table("documents")).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        "n_removed",
        F.size("starts").cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"),
    )


@query("op8_bounded_ring_shards")
def bounded_ring_shards(table) -> DataFrame:
    binary = F.col("text").cast("binary")
    docs = table("documents").select("doc_id", "text")
    return sharding.shard(docs, 16, balance=1.0).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(binary), F.lit(0)).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_empirical_bayes_quality")
def empirical_bayes_quality(table) -> DataFrame:
    return quality.classify(table("documents"), table("labels")).select(
        F.col("id").alias("doc_id"), "p_low", "p_toxic", "keep"
    )


@query("op10_prefix_jaccard")
def prefix_jaccard(table) -> DataFrame:
    return ngram_join.near_duplicates(table("documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"
    )


@query("op11_l2ap_negatives", oracle.NEGATIVES)
def l2ap_negatives(table) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label)
    found = negatives.hard_negatives(table("embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0, moved)
    return found.drop("anchor_key")


@query("op12_pivot_top_products", oracle.TOP_PRODUCTS)
def pivot_top_products(table) -> DataFrame:
    found = pivots.largest_products(table("embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op13_vantage_clusters", oracle.CLUSTERS)
def vantage_clusters(table) -> DataFrame:
    found, _ = centroids.cluster(table("embeddings"))
    return found.withColumnRenamed("id", "vec_id")
