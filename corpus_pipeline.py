"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of ``docs`` (the
last adds ``shard`` and ``slot``); every stage works on all rows that the one before kept. Empty
tables, null texts and ids, and repeated rows go through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellquery.llm import decontaminate, mixing, ngram_join, quality, sharding
from cellquery.llm.scratch import finished
from cellquery.session import ship

SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality or toxic go."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 the one of smallest id stays."""
    ship(spark)
    return ngram_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a shorter item, go."""
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them: not at all, once, or twice."""
    ship(spark)
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, counts at most one apart, and its slot in the shard."""
    ship(spark)
    return sharding.shard(docs, SHARDS, balance=1.0)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier's decisions can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``, each written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = finished(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
