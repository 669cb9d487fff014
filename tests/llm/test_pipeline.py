"""The pipeline, stage by stage and as a whole, and the queries that have SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from cellquery.llm import queries
from check_oracle import compare, connect
from conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > 0
    final = corpus_pipeline.run(spark, SMALL)
    assert final.columns == [*columns, "shard", "slot"] and final.count() == sizes[-1]


def test_odd_rows_through_all_stages(spark, folder):
    """Nulls, repeated rows, long and empty texts, and columns of names that the stages use themselves."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = [(None, None), (None, ""), (10**9, None), (10**9 + 1, "one two three four five six"), (10**9 + 1, "one two three four five six")]
    odd += [(10**9 + 2, "Long word " * 5000), (None, "no id but a text of its own"), (None, "no id but quite another text")]
    rows = spark.createDataFrame([(*r, "en", None, None) for r in odd], given.select("doc_id", "text", "lang", "source", "n_chars").schema)
    own = {n: F.lit(n) for n in ("_key", "_slot", "_place", "_number", "_hash", "_source", "_salt", "_copy", "slot")}
    docs = given.select(rows.columns).unionByName(rows).unionByName(rows).withColumns(own)
    for name, table in (("documents", docs), ("nothing", docs.limit(0))):
        where = f"{folder}/{name}"
        table.write.parquet(f"{where}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{other}.parquet").write.parquet(f"{where}/{other}.parquet")
        found = corpus_pipeline.run(spark, where)
        assert found.columns == [*(c for c in docs.columns if c != "slot"), "shard", "slot"]
        got = found.collect()
        assert all(r["_key"] == "_key" and r["_hash"] == "_hash" and r["_slot"] == "_slot" for r in got)
        assert bool(got) == (name == "documents")
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) == ""


def test_registered():
    assert {*queries.queries(), "pipeline"} <= set(entry_points.queries())
