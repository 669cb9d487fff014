"""Micro-batch harvest: landed page files in, statements out, known pages skipped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellquery.operators.sections import canonical_url
from cellquery.plans.harvest import harvest
from cellquery.sources.files import PAGES
from cellquery.sources.store import first_number, note_numbers

_PAGE = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of parquet files as they land in ``folder``."""
    return spark.readStream.schema(PAGES).parquet(folder)


def new_pages(pages: DataFrame) -> DataFrame:
    """The first page of every canonical URL over the whole stream; of one batch that of the lowest id.

    Spark's state store keeps which URLs are known, spread by URL. A batch looks up its own URLs
    and nothing else, however many came before.
    """

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            page = part.loc[[part["page_id"].idxmin()], ["page_id", "url", "html"]]
            if best is None or page["page_id"].iat[0] < best["page_id"].iat[0]:
                best = page
        if not state.exists and best is not None:
            state.update((True,))
            yield best

    named = pages.select("page_id", "url", "html", canonical_url(F.col("html"), F.col("url")).alias("canonical_url"))
    return named.groupBy("canonical_url").applyInPandasWithState(
        first, _PAGE, "known boolean", "append", GroupStateTimeout.NoTimeout
    )


def harvest_stream(pages: DataFrame, folder: str, state: str, **options) -> DataStreamWriter:
    """Writer that harvests each batch's new URLs into ``folder/batch=N``.

    Statements are numbered on from batch to batch; a log in ``state`` notes which numbers a batch
    has taken. Batches write to a folder of their own number, and one that is run again gets
    the same pages and the same numbers, so it replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbers, out = f"{state}/numbers", f"{folder}/batch={number}"
        start = first_number(spark, numbers, number)
        harvest(batch, start=start, **options).statements.write.mode("overwrite").parquet(out)
        note_numbers(spark, numbers, number, spark.read.parquet(out).count())

    return new_pages(pages).writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/offsets")
