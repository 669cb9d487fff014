"""How a catalog module registers its queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellquery.session import ship


class Registry(dict):
    """``name -> (run, sql)``."""

    def query(self, name: str, sql: str | None = None) -> Callable:
        def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            @functools.wraps(run)
            def shipped(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return run(spark, folder)

            self[name] = (shipped, sql)
            return run

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
