"""The tables behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.operators.tables import table_sizes


def leaderboard(results: DataFrame) -> DataFrame:
    """``model, accuracy, speed`` of result rows, best first; accuracy is the mean over the seeds."""
    numbers = F.transform(
        F.split(F.btrim("Score", F.lit("[]")), ", *"), lambda s: s.try_cast("double")
    )
    total = F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)
    return results.select(
        F.col("Model name").alias("model"),
        (total / F.size(numbers)).alias("accuracy"),
        F.col("Iteration speed").cast("double").alias("speed"),
    ).orderBy(F.desc("accuracy"), "model")


def table_index(cells: DataFrame, qa: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``table_id, n_rows, n_cols, n_questions`` of every stored table.

    With ``tables`` (``table_id, n_rows, n_cols``) no cell is read, and tables without rows are listed too.
    """
    sizes = table_sizes(cells, ["table_id"]) if tables is None else tables.select("table_id", "n_rows", "n_cols")
    questions = qa.groupBy(F.col("context").alias("table_id")).agg(F.count("*").alias("_asked"))
    return sizes.join(questions, "table_id", "left").select(
        "table_id", "n_rows", "n_cols", F.coalesce("_asked", F.lit(0)).alias("n_questions")
    )
