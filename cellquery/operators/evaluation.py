"""Questions with their tables, run plans, scores and accuracies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators.questions import question_number


def qa_with_tables(qa: DataFrame, tables: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """``id, utterance, context, answers`` with the other columns of ``tables`` (keyed by ``table_id``).

    A table has one row here (its CSV text or its nested rows), so a question meets it once. Many
    questions may share a table.
    """
    asked = qa if ids is None else qa.filter(F.col("id").isin(ids))
    asked = asked.select(
        "id", "utterance", "context", text.truth_list(F.col("targetValue")).alias("answers")
    )
    return asked.join(tables.withColumnRenamed("table_id", "context"), "context")


def qa_count(qa: DataFrame) -> DataFrame:
    """One row: the number of questions."""
    return qa.agg(F.count("*").alias("n_questions"))


def stored_qa_count(spark: SparkSession, table: str) -> DataFrame:
    """The number of questions of a catalog table, 0 if it is missing."""
    if spark.catalog.tableExists(table):
        return qa_count(spark.table(table))
    return spark.range(1).select(F.lit(0).cast("bigint").alias("n_questions"))


def planned_questions(qa: DataFrame, limit: int | None = None, beside: list[str] = ()) -> DataFrame:
    """``question_id, _n`` of the questions ``nt-N`` with ``N`` below ``limit`` (all if null)."""
    asked = qa.select(F.col("id").alias("question_id"), *beside).withColumn("_n", question_number(F.col("question_id")))
    return asked.filter(F.col("_n").isNotNull() if limit is None else F.col("_n") < limit)


def run_plan(
    models: DataFrame,
    seeds: int,
    qa: DataFrame,
    limit: int | None = None,
    slices: int | None = None,
    beside: list[str] = (),
) -> DataFrame:
    """Every model with every seed and every question ``nt-N`` with ``N`` below ``limit`` (all if null).

    Questions are spread over ``slices`` (four per shuffle partition, if null) and models copied to
    each, so the product is an equi-join that Spark may broadcast or shuffle, and no task holds all
    questions. The columns ``beside`` of ``qa`` go along; they should be short.
    """
    slices = slices or 4 * int(qa.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = planned_questions(qa, limit, beside)
    asked = asked.select("question_id", *beside, F.pmod(F.xxhash64("_n"), F.lit(slices)).alias("_slice"))
    copies = models.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
    )
    return (
        asked.join(copies, "_slice")
        .drop("_slice")
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    )


def evaluate_rows(answers: DataFrame, qa: DataFrame) -> DataFrame:
    """Evidence per answer: ``model, seed, question_id, score, utterance, truth, answer`` arrays.

    Truths are cleaned once per question, on their side of the join. A question may have any share
    of the answers.
    """
    truths = qa.select(
        F.col("id").alias("question_id"),
        "utterance",
        text.truth_list(F.col("targetValue")).alias("truth"),
        text.truth_keys(F.col("targetValue")).alias("_truth_keys"),
    )
    told = answers.select("model", "seed", "question_id", F.coalesce("completion", F.lit("")).alias("completion"))
    joined = told.join(truths, "question_id")
    return joined.select(
        "model",
        "seed",
        "question_id",
        text.key_score(F.col("_truth_keys"), text.answer_keys(F.col("completion"))).alias("score"),
        "utterance",
        "truth",
        text.answer_list(F.col("completion")).alias("answer"),
    )


def accuracy(rows: DataFrame, n: Column | int) -> DataFrame:
    """``model, seed, accuracy``: the sum of scores over the number ``n`` of questions asked."""
    asked = n if isinstance(n, Column) else F.lit(n)
    return rows.groupBy("model", "seed").agg((F.sum("score") / F.any_value(asked)).alias("accuracy"))


def asked_accuracy(models: DataFrame, seeds: int, qa: DataFrame, limit: int | None, rows: DataFrame) -> DataFrame:
    """``plan_accuracy`` of the run plan of these, which is not made: every model and seed is asked
    as many questions, one number."""
    number = planned_questions(qa, limit).agg(F.count("*").alias("_asked"))
    runs = models.select("model").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    scored = rows.groupBy("model", "seed").agg(F.sum("score").alias("_total"))
    told = runs.crossJoin(F.broadcast(number)).filter("_asked > 0").join(scored, ["model", "seed"], "left")
    accuracy_of = F.coalesce("_total", F.lit(0.0)) / F.col("_asked")
    return told.select("model", "seed", accuracy_of.alias("accuracy"))


def plan_accuracy(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``model, seed, accuracy`` over a run plan; planned questions without an answer score 0."""
    asked = plan.groupBy("model", "seed").agg(F.count("*").alias("_asked"))
    scored = rows.groupBy("model", "seed").agg(F.sum("score").alias("_total"))
    return asked.join(scored, ["model", "seed"], "left").select(
        "model", "seed", (F.coalesce("_total", F.lit(0.0)) / F.col("_asked")).alias("accuracy")
    )


def fixed_text(digits: int):
    """Column function: a number to ``digits`` decimals, rounded from its exact binary value.

    JVM formatting rounds the shortest decimal text instead, which differs on halves. Only result
    rows (one per model and seed) pass through here.
    """
    @F.pandas_udf("string")
    def fixed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format(v, f".{digits}f"), na_action="ignore")

    return fixed


def result_rows(
    accuracies: DataFrame,
    elapsed: DataFrame,
    date: Column,
    dataset_name: str,
    dataset_size: Column | int,
    language_en: bool,
) -> DataFrame:
    """One row per model for the result file; ``elapsed`` has ``model, seconds`` over all its seeds."""
    size = dataset_size if isinstance(dataset_size, Column) else F.lit(dataset_size)
    scores = (
        accuracies.withColumn("_text", fixed_text(3)("accuracy"))
        .groupBy("model")
        .agg(F.array_sort(F.collect_list(F.struct("seed", "_text"))).alias("_scores"))
    )
    return scores.join(elapsed, "model").select(
        F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.lit(dataset_name).alias("Dataset name"),
        size.cast("bigint").alias("Dataset size"),
        F.lit("English" if language_en else "Hungarian").alias("Dataset language"),
        F.col("model").alias("Model name"),
        fixed_text(2)(size / F.col("seconds")).alias("Iteration speed"),
        F.concat(
            F.lit("["), F.array_join(F.transform("_scores", lambda s: s["_text"]), ", "), F.lit("]")
        ).alias("Score"),
    )


def sql_answer_verdict(results: DataFrame, qa: DataFrame) -> DataFrame:
    """``question_id, verdict``: is the first row of a question's query result its truth.

    ``results`` has ``question_id, row_no, value``; a question without a result is false.
    """
    first = results.groupBy("question_id").agg(F.min_by("value", "row_no").alias("_first"))
    truths = qa.select(F.col("id").alias("question_id"), "targetValue")
    return truths.join(first, "question_id", "left").select(
        "question_id", F.coalesce(F.col("_first") == F.col("targetValue"), F.lit(False)).alias("verdict")
    )
