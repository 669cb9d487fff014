"""Models x seeds x questions to accuracies and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators import evaluation, prediction, prompts, tables


#: Types of models whose completions hold their prompt, or are cut at stop tokens.
REPEAT_PROMPT = ["transformers"]
CUT_AT_STOP = ["gguf"]


def prompt_table(
    models: DataFrame,
    qa: DataFrame,
    cells: DataFrame,
    seeds: int = 1,
    limit: int | None = None,
    lang: Column | str = "en",
    translations: DataFrame | None = None,
    listed: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One row per model, seed and question: ``model, model_type, seed, question_id, table, question, prompt``.

    Table texts, made once per table, meet the questions before these are multiplied by models and
    seeds, so a question and its text are shuffled once, and copied only in the task that asks them.
    Spark sizes tasks by bytes; for predictors that take long per row give their number in ``tasks``.
    """
    asked = qa.select("id", "utterance", "context")
    if translations is not None:
        asked = prompts.with_translation(asked, translations).withColumn(
            "utterance", F.coalesce("translation", "utterance")
        )
    named = models.select(F.col("name").alias("model"), "model_type", "prompt_format")
    texts = tables.table_to_csv(cells, ["table_id"], tables=listed)
    told = asked.join(texts.select(F.col("table_id").alias("context"), F.col("csv").alias("table")), "context")
    told = told if tasks is None else told.repartition(tasks)
    full = evaluation.run_plan(named, seeds, told, limit, beside=["utterance", "context", "table"])
    return prompts.answer_prompt(full.withColumnRenamed("utterance", "question"), F.col("prompt_format"), lang)


def answers(completions: DataFrame, kind: Column | str = "model_type") -> DataFrame:
    """Completions cut down to answers; rows whose predictor failed are left out.

    ``kind`` names the row's backend. Some cut at a stop token, some give the prompt back and end at
    a double quote, and the texts of all others are answers as they are.
    """
    done = completions.filter(F.col("error").isNull())
    kind = F.col(kind) if isinstance(kind, str) else kind
    answer = (
        F.when(kind.isin(REPEAT_PROMPT), text.completion_answer(F.col("completion"), F.col("prompt")))
        .when(kind.isin(CUT_AT_STOP), text.cut_at_stop(F.col("completion")))
        .otherwise(F.col("completion"))
    )
    return done.select("model", "seed", "question_id", answer.alias("completion"))


def evaluate(
    models: DataFrame, qa: DataFrame, cells: DataFrame, backends: dict, default: str, **options
) -> DataFrame:
    """``model, seed, accuracy`` of every model; planned questions that failed score 0."""
    asked = prompt_table(models, qa, cells, **options)
    completions = prediction.predict_by_type(asked, backends, default)
    kind = F.when(F.col("model_type").isin(list(backends)), F.col("model_type")).otherwise(default)
    rows = evaluation.evaluate_rows(answers(completions, kind), qa)
    named = models.select(F.col("name").alias("model"))
    return evaluation.asked_accuracy(named, options.get("seeds", 1), qa, options.get("limit"), rows)


def result_file_rows(
    models: DataFrame, qa: DataFrame, cells: DataFrame, backends: dict, default: str, elapsed: DataFrame, date: Column,
    dataset_name: str, language_en: bool = True, **options
) -> DataFrame:
    """The rows of the result file of an evaluation; ``elapsed`` has ``model, seconds``."""
    found = evaluate(models, qa, cells, backends, default, **options)
    size = evaluation.planned_questions(qa, options.get("limit")).count()
    return evaluation.result_rows(found, elapsed, date, dataset_name, size, language_en)
