"""Tables to QA rows: random cells, question prompts, predicted questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators import prediction, prompts, questions, tables
from cellquery.operators.numbering import dense_number


def generate_qa(
    cells: DataFrame,
    n: int,
    make_predictor: prediction.PredictorFactory,
    fmt: Column | int | None = None,
    lang: Column | str = "en",
    seed: int = 0,
    start: int = 0,
) -> DataFrame:
    """``id, utterance, context, targetValue``: ``n`` questions for every table of ``cells``."""
    drawn = questions.sample_cells(cells, ["table_id"], n, seed)
    numbered = dense_number(drawn, ["table_id", "draw"], "n", start)
    texts = tables.table_to_csv(cells, ["table_id"]).withColumnRenamed("csv", "table")
    asked = numbered.join(texts, "table_id").withColumn("answer", F.coalesce("cell", F.lit("")))
    done = prediction.predict(prompts.question_prompt(asked, fmt, lang), make_predictor)
    return done.filter(F.col("error").isNull()).select(
        questions.question_id(F.col("n")).alias("id"),
        text.extract_question(F.col("completion")).alias("utterance"),
        F.col("table_id").alias("context"),
        F.col("answer").alias("targetValue"),
    )
