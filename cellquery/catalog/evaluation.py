"""Queries of evaluation and reports: S7, S8, E4 to E11."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.registry import Registry, table
from cellquery.operators import evaluation, report
from cellquery.operators.prediction import base_model
from cellquery.operators.tables import table_to_csv
from cellquery.plans.evaluation import evaluate, result_file_rows

QUERIES = Registry()
query = QUERIES.query


@query(
    "s7_qa_with_tables",
    f"""WITH {inputs.QA} SELECT q.id, q.utterance, q.context, array_to_string(regexp_split_to_array(q.targetValue, '[,|]'), ';') AS answers,
    'name,%,nation' || chr(10) || c_name || ',' || c_mktsegment || ',' || c_nationkey || chr(10) AS csv
    FROM qa q JOIN customer ON q.context = 'customer-' || c_custkey""",
)
def s7_qa_with_tables(spark, folder):
    texts = table_to_csv(inputs.customer_cells(spark, folder), ["table_id"])
    found = evaluation.qa_with_tables(inputs.order_qa(spark, folder), texts)
    return found.withColumn("answers", F.array_join("answers", ";"))


@query("s8_qa_count", "SELECT count(*) AS n_questions FROM orders")
def s8_qa_count(spark, folder):
    return evaluation.qa_count(inputs.order_qa(spark, folder))


def scored(spark, folder):
    return evaluation.evaluate_rows(inputs.lineitem_answers(spark, folder), inputs.order_qa(spark, folder))


@query(
    "e4_e5_evaluate_rows",
    f"""WITH {inputs.SCORED} SELECT model, seed, question_id, score, utterance, array_to_string(truth, ';') AS truth,
    array_to_string(answer, ';') AS answer FROM scored""",
)
def e4_e5_evaluate_rows(spark, folder):
    return scored(spark, folder).withColumns(
        {"truth": F.array_join("truth", ";"), "answer": F.array_join("answer", ";")}
    )


def accuracies(spark, folder):
    asked = evaluation.qa_count(inputs.order_qa(spark, folder)).scalar()
    return evaluation.accuracy(scored(spark, folder), asked)


_ACCURACY = f"""{inputs.SCORED}, acc AS (SELECT model, seed, sum(score) / (SELECT count(*) FROM orders) AS accuracy
  FROM scored GROUP BY model, seed)"""


@query("e6_accuracy", f"WITH {_ACCURACY} SELECT * FROM acc")
def e6_accuracy(spark, folder):
    return accuracies(spark, folder)


_PLAN = """plan AS (SELECT r_name AS model, seed, 'nt-' || o_orderkey AS question_id
  FROM orders, region, (SELECT unnest([0, 1]) AS seed))"""


def plan(spark, folder, limit=None):
    models = table(spark, folder, "region").select(F.col("r_name").alias("model"))
    return evaluation.run_plan(models, 2, inputs.order_qa(spark, folder), limit)


@query("e7_run_plan", f"WITH {_PLAN} SELECT * FROM plan")
def e7_run_plan(spark, folder):
    return plan(spark, folder)


@query(
    "e7_run_plan_limit",
    f"WITH {_PLAN} SELECT model, seed, count(*) AS n FROM plan WHERE substr(question_id, 4)::BIGINT < 1000 GROUP BY ALL",
)
def e7_run_plan_limit(spark, folder):
    return plan(spark, folder, 1000).groupBy("model", "seed").agg(F.count("*").alias("n"))


@query(
    "e6_plan_accuracy",
    f"""WITH {inputs.SCORED}, s AS (SELECT model, seed, sum(score) AS total FROM scored GROUP BY model, seed)
    SELECT m.model, k.seed, coalesce(s.total, 0) / (SELECT count(*) FROM orders) AS accuracy
    FROM (SELECT DISTINCT l_returnflag AS model FROM lineitem) m CROSS JOIN (SELECT unnest(range(9))::INT AS seed) k
    LEFT JOIN s ON s.model = m.model AND s.seed = k.seed""",
)
def e6_plan_accuracy(spark, folder):
    models = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("model")).distinct()
    return evaluation.asked_accuracy(models, 9, inputs.order_qa(spark, folder), None, scored(spark, folder))


@query(
    "e6_run_plan_accuracy",
    f"""WITH {inputs.SCORED}, s AS (SELECT model, seed, sum(score) AS total FROM scored GROUP BY model, seed)
    SELECT m.model, k.seed, coalesce(s.total, 0) / (SELECT count(*) FROM orders WHERE o_orderkey < 1000) AS accuracy
    FROM (SELECT DISTINCT l_returnflag AS model FROM lineitem) m CROSS JOIN (SELECT unnest(range(2))::INT AS seed) k
    LEFT JOIN s ON s.model = m.model AND s.seed = k.seed""",
)
def e6_run_plan_accuracy(spark, folder):
    """Over a plan that is there anyway, of the first questions; scores are of all answers."""
    models = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("model")).distinct()
    asked = evaluation.run_plan(models, 2, inputs.order_qa(spark, folder), 1000)
    return evaluation.plan_accuracy(asked, scored(spark, folder))


def _gguf():
    return lambda batch: [" O <|im_end|>, F" for _ in batch["question"]]


def _transformers():
    return lambda batch: [f'{prompt}F, 5-LOW" and, O' for prompt in batch["prompt"]]


def _plain():
    return lambda batch: ['x", P!' if "," in table else "" for table in batch["table"]]


BACKENDS = {"gguf": _gguf, "transformers": _transformers, "openai": _plain, "base": base_model}
_TYPES = "gguf transformers openai base unheard-of"


def region_models(spark, folder):
    """Five models of five types, one of them of no known backend."""
    kind = F.element_at(F.split(F.lit(_TYPES), " "), (F.col("r_regionkey") + 1).cast("int"))
    return table(spark, folder, "region").select(
        F.col("r_name").alias("name"), kind.alias("model_type"), (F.col("r_regionkey") - 1).cast("int").alias("prompt_format")
    )


_BY_TYPE = f"""told AS (SELECT r_name AS model, seed, string_split('{_TYPES}', ' ')[r_regionkey + 1] AS kind, o_orderstatus AS s, o_orderpriority AS p
    FROM orders, region, (SELECT unnest([0, 1]) AS seed)),
  acc AS (SELECT model, seed, sum(CASE kind WHEN 'gguf' THEN (s = 'O')::INT WHEN 'transformers' THEN (s = 'F')::INT + (p = '5-LOW')::INT
      WHEN 'openai' THEN (s = 'P')::INT ELSE 0 END / 2.0) / (SELECT count(*) FROM orders) AS accuracy FROM told GROUP BY ALL)"""


@query("evaluate_by_type", f"WITH {_BY_TYPE} SELECT model, seed, round(accuracy, 9) AS accuracy FROM acc")
def evaluate_by_type(spark, folder):
    """All questions to models of all types: cut at a stop token, after the repeated prompt, or not at all."""
    found = evaluate(
        region_models(spark, folder), inputs.order_qa(spark, folder), inputs.customer_cells(spark, folder), BACKENDS, "base", seeds=2, tasks=32
    )
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "evaluate_result_rows",
    f"""WITH {_BY_TYPE} SELECT '2024-10-20 12:30:00' AS "Date", 'Research' AS "Dataset name", (SELECT count(*) FROM orders) AS "Dataset size",
    'English' AS "Dataset language", model AS "Model name", format('{{:.2f}}', (SELECT count(*) FROM orders) / (length(model) + 0.5)) AS "Iteration speed",
    '[' || string_agg(format('{{:.3f}}', accuracy), ', ' ORDER BY seed) || ']' AS "Score" FROM acc GROUP BY model""",
)
def evaluate_result_rows(spark, folder):
    """The same down to the rows of the result file."""
    elapsed = table(spark, folder, "region").select(F.col("r_name").alias("model"), (F.length("r_name") + F.lit(0.5)).alias("seconds"))
    return result_file_rows(
        region_models(spark, folder), inputs.order_qa(spark, folder), inputs.customer_cells(spark, folder), BACKENDS, "base",
        elapsed, F.lit("2024-10-20 12:30:00").cast("timestamp"), "Research", seeds=2, tasks=32,
    )


@query("s8_stored_qa_count", "SELECT 'stored' AS name, count(*) AS n_questions FROM orders UNION ALL SELECT 'missing', 0")
def s8_stored_qa_count(spark, folder):
    """The count of a stored question table, and of one that is not there."""
    inputs.order_qa(spark, folder).createOrReplaceTempView("cellquery_stored_qa")
    count = lambda name: evaluation.stored_qa_count(spark, f"cellquery_{name}_qa").select(F.lit(name).alias("name"), "n_questions")
    return count("stored").union(count("missing"))


def results(spark, folder):
    elapsed = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.sum("l_quantity").alias("seconds")
    )
    return evaluation.result_rows(
        accuracies(spark, folder),
        elapsed,
        F.lit("2024-10-20 12:30:00").cast("timestamp"),
        "Research",
        evaluation.qa_count(inputs.order_qa(spark, folder)).scalar(),
        language_en=False,
    )


_RESULTS = f"""{_ACCURACY}, elapsed AS (SELECT l_returnflag AS model, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1),
results AS (SELECT '2024-10-20 12:30:00' AS "Date", 'Research' AS "Dataset name", (SELECT count(*) FROM orders) AS "Dataset size",
  'Hungarian' AS "Dataset language", model AS "Model name",
  format('{{:.2f}}', (SELECT count(*) FROM orders) / any_value(seconds)) AS "Iteration speed",
  '[' || string_agg(format('{{:.3f}}', accuracy), ', ' ORDER BY seed) || ']' AS "Score"
  FROM acc JOIN elapsed USING (model) GROUP BY model)"""


@query("e8_result_rows", f"WITH {_RESULTS} SELECT * FROM results")
def e8_result_rows(spark, folder):
    return results(spark, folder)


@query(
    "e9_sql_answer_verdict",
    """WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY o_custkey)
    SELECT 'nt-' || c_custkey AS question_id, coalesce(v = substr(c_mktsegment, 1, 1), false) AS verdict
    FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
)
def e9_sql_answer_verdict(spark, folder):
    qa = table(spark, folder, "customer").select(
        F.concat(F.lit("nt-"), F.col("c_custkey").cast("string")).alias("id"),
        F.substring("c_mktsegment", 1, 1).alias("targetValue"),
    )
    found = table(spark, folder, "orders").select(
        F.concat(F.lit("nt-"), F.col("o_custkey").cast("string")).alias("question_id"),
        F.col("o_orderkey").alias("row_no"),
        F.col("o_orderstatus").alias("value"),
    )
    return evaluation.sql_answer_verdict(found, qa)


@query(
    "e10_leaderboard",
    f"""WITH {_RESULTS} SELECT "Model name" AS model, round(list_avg(list_transform(string_split("Score"[2:-2], ', '),
    lambda s: s::DOUBLE)), 9) AS accuracy, "Iteration speed"::DOUBLE AS speed FROM results""",
)
def e10_leaderboard(spark, folder):
    board = report.leaderboard(results(spark, folder))
    return board.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "e11_table_index",
    f"""WITH {inputs.QA} SELECT 'customer-' || c_custkey AS table_id, 1::BIGINT AS n_rows, 3::BIGINT AS n_cols,
    (SELECT count(*) FROM qa WHERE context = 'customer-' || c_custkey) AS n_questions FROM customer""",
)
def e11_table_index(spark, folder):
    return report.table_index(inputs.customer_cells(spark, folder), inputs.order_qa(spark, folder))
