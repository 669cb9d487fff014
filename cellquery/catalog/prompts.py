"""Queries of prompts and prediction: P2, P3, P7, P8, Q8."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.registry import Registry, table
from cellquery.operators import prediction, prompts

QUERIES = Registry()
query = QUERIES.query


def _sql_template(templates: list, places: dict[str, str]) -> str:
    """``CASE`` over format and language that joins the pieces of each template."""
    arms = []
    for number, lang, template in templates:
        marked = template.replace("'", "''")
        for place, expression in places.items():
            marked = marked.replace("{" + place + "}", f"' || {expression} || '")
        arms.append(f"WHEN fmt = {number} AND lang = '{lang}' THEN '{marked}'")
    return "CASE " + " ".join(arms) + " END"


_P2 = _sql_template(prompts.answer_templates(), {"table": "role", "question": "text"})


@query(
    "p2_answer_prompt",
    f"""WITH t AS (SELECT *, CASE WHEN turn > 4 THEN -1 ELSE turn - 1 END AS fmt,
      CASE role WHEN 'user' THEN 'hu' ELSE 'en' END AS lang FROM conversations)
    SELECT conv_id, turn, md5({_P2}) AS prompt_md5 FROM t""",
)
def p2_answer_prompt(spark, folder):
    asked = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("role").alias("table"), F.col("text").alias("question"),
        (F.col("turn") - 1).cast("int").alias("fmt"),
        F.when(F.col("role") == "user", "hu").otherwise("en").alias("language"),
    )
    made = prompts.answer_prompt(asked, F.col("fmt"), F.col("language"))
    return made.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


_Q8 = _sql_template(prompts.question_templates(), {"table": "c_name", "answer": "c_mktsegment"})


@query(
    "q8_question_prompt",
    f"""WITH t AS (SELECT *, CASE WHEN c_nationkey > 3 THEN -1 ELSE c_nationkey END AS fmt,
      CASE WHEN c_acctbal > 0 THEN 'hu' ELSE 'en' END AS lang FROM customer)
    SELECT c_custkey, {_Q8} AS prompt FROM t""",
)
def q8_question_prompt(spark, folder):
    asked = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("table"), F.col("c_mktsegment").alias("answer"), "c_nationkey",
        F.when(F.col("c_acctbal") > 0, "hu").otherwise("en").alias("language"),
    )
    made = prompts.question_prompt(asked, F.col("c_nationkey"), F.col("language"))
    return made.select("c_custkey", "prompt")


@query(
    "p3_with_translation",
    f"WITH {inputs.QA} SELECT id, utterance, c_name AS translation FROM qa LEFT JOIN customer ON 'nt-' || c_custkey = id",
)
def p3_with_translation(spark, folder):
    lines = table(spark, folder, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("text"))
    return prompts.with_translation(inputs.order_qa(spark, folder), lines).select("id", "utterance", "translation")


@query(
    "p7_predict_base",
    "SELECT conv_id, turn, role || chr(10) || text || chr(10) || 'Base model answer.' AS completion, NULL::VARCHAR AS error FROM conversations",
)
def p7_predict_base(spark, folder):
    asked = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("role").alias("table"), F.col("text").alias("question")
    )
    done = prediction.predict(asked, prediction.base_model)
    return done.select("conv_id", "turn", "completion", "error")


def _marking_translator():
    """A stand-in backend that marks its texts and fails on those with quotation marks."""
    def run(texts):
        if any('"' in t for t in texts):
            raise ValueError("cannot read quotation marks")
        return [f"hu: {t}" for t in texts]

    return run


@query("p8_translate", "SELECT doc_id AS idx, 'hu: ' || text AS text FROM documents WHERE NOT contains(text, '\"')")
def p8_translate(spark, folder):
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("idx"), "text")
    return prediction.translate(lines, "text", _marking_translator)
