"""Queries of question generation: Q4, Q7, Q10, Q11 and questions made while harvesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.matching import doc_qa, doc_statements
from cellquery.catalog.registry import Registry, table
from cellquery.catalog.tables import conversation_cells
from cellquery.operators import questions
from cellquery.operators.matching import sentence_rows
from cellquery.plans.generation import generate_qa

QUERIES = Registry()
query = QUERIES.query

_LISTED = ", ".join(f"'{w}'" for w in questions.QUESTION_WORDS)
_PICKED = f"""picked AS (SELECT statement_id, coalesce(arg_min(token, rank) FILTER (WHERE lower(token) IN ({_LISTED})),
    lower(arg_min(token, rank))) AS token, count(*) FILTER (WHERE lower(token) IN ({_LISTED})) > 0 AS valid
  FROM candidates GROUP BY statement_id)"""


def _sql_candidates(source: str, key: str, statement: str) -> str:
    """Candidates of a statement: its words in order, three common ones turned into question words."""
    return f"""candidates AS (SELECT statement_id, rank,
      CASE word WHEN 'the' THEN 'Mi' WHEN 'de' THEN 'Hol' WHEN 'der' THEN 'Mikor' ELSE 'X' || word END AS token
    FROM (SELECT statement_id, unnest(ws) AS word, unnest(range(len(ws))) AS rank
      FROM (SELECT {key} AS statement_id, regexp_extract_all(lower({statement}), '{inputs.WORD}') AS ws FROM {source})))"""


def candidates(df, key, statement):
    found = F.regexp_extract_all(F.lower(statement), F.lit(inputs.WORD), F.lit(0))
    word = F.col("word")
    token = F.when(word == "the", "Mi").when(word == "de", "Hol").when(word == "der", "Mikor").otherwise(F.concat(F.lit("X"), word))
    return df.select(key.alias("statement_id"), F.posexplode(found).alias("rank", "word")).select(
        "statement_id", "rank", token.alias("token")
    )


@query(
    "q4_pick_question_word",
    f"""WITH {inputs.SENTENCES}, {_sql_candidates('sentences', "doc_id || '-' || sentence_idx", 'sentence')},
    {_PICKED} SELECT * FROM picked""",
)
def q4_pick_question_word(spark, folder):
    rows = sentence_rows(table(spark, folder, "documents"), "text", ["doc_id"])
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sentence_idx").cast("string"))
    return questions.pick_question_word(candidates(rows, key, "sentence"))


_ASKED = f"""{inputs.STATEMENTS}, qa AS (SELECT 'nt-' || n.n AS id, n.cell_str AS a, n.statement AS s,
  d.source || '_' || n.doc_id || '_' || d.lang || '_0' AS context FROM numbered n JOIN documents d ON d.doc_id = n.doc_id),
{_sql_candidates('qa', 'id', 's')}, {_PICKED},
masked AS (SELECT qa.*, token, valid, CASE WHEN a = '' THEN s ELSE replace(s, a, '<mask>') END AS r
  FROM qa LEFT JOIN picked ON statement_id = id),
cut AS (SELECT *, left(r, greatest(length(r) - 1, 0)) || '?' AS m FROM masked),
asked AS (SELECT *, {inputs.sql_count('m', "'<mask>'")} = 1 AS one,
  left(replace(m, '<mask>', token), length(replace(m, '<mask>', token)) - 1) || '?' AS q FROM cut)"""


@query(
    "q_build_qa_with_questions",
    f"""WITH {_ASKED} SELECT id, CASE WHEN one THEN q END AS utterance, context, a AS "targetValue",
    one AND coalesce(valid, false) AS valid, s AS original FROM asked""",
)
def q_build_qa_with_questions(spark, folder):
    statements = doc_statements(spark, folder)
    return doc_qa(statements, candidates(doc_qa(statements), F.col("id"), "original"))


_REWORKED = f"""{_ASKED}, reworked AS (SELECT *, CASE WHEN length(s) > 512 THEN 1
    WHEN a = '' OR {inputs.sql_count('s', "nullif(a, '')")} <> 1 THEN 2 WHEN one THEN 3 ELSE 4 END AS k FROM asked)"""
_REWORK = """SELECT id, CASE k WHEN 1 THEN 'Statement is too long.' WHEN 2 THEN 'Multiple answer word found in the sentence.'
    WHEN 3 THEN q END AS utterance, context, a AS "targetValue", {valid} AS valid, s AS original FROM reworked"""


def _reworked(spark, folder, **options):
    qa = doc_qa(doc_statements(spark, folder))
    return questions.rework_qa(qa, candidates(qa, F.col("id"), "original"), **options)


@query("q11_rework_qa", f"WITH {_REWORKED} {_REWORK.format(valid='false')}")
def q11_rework_qa(spark, folder):
    return _reworked(spark, folder)


@query(
    "q11_rework_qa_store_valid",
    f"WITH {_REWORKED} {_REWORK.format(valid='CASE k WHEN 2 THEN true WHEN 3 THEN coalesce(valid, false) ELSE false END')}",
)
def q11_rework_qa_store_valid(spark, folder):
    return _reworked(spark, folder, store_valid=True)


@query(
    "q7_sample_cells",
    """SELECT conv_id, least(3 * count(*), 5)::BIGINT AS n_draws, true AS all_found, true AS all_distinct
    FROM conversations GROUP BY conv_id""",
)
def q7_sample_cells(spark, folder):
    cells = conversation_cells(spark, folder)
    drawn = questions.sample_cells(cells, ["conv_id"], 5, seed=7)
    own = cells.select("conv_id", "row_idx", "col_idx", F.col("cell").alias("_cell"))
    return (
        drawn.join(own, ["conv_id", "row_idx", "col_idx"], "left")
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("n_draws"),
            F.bool_and(F.col("cell") == F.col("_cell")).alias("all_found"),
            (F.countDistinct("row_idx", "col_idx") == F.count("*")).alias("all_distinct"),
        )
    )


def _quoting_predictor():
    """A stand-in backend that answers a prompt with a quoted question about the prompt's answer."""
    return lambda batch: [f'"{a}" or "What is {a.split(" ")[0]}?" x' for a in batch["answer"]]


@query(
    "q10_generate_qa",
    """SELECT 'customer-' || c_custkey AS context, 2::BIGINT AS n_questions, true AS all_asked FROM customer""",
)
def q10_generate_qa(spark, folder):
    made = generate_qa(inputs.customer_cells(spark, folder), 2, _quoting_predictor)
    return made.groupBy("context").agg(
        F.count("*").alias("n_questions"),
        F.bool_and(F.col("utterance") == F.concat(F.lit("What is "), F.split_part("targetValue", F.lit(" "), F.lit(1)), F.lit("?"))).alias("all_asked"),
    )


@query(
    "q10_question_numbers",
    "SELECT 'nt-' || unnest(range(2 * (SELECT count(*) FROM customer))) AS id",
)
def q10_question_numbers(spark, folder):
    return generate_qa(inputs.customer_cells(spark, folder), 2, _quoting_predictor).select("id")
