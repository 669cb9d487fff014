"""Queries of the core join: M4 to M8, and the harvest from pages to QA rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.registry import Registry, table
from cellquery.operators import matching, questions
from cellquery.operators.report import table_index
from cellquery.plans.harvest import harvest
from cellquery.session import scratch
from cellquery.sources import store

QUERIES = Registry()
query = QUERIES.query


@query("m4_cell_index", f"WITH {inputs.CELLS}, {inputs.INDEX} SELECT doc_id AS page_id, cell_str, row_idx, col_idx, first_pos, cell_str AS word FROM idx")
def m4_cell_index(spark, folder):
    index = matching.cell_index(inputs.doc_cells(spark, folder))
    return index.select("page_id", "cell_str", "row_idx", "col_idx", "first_pos", "word")


def doc_hits(spark, folder, beside=()):
    """Hits of every document's facts in its sentences."""
    return matching.match_tables(inputs.doc_tables(spark, folder), beside=beside)


_HIT = ["page_id", "row_idx", "col_idx", "cell_str", "first_pos", "sentence_idx", "sentence"]
_SQL_HIT = "doc_id AS page_id, row_idx, col_idx, cell_str, first_pos, sentence_idx, sentence"


@query("m5_sentence_hits", f"WITH {inputs.HITS} SELECT {_SQL_HIT} FROM hits WHERE whole")
def m5_sentence_hits(spark, folder):
    return doc_hits(spark, folder).filter("whole").select(*_HIT)


@query("m6_hits_of_apart_inputs", f"WITH {inputs.HITS} SELECT {_SQL_HIT}, whole FROM hits")
def m6_hits_of_apart_inputs(spark, folder):
    """Cells and sentences as two long tables, each shuffled once."""
    sentences = matching.sentence_rows(inputs.doc_sections(spark, folder))
    return matching.match_cells(inputs.doc_cells(spark, folder), sentences).select(*_HIT, "whole")


@query("m6_word_hits", f"WITH {inputs.HITS} SELECT {_SQL_HIT} FROM hits WHERE NOT whole")
def m6_word_hits(spark, folder):
    return doc_hits(spark, folder).filter("not whole").select(*_HIT)


_NUMBER = r"""regexp_matches(cell_str, '^\s*[-+]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][-+]?\d+(_\d+)*)?\s*$|^\s*[-+]?(inf|infinity|nan)\s*$')"""


@query("m7_numeric_hits", f"WITH {inputs.HITS} SELECT {_SQL_HIT} FROM hits WHERE {_NUMBER}")
def m7_numeric_hits(spark, folder):
    return matching.numeric_only(doc_hits(spark, folder)).select(*_HIT)


def doc_statements(spark, folder):
    """Numbered statements of the documents' hits."""
    return questions.statements(doc_hits(spark, folder, ["url", "section_id"]))


def doc_qa(statements, candidates=None):
    return questions.build_qa(statements, questions.section_context(), candidates)


_CONTEXT = "d.source || '_' || n.doc_id || '_' || d.lang || '_0'"


@query(
    "m8_build_qa",
    f"""WITH {inputs.STATEMENTS} SELECT 'nt-' || n AS id, 'e' AS utterance, {_CONTEXT} AS context,
    n.cell_str AS "targetValue", false AS valid, statement AS original
    FROM numbered n JOIN documents d ON d.doc_id = n.doc_id""",
)
def m8_build_qa(spark, folder):
    return doc_qa(doc_statements(spark, folder))


# Both hits of a customer page: a balance that reads the same in text and table, and the segment.
PAGE_QA = """found AS (
  SELECT c_custkey, c_name, 0 AS table_idx, 1 AS pos, c_acctbal::VARCHAR AS word, lower(c_name) || ' holds ' || printf('%.2f', c_acctbal) || ' coins.' AS original
  FROM customer WHERE c_acctbal::VARCHAR = printf('%.2f', c_acctbal) AND c_acctbal >= 0
  UNION ALL SELECT c_custkey, c_name, 0, 2147483648, lower(c_mktsegment), 'the segment - is ' || lower(c_mktsegment) || '.' FROM customer
  UNION ALL SELECT c_custkey, c_name, 1, 1, c_acctbal::VARCHAR, lower(c_name) || ' holds ' || printf('%.2f', c_acctbal) || ' coins.'
  FROM customer WHERE c_acctbal::VARCHAR = printf('%.2f', c_acctbal) AND c_acctbal >= 0),
qa AS (SELECT 'nt-' || (row_number() OVER (ORDER BY c_custkey, table_idx, pos) - 1) AS id,
  c_name || '_account_' || table_idx AS context, word AS "targetValue", original FROM found)"""


@query("harvest_pages", f"WITH {PAGE_QA} SELECT id, 'e' AS utterance, context, \"targetValue\", false AS valid, original FROM qa")
def harvest_pages(spark, folder):
    return harvest(inputs.customer_pages(spark, folder)).qa()


@query(
    "harvest_stored_cells",
    """SELECT c_name || '_account_0' AS table_id, 2::BIGINT AS n_text, 2::BIGINT AS n_rows FROM customer
    UNION ALL SELECT c_name || '_account_1', 0, 2 FROM customer""",
)
def harvest_stored_cells(spark, folder):
    stored = harvest(inputs.customer_pages(spark, folder)).stored_cells()
    return stored.groupBy("table_id").agg(
        F.count(F.when(F.col("col_type") == "text", 1)).alias("n_text"),
        F.countDistinct("row_idx").alias("n_rows"),
    )


def _supplier_qa(order: str = "s_suppkey, pos, sentence") -> str:
    return f"""SELECT 'nt-' || (row_number() OVER (ORDER BY {order}) - 1) AS id, 'e' AS utterance, context,
    word AS "targetValue", false AS valid, original FROM supplier_hits"""


@query("m7_numbers_of_pages", f"WITH {inputs.supplier_hits()}, n AS ({_supplier_qa()}) SELECT 'nt-' || (row_number() OVER (ORDER BY substr(id, 4)::BIGINT) - 1) AS id, * EXCLUDE (id) FROM n WHERE \"targetValue\" LIKE '%.0'")
def m7_numbers_of_pages(spark, folder):
    """Only cells that read as a number become answers."""
    return harvest(inputs.supplier_pages(spark, folder), numbers_only=True).qa()


@query("harvest_null_as_nan", f"WITH {inputs.supplier_hits(null_as_nan=True)} {_supplier_qa()}")
def harvest_null_as_nan(spark, folder):
    """Empty cells match the word nan."""
    return harvest(inputs.supplier_pages(spark, folder), null_as_nan=True).qa()


@query("harvest_loose", f"WITH {inputs.supplier_hits(strict=False)} {_supplier_qa()}")
def harvest_loose(spark, folder):
    """Clauses count as sentences, so a cell can be a whole clause."""
    return harvest(inputs.supplier_pages(spark, folder), strict=False).qa()


@query("m8_append_qa", f"WITH {inputs.supplier_hits()} {_supplier_qa('s_acctbal >= 0, s_suppkey, pos, sentence')}")
def m8_append_qa(spark, folder):
    """Two batches appended to one store, the first one twice: numbers go on, nothing is there twice."""
    path = scratch(spark)
    owing = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("page_id"), (F.col("s_acctbal") < 0).alias("owes"))
    pages = inputs.supplier_pages(spark, folder).join(owing, "page_id")
    for batch, part in ((0, pages.filter("owes")), (0, pages.filter("owes")), (1, pages.filter("not owes"))):
        store.append_numbered_qa(harvest(part.drop("owes")).qa(), path, batch)
    return store.read_qa(spark, path)


@query(
    "e11_all_tables",
    f"""WITH {inputs.supplier_hits()} SELECT 'S' || s_suppkey || '_data_0' AS table_id, 0::BIGINT AS n_rows, 2::BIGINT AS n_cols, 0::BIGINT AS n_questions FROM supplier
    UNION ALL SELECT context, 2, 2, count(*) FROM supplier_hits GROUP BY context""",
)
def e11_all_tables(spark, folder):
    """Harvested tables and questions, stored and listed, with those that have a header only."""
    path = scratch(spark)
    job = harvest(inputs.supplier_pages(spark, folder))
    store.save_cells(job.stored_cells(), path, tables=job.stored_tables())
    return table_index(store.read_cells(spark, path), job.qa(), store.read_tables(spark, path))
