"""Queries over tables: H9, H11, H13, S3, P1, P4."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.registry import Registry, table
from cellquery.operators import sections, tables
from cellquery.session import spread

QUERIES = Registry()
query = QUERIES.query

# Cells of the account section of a customer's page, as typed.
ACCOUNT_CELLS = """account AS (
  SELECT c_custkey AS page_id, 0 AS table_idx, 0 AS row_idx, 0 AS col_idx, 'name' AS col_name, 'text' AS col_type, lower(c_name) AS cell_str, lower(c_name) AS word FROM customer
  UNION ALL SELECT c_custkey, 0, 0, 1, 'balance', 'float', c_acctbal::VARCHAR, c_acctbal::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 0, 0, 2, 'nation', 'int', c_nationkey::VARCHAR, c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 0, 1, 0, 'name', 'text', lower(c_mktsegment), lower(c_mktsegment) FROM customer
  UNION ALL SELECT c_custkey, 0, 1, 1, 'balance', 'float', NULL, NULL FROM customer
  UNION ALL SELECT c_custkey, 0, 1, 2, 'nation', 'int', c_custkey::VARCHAR, c_custkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 1, 0, 0, '0', 'int', c_custkey || '.0', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 1, 0, 1, '1', 'float', c_acctbal::VARCHAR, c_acctbal::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 1, 1, 0, '0', 'int', c_nationkey || '.0', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 1, 1, 1, '1', 'float', '1.5', '1.5' FROM customer)"""
_CELL = ["table_idx", "row_idx", "col_idx", "col_name", "col_type", "cell_str", "word"]


@query("h9_extract_cells", f"WITH {ACCOUNT_CELLS} SELECT * FROM account")
def h9_extract_cells(spark, folder):
    cut = sections.sections(inputs.customer_pages(spark, folder))
    return tables.extract_cells(cut.select("page_id", "content"), "content").select("page_id", *_CELL)


@query(
    "h11_tables_by_id",
    f"""WITH {ACCOUNT_CELLS} SELECT page_id, 'account' AS section_id, * EXCLUDE (page_id) FROM account
    UNION ALL SELECT c_custkey, 'end', 0, 0, 0, '0', 'text', 'x', 'x' FROM customer""",
)
def h11_tables_by_id(spark, folder):
    pages = inputs.customer_pages(spark, folder)
    return sections.tables_by_id(pages).select("page_id", "section_id", *_CELL)


@query(
    "h13_page_tables_default_format",
    """WITH c AS (SELECT *, format('{:,.2f}', c_acctbal) AS shown FROM customer)
    SELECT c_custkey AS page_id, 0 AS col_idx, 'float' AS col_type, c_acctbal::VARCHAR AS word FROM c
    UNION ALL SELECT c_custkey, 1, CASE WHEN abs(c_acctbal) < 1000 THEN 'int' ELSE 'text' END,
      CASE WHEN abs(c_acctbal) < 1000 THEN replace(shown, '.', '')::BIGINT::VARCHAR ELSE translate(shown, ',.', ' ,') END FROM c
    UNION ALL SELECT c_custkey, 2, 'int', c_custkey::VARCHAR FROM c""",
)
def h13_page_tables_default_format(spark, folder):
    shown = F.format_number("c_acctbal", 2)
    html = F.concat(
        F.lit("<div><table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>"), shown, F.lit("</td><td>"),
        inputs.spaced_balance(), F.lit("</td><td>"), F.col("c_custkey").cast("string"), F.lit("</td></tr></table></div>"),
    )
    customers = spread(table(spark, folder, "customer").select("c_custkey", "c_acctbal"))
    pages = customers.select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    cells = tables.extract_cells(pages, "html", decimal=".", thousands=",")
    return cells.select("page_id", "col_idx", "col_type", "word")


def nested_parts(spark, folder):
    """Nested rows ``table, question, answers`` of the parts."""
    rows = F.array(F.array("p_name", "p_brand"), F.array("p_type", F.col("p_size").cast("string")))
    return table(spark, folder, "part").select(
        F.struct(F.array(F.lit("what"), F.lit("%")).alias("header"), rows.alias("rows")).alias("table"),
        F.concat(F.lit("Which part is "), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"),
        F.array("p_name", "p_type").alias("answers"),
        F.col("p_partkey").cast("string").alias("question_id"),
    )


@query(
    "s3_flatten_cells",
    """SELECT p_partkey::VARCHAR AS table_id, 0 AS row_idx, 0 AS col_idx, 'what' AS col_name, p_name AS cell FROM part
    UNION ALL SELECT p_partkey::VARCHAR, 0, 1, '%', p_brand FROM part
    UNION ALL SELECT p_partkey::VARCHAR, 1, 0, 'what', p_type FROM part
    UNION ALL SELECT p_partkey::VARCHAR, 1, 1, '%', p_size::VARCHAR FROM part""",
)
def s3_flatten_cells(spark, folder):
    return tables.flatten_nested_qa(nested_parts(spark, folder))[0]


@query(
    "s3_flatten_qa",
    """SELECT p_partkey::VARCHAR AS id, 'Which part is ' || p_partkey || '?' AS utterance, p_partkey::VARCHAR AS context,
    p_name || ' ' || p_type AS "targetValue" FROM part""",
)
def s3_flatten_qa(spark, folder):
    return tables.flatten_nested_qa(nested_parts(spark, folder))[1]


def conversation_cells(spark, folder):
    """Every conversation as a table of its turns."""
    columns = [("turn", F.col("turn").cast("string")), ("role, who", F.col("role")), ("text", F.col("text"))]
    structs = [
        F.struct(F.lit(j).alias("col_idx"), F.lit(name).alias("col_name"), c.alias("cell"))
        for j, (name, c) in enumerate(columns)
    ]
    return table(spark, folder, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("row_idx"), F.explode(F.array(*structs)).alias("_c")
    ).select("conv_id", "row_idx", "_c.*")


def _field(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\",\n\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


@query(
    "p1_table_to_csv",
    f"""SELECT conv_id, md5('turn,"role, who",text' || chr(10) || string_agg(
      turn || ',' || {_field('role')} || ',' || {_field('text')} || chr(10), '' ORDER BY turn)) AS csv_md5
    FROM conversations GROUP BY conv_id""",
)
def p1_table_to_csv(spark, folder):
    texts = tables.table_to_csv(conversation_cells(spark, folder), ["conv_id"])
    return texts.select("conv_id", F.md5("csv").alias("csv_md5"))


@query(
    "p4_reduce_tables",
    """WITH s AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn::INT AS row_idx, 3::BIGINT AS n_cells FROM conversations JOIN s USING (conv_id)
    WHERE turn < n - CASE WHEN n * 3 + 1 > 10 THEN (n * 3 + 1 - 10) // 3 ELSE 0 END""",
)
def p4_reduce_tables(spark, folder):
    cut = tables.reduce_tables(conversation_cells(spark, folder), ["conv_id"], max_size=10)
    return cut.groupBy("conv_id", "row_idx").agg(F.count("*").alias("n_cells"))


_SUPPLIER_TABLES = """t AS (SELECT s_suppkey AS page_id, 0 AS table_idx, 'firm|%' AS header, 0::BIGINT AS n_rows, 2::BIGINT AS n_cols,
    'firm,%' || chr(10) AS csv FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'firm|share', 2, 2, concat('firm,share', chr(10), 'Firm', s_suppkey, ',', chr(10), 'ok,', s_nationkey, chr(10)) FROM supplier)"""


def supplier_tables(spark, folder):
    return tables.read_tables(inputs.supplier_pages(spark, folder).drop("url"), "html")


@query("h9_tables", f"WITH {_SUPPLIER_TABLES} SELECT * EXCLUDE (csv) FROM t")
def h9_tables(spark, folder):
    """The tables of a page, also those without rows."""
    listed = tables.table_list(supplier_tables(spark, folder))
    return listed.withColumn("header", F.array_join("header", "|"))


@query("p1_header_only", f"WITH {_SUPPLIER_TABLES} SELECT page_id, table_idx, csv FROM t")
def p1_header_only(spark, folder):
    """Every table as CSV text, headers from the table list."""
    nested = supplier_tables(spark, folder)
    return tables.table_to_csv(tables.type_cells(nested), ["page_id", "table_idx"], tables=tables.table_list(nested))
