"""Inputs in the library's shapes, derived row by row from the given tables, in Spark and in SQL.

``documents`` are sections whose paragraph is the text, each with a small table of its own facts;
``customer`` rows are wiki pages; ``orders`` are questions about a customer's table; ``lineitem``
rows are answers to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquery.catalog.registry import table
from cellquery.functions import text
from cellquery.operators import matching
from cellquery.operators.tables import position
from cellquery.session import spread

# -- SQL pieces --------------------------------------------------------------------------------

SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160))"
WORD = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)?"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def sql_sentences(x: str, marks: str = "[.!?]") -> str:
    return rf"string_split(regexp_replace({x}, '({marks})\s+', concat('\1', chr(31)), 'g'), chr(31))"


def sql_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{WORD}'))"


def sql_key(x: str) -> str:
    kept = rf"replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), chr(160), '')"
    return rf"trim(regexp_replace(lower({kept}), '\s+', ' ', 'g'))"


def sql_count(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {part}, ''))) // length({part}))"


SENTENCES = f"""sentences AS (
  SELECT doc_id, unnest(range(len(s)))::INT AS sentence_idx, unnest(s) AS sentence
  FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))"""

CELLS = f"""cells AS (
  SELECT doc_id, row_idx, col_idx, {sql_strip('lower(cell)')} AS cell_str FROM (
    SELECT doc_id, 0 AS row_idx, 0 AS col_idx, lang AS cell FROM documents UNION ALL
    SELECT doc_id, 0, 1, source FROM documents UNION ALL
    SELECT doc_id, 0, 2, n_chars::VARCHAR FROM documents UNION ALL
    SELECT doc_id, 1, 0, {sql_sentences('text')}[-1] FROM documents UNION ALL
    SELECT doc_id, 1, 1, regexp_extract(lower(text), '{WORD}') FROM documents UNION ALL
    SELECT doc_id, 1, 2, lang FROM documents))"""

INDEX = """idx AS (
  SELECT doc_id, cell_str, arg_max(row_idx, pos) AS row_idx, arg_max(col_idx, pos) AS col_idx, min(pos) AS first_pos
  FROM (SELECT *, row_idx::BIGINT * 2147483648 + col_idx AS pos FROM cells) GROUP BY doc_id, cell_str)"""

HITS = f"""{SENTENCES}, {CELLS}, {INDEX},
whole AS (SELECT i.*, true AS whole, s.sentence_idx, s.sentence FROM idx i
  JOIN sentences s ON s.doc_id = i.doc_id AND lower(s.sentence) = i.cell_str),
offers AS (SELECT doc_id, sentence_idx, sentence, unnest({sql_words('sentence')}) AS word FROM sentences),
hits AS (SELECT * FROM whole UNION ALL
  SELECT i.*, false, o.sentence_idx, o.sentence FROM idx i
  JOIN offers o ON o.doc_id = i.doc_id AND o.word = i.cell_str
  WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = i.doc_id AND w.cell_str = i.cell_str))"""

STATEMENTS = f"""{HITS},
numbered AS (SELECT *, {sql_strip('lower(sentence)')} AS statement,
  row_number() OVER (ORDER BY doc_id, first_pos, sentence_idx) - 1 AS n FROM hits)"""

QA = """qa AS (SELECT 'nt-' || o_orderkey AS id, 'What is the state of order ' || o_orderkey || '?' AS utterance,
  'customer-' || o_custkey AS context, o_orderstatus || ',' || o_orderpriority AS targetValue FROM orders)"""

ANSWERS = """answers AS (SELECT l_returnflag AS model, l_linenumber AS seed, 'nt-' || l_orderkey AS question_id,
  l_linestatus || ', 5-low!' AS completion FROM lineitem)"""

SCORED = f"""{QA}, {ANSWERS},
split AS (SELECT a.model, a.seed, a.question_id, q.utterance,
    regexp_split_to_array(q.targetValue, '[,|]') AS truth, string_split(a.completion, ',') AS answer
  FROM answers a JOIN qa q ON q.id = a.question_id),
scored AS (SELECT *, len(list_filter(list_transform(answer, lambda x: {sql_key('x')}),
    lambda k: list_contains(list_transform(truth, lambda y: {sql_key('y')}), k))) / len(truth) AS score FROM split)"""

# -- documents ---------------------------------------------------------------------------------


def doc_sections(spark: SparkSession, folder: str, docs: DataFrame | None = None, *beside: str) -> DataFrame:
    docs = table(spark, folder, "documents") if docs is None else docs
    return docs.select(
        *beside,
        F.col("doc_id").alias("page_id"),
        F.lit(0).alias("section_idx"),
        F.col("lang").alias("section_id"),
        F.concat(F.lit("https://example.org/wiki/"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("paragraph"),
    )


def _doc_facts() -> Column:
    """A document's table of its own facts, two rows of three cells."""
    values = [
        (0, 0, F.col("lang")),
        (0, 1, F.col("source")),
        (0, 2, F.col("n_chars").cast("string")),
        (1, 0, F.element_at(text.sentences(F.col("text")), -1)),
        (1, 1, F.regexp_extract(F.lower("text"), WORD, 0)),
        (1, 2, F.col("lang")),
    ]
    structs = [F.struct(F.lit(i).alias("row_idx"), F.lit(j).alias("col_idx"), c.alias("cell")) for i, j, c in values]
    return F.array(*structs)


def doc_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit(0).alias("section_idx"), F.lit(0).alias("table_idx"), F.explode(_doc_facts()).alias("_c")
    ).select("page_id", "section_idx", "table_idx", "_c.*")
    return cells.withColumn("cell_str", text.strip(F.lower("cell")))


def doc_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and their table in one row, as matching within a row takes them."""
    cells = F.transform(
        _doc_facts(),
        lambda c: F.struct(
            text.strip(F.lower(c["cell"])).alias("cell_str"), position(c["row_idx"], c["col_idx"], F.lit(False)).alias("pos")
        ),
    )
    docs = table(spark, folder, "documents").withColumn("_cells", cells)
    sections = doc_sections(spark, folder, docs, "_cells")
    spoken = matching.said(text.sentences(F.col("paragraph")))
    return sections.withColumn("table_idx", F.lit(0)).withColumnRenamed("_cells", "cells").withColumn("_said", spoken).drop("paragraph")


# -- customers as tables and as pages ----------------------------------------------------------


def customer_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Tables ``customer-<key>`` of one row and three columns."""
    columns = [("name", F.col("c_name")), ("%", F.col("c_mktsegment")), ("nation", F.col("c_nationkey").cast("string"))]
    structs = [
        F.struct(F.lit(j).alias("col_idx"), F.lit(name).alias("col_name"), c.alias("cell"))
        for j, (name, c) in enumerate(columns)
    ]
    return table(spark, folder, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("table_id"),
        F.lit(0).alias("row_idx"),
        F.explode(F.array(*structs)).alias("_c"),
    ).select("table_id", "row_idx", "_c.*")


CUSTOMER_CELLS = """customer_cells AS (
  SELECT 'customer-' || c_custkey AS table_id, 0 AS row_idx, 0 AS col_idx, 'name' AS col_name, c_name AS cell FROM customer
  UNION ALL SELECT 'customer-' || c_custkey, 0, 1, '%', c_mktsegment FROM customer
  UNION ALL SELECT 'customer-' || c_custkey, 0, 2, 'nation', c_nationkey::VARCHAR FROM customer)"""


def _cell(c: Column | str) -> Column:
    return F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, F.lit("</td>"))


def _row(*cells: Column) -> list[Column]:
    return [F.lit("<tr>"), *[_cell(c) for c in cells], F.lit("</tr>")]


def spaced_balance() -> Column:
    """``1 863,84`` of 1863.84."""
    return F.translate(F.format_number("c_acctbal", 2), ",.", " ,")


def customer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One wiki page per customer: account (text, a mixed and an all-numeric table), a skipped section,
    an ``account`` again without tables, and a last section."""
    comma = F.translate(F.format_string("%.2f", "c_acctbal"), ".", ",")
    cite = '<sup class="reference" id="r"><a href="#n">[1]</a></sup><span class="cite-bracket">[</span>'
    html = [
        F.lit('<html><body><p>lead</p><h2 class="x" id="account">Account</h2><p>'),
        F.col("c_name"),
        F.lit(" holds "),
        comma,
        F.lit(f" coins.{cite} The segment – is "),
        F.col("c_mktsegment"),
        F.lit(".</p><table><tr><th>name</th><th>balance</th><th>nation</th></tr>"),
        *_row(F.col("c_name"), spaced_balance(), F.col("c_nationkey").cast("string")),
        *_row(F.col("c_mktsegment"), "", F.col("c_custkey").cast("string")),
        F.lit("</table><table>"),
        *_row(F.col("c_custkey").cast("string"), spaced_balance()),
        *_row(F.col("c_nationkey").cast("string"), "1,5"),
        F.lit('</table><h2 id="Kapcsolódó_szócikkek">See</h2><p>'),
        F.col("c_mktsegment"),
        F.lit('</p><h2 id="account">Again</h2><p>No table.</p><h2 id="end">End</h2><p>'),
        F.col("c_name"),
        F.lit("</p><table><tr><td>x</td></tr></table></body></html>"),
    ]
    return spread(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")).select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit("https://hu.wikipedia.org/wiki/"), "c_name").alias("url"),
        F.concat(*html).alias("html"),
    )


def supplier_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One wiki page per supplier: two sentences, a table of a header only, and one with an empty cell."""
    firm = F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"))
    share = F.col("s_nationkey").cast("string")
    html = [
        F.lit('<p>lead</p><h2 id="data">Data</h2><p>'), firm, F.lit(" said nan, and "), share, F.lit(",0 more. So "), firm,
        F.lit("; ok</p><table><tr><th>firm</th><th>%</th></tr></table><table><tr><th>firm</th><th>share</th></tr>"),
        *_row(firm, ""), *_row("ok", share), F.lit('</table><h2 id="z">Z</h2>'),
    ]
    return spread(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")).select(
        F.col("s_suppkey").alias("page_id"),
        F.concat(F.lit("https://hu.wikipedia.org/wiki/S"), F.col("s_suppkey").cast("string")).alias("url"),
        F.concat(*html).alias("html"),
    )


# Hits of a supplier's page: cell, place of the cell, sentence; strict ones, those of null cells, loose ones.
_FIRM = "'firm' || s_suppkey"
_SHARE = "s_nationkey || '.0'"
_FIRST = f"{_FIRM} || ' said nan, and ' || {_SHARE} || ' more.'"
_SECOND = f"'so ' || {_FIRM} || '; ok'"


def supplier_hits(strict: bool = True, null_as_nan: bool = False) -> str:
    hits = [(_FIRM, 0, 4, _FIRST), (_FIRM, 0, 5, _SECOND), (_SHARE, 3, 4, _FIRST)]
    if strict:
        hits += [("'ok'", 2, 5, _SECOND)]
    else:
        hits += [(_FIRM, 0, 0, f"{_FIRM} || ' said nan,'"), (_FIRM, 0, 2, f"'so ' || {_FIRM} || ';'")]
        hits += [("'ok'", 2, 3, "'ok'"), (_SHARE, 3, 1, f"'and ' || {_SHARE} || ' more.'")]
    if null_as_nan:
        hits += [("'nan'", 1, 4, _FIRST)]
    rows = " UNION ALL ".join(
        f"SELECT s_suppkey, s_acctbal, 'S' || s_suppkey || '_data_1' AS context, {word} AS word, {pos} AS pos, {at} AS sentence, {said} AS original FROM supplier"
        for word, pos, at, said in hits
    )
    return f"supplier_hits AS ({rows})"


# -- orders as questions, line items as answers ------------------------------------------------


def order_qa(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("nt-"), key).alias("id"),
        F.concat(F.lit("What is the state of order "), key, F.lit("?")).alias("utterance"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("context"),
        F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("targetValue"),
    )


def lineitem_answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linenumber").alias("seed"),
        F.concat(F.lit("nt-"), F.col("l_orderkey").cast("string")).alias("question_id"),
        F.concat("l_linestatus", F.lit(", 5-low!")).alias("completion"),
    )
