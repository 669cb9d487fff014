"""Hits to QA rows, and the question texts of QA rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators.numbering import number_by_group
from cellquery.operators.sections import table_id

# Hungarian question words.
QUESTION_WORDS = [
    "ki", "kik", "mi", "mik", "kit", "mit", "kivel", "mivel", "hol", "hová", "honnan", "mikor",
    "meddig", "mióta", "milyen gyakran", "hány", "mennyi", "hányszor",
]
HIT_ORDER = ["section_idx", "table_idx", "first_pos", "sentence_idx"]
PLACEHOLDER = "e"
QA_COLUMNS = ["id", "utterance", "context", "targetValue", "valid", "original"]


def question_id(n: Column) -> Column:
    return F.concat(F.lit("nt-"), n.cast("string"))


def question_number(qid: Column) -> Column:
    """``N`` of ``nt-N``; null for other ids."""
    return F.regexp_extract(qid, r"^nt-(\d+)$", 1).try_cast("bigint")


def statements(matches: DataFrame, start: int = 0, page: str = "page_id", order_by: list[str] = HIT_ORDER) -> DataFrame:
    """Hits with ``statement`` and the dense question number ``n``, in page, table and cell order."""
    named = matches.withColumn("statement", text.strip(F.lower("sentence")))
    return number_by_group(named, page, order_by, "n", start)


def build_qa(numbered: DataFrame, context: Column, candidates: DataFrame | None = None) -> DataFrame:
    """QA rows of numbered statements (``n, statement, word``).

    With no candidates the questions are left for later: the placeholder, not valid. With mask-fill
    candidates (``statement_id, rank, token``) each becomes a question; a refused statement, or one
    without candidates, gets no question and is not valid.
    """
    qa = numbered.select(
        question_id(F.col("n")).alias("id"),
        F.lit(PLACEHOLDER).alias("utterance"),
        context.alias("context"),
        F.col("word").alias("targetValue"),
        F.lit(False).alias("valid"),
        F.col("statement").alias("original"),
    )
    if candidates is None:
        return qa
    return _ask(qa, candidates, "match").select(
        "id",
        F.col("_asked.question").alias("utterance"),
        "context",
        "targetValue",
        F.coalesce("_asked.valid", F.lit(False)).alias("valid"),
        "original",
    )


def section_context() -> Column:
    """The display name of the table of a hit."""
    return table_id(F.col("url"), F.col("section_id"), F.col("table_idx"))


def _outranked_left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a statement in a batch the ones of lowest ``rank`` and of lowest ``_listed_rank``, nulls last."""

    def places(ranks: pa.Array) -> np.ndarray:
        coded = ranks.dictionary_encode()
        last = len(coded.dictionary)
        place = np.full(last + 1, last)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(last)
        return place[coded.indices.fill_null(last).to_numpy()]

    for batch in batches:
        if batch.num_rows:
            group = batch.column("statement_id").dictionary_encode("encode").indices.to_numpy()
            rank, listed = places(batch.column("rank")), places(batch.column("_listed_rank"))
            orders = [np.lexsort((rank, group)), np.lexsort((rank, listed, group))]
            kept = [by[np.flatnonzero(np.diff(group[by], prepend=-1))] for by in orders]
            yield batch.take(pa.array(np.unique(np.concatenate(kept))))


def pick_question_word(candidates: DataFrame, words: list[str] = QUESTION_WORDS) -> DataFrame:
    """``statement_id, token, valid``: the best-ranked listed word, else the best token in lowercase.

    Texts are aggregated by sorting, so candidates that others of their statement in the same Arrow
    batch outrank leave before: at most two of a statement are sorted and shuffled per batch.
    """
    marked = candidates.select("statement_id", "rank", "token", F.when(F.lower("token").isin(words), F.col("rank")).alias("_listed_rank"))
    best = marked.mapInArrow(_outranked_left_out, marked.schema).groupBy("statement_id").agg(
        F.min_by("token", "_listed_rank").alias("_listed"), F.min_by("token", "rank").alias("_top")
    )
    return best.select(
        "statement_id",
        F.coalesce("_listed", F.lower("_top")).alias("token"),
        F.col("_listed").isNotNull().alias("valid"),
    )


def _ask(qa: DataFrame, candidates: DataFrame, variant: str) -> DataFrame:
    """``qa`` with ``_asked``: ``struct(question, valid)`` by guard, mask and question word."""
    statement, answer = F.col("original"), F.col("targetValue")
    masked = text.mask_statement(statement, answer)
    picked = pick_question_word(candidates).select(
        F.col("statement_id").alias("id"), "token", F.col("valid").alias("_picked_valid")
    )
    guard = F.col("_guard")
    asked = F.when(guard["refused"], F.struct(guard["question"].alias("question"), guard["valid"].alias("valid")))
    return (
        qa.join(picked, "id", "left")
        .withColumn("_guard", text.question_guard(statement, answer, variant))
        .withColumn(
            "_asked",
            asked.when(
                text.one_mask(masked),
                F.struct(text.fill_mask(masked, F.col("token")).alias("question"), F.col("_picked_valid").alias("valid")),
            ).otherwise(F.struct(F.lit(None).cast("string").alias("question"), F.lit(False).alias("valid"))),
        )
        .drop("_guard", "token", "_picked_valid")
    )


def rework_qa(qa: DataFrame, candidates: DataFrame, store_valid: bool = False) -> DataFrame:
    """QA rows with ``utterance`` made anew from statement, answer and candidates.

    ``valid`` stays as stored unless asked for. A statement whose mask is cut off with its last
    character gets no question.
    """
    asked = _ask(qa, candidates, "rework")
    valid = F.coalesce("_asked.valid", F.lit(False)) if store_valid else F.col("valid")
    return asked.select(
        "id",
        F.col("_asked.question").alias("utterance"),
        "context",
        "targetValue",
        valid.alias("valid"),
        "original",
    )


def sample_cells(cells: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` cells of every table in a random order that ``seed`` fixes, with their ``draw`` number.

    Cells are drawn without replacement. The limit on the row number lets Spark cut every task's
    share of a table to ``n`` cells before the shuffle, so a table of any size is safe.
    """
    order = F.xxhash64(*keys, "row_idx", "col_idx", F.lit(seed))
    draws = Window.partitionBy(*keys).orderBy("_order", "row_idx", "col_idx")
    return (
        cells.select(*keys, "row_idx", "col_idx", "cell", order.alias("_order"))
        .withColumn("draw", F.row_number().over(draws))
        .filter(F.col("draw") <= n)
        .select(*keys, (F.col("draw") - 1).alias("draw"), "row_idx", "col_idx", "cell")
    )
