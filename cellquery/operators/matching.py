"""The core join: table cells against the sentences of the paragraph of their section.

A *section key* names a section, a *table key* a table in it. Cells carry ``row_idx, col_idx,
cell_str`` (optionally ``upcast``), sentences ``sentence_idx, sentence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators.tables import once, position

SECTION_KEYS = ["page_id", "section_idx"]
TABLE_KEYS = ["page_id", "section_idx", "table_idx"]


def sentence_rows(
    sections: DataFrame,
    paragraph: str = "paragraph",
    keys: list[str] = SECTION_KEYS,
    strict: bool = True,
    beside: list[str] = (),
) -> DataFrame:
    """``keys, sentence_idx, sentence`` of every section, and the columns ``beside`` them."""
    return sections.select(
        *keys,
        *beside,
        F.posexplode(text.sentences(F.col(paragraph), strict)).alias("sentence_idx", "sentence"),
    )


def place_columns(cell_str: Column, first: Column, last: Column) -> list[Column]:
    """``cell_str``, its last coordinate, ``first_pos`` for the order, and the answer ``word``."""
    whole_number = last.bitwiseAND(1) == 1
    return [
        cell_str.alias("cell_str"),
        F.shiftright(last, 32).cast("int").alias("row_idx"),
        F.shiftright(last.bitwiseAND(0xFFFFFFFF), 1).cast("int").alias("col_idx"),
        F.shiftright(first, 1).alias("first_pos"),
        F.when(whole_number, F.regexp_replace(cell_str, r"\.0$", "")).otherwise(cell_str).alias("word"),
    ]


def cell_index(cells: DataFrame, table_keys: list[str] = TABLE_KEYS) -> DataFrame:
    """One row per table and cell text: its last coordinate, ``first_pos`` for the order, ``word``.

    Only two longs are aggregated, so this is a hash aggregate with a map-side part, and a text
    that fills a column arrives at the shuffle once per task.
    """
    upcast = F.col("upcast") if "upcast" in cells.columns else F.lit(False)
    found = (
        cells.filter(F.col("cell_str").isNotNull())
        .withColumn("_pos", position(F.col("row_idx"), F.col("col_idx"), upcast))
        .groupBy(*table_keys, "cell_str")
        .agg(F.max("_pos").alias("_last"), F.min("_pos").alias("_first"))
    )
    return found.select(*table_keys, *place_columns(F.col("cell_str"), F.col("_first"), F.col("_last")))


def said(sentences: Column) -> Column:
    """Sentences as ``struct(sentence_idx, sentence, lower, words)``; words are cut out once."""
    return F.transform(
        sentences,
        lambda s, at: F.struct(
            at.cast("int").alias("sentence_idx"),
            s.alias("sentence"),
            F.lower(s).alias("lower"),
            text.words(s).alias("words"),
        ),
    )


def _mentioned(cells: Column, said: Column) -> Column:
    """The texts of ``cells`` that are a sentence or a word of one; found by hash, not cell by cell."""
    offered = F.concat(F.transform(said, lambda s: s["lower"]), F.flatten(F.transform(said, lambda s: s["words"])))
    return F.array_intersect(F.transform(cells, lambda c: c["cell_str"]), offered)


def _hits(df: DataFrame, rest: list[str]) -> DataFrame:
    """``rest``, ``_cell`` and ``_said`` of all hits, from rows with arrays ``_cells`` and ``_said``.

    ``_cells`` are distinct cells that are mentioned, which are few. The outer forms of ``explode``
    leave out the filters that Spark would otherwise put below, with all that they compute.
    """
    whole = F.array_intersect(F.transform("_cells", lambda c: c["cell_str"]), F.transform("_said", lambda s: s["lower"]))
    rows = once(df, _whole=whole).select(*rest, "_cells", "_whole", F.explode_outer("_said").alias("_s"))

    def in_sentence(c: Column) -> Column:
        equal = c["cell_str"] == F.col("_s.lower")
        return F.when(F.array_contains("_whole", c["cell_str"]), equal).otherwise(
            F.array_contains("_s.words", c["cell_str"])
        )

    hits = rows.select(*rest, "_whole", F.col("_s").alias("_said"), F.explode_outer(F.filter("_cells", in_sentence)).alias("_cell"))
    found = hits.filter(F.col("_cell").isNotNull())
    return found.withColumn("_is_whole", F.array_contains("_whole", F.col("_cell.cell_str"))).drop("_whole")


_HIT = ["row_idx", "col_idx", "cell_str", "word", "first_pos"]


def match_tables(tables: DataFrame, keys: list[str] = TABLE_KEYS, beside: list[str] = ()) -> DataFrame:
    """Hits of tables in the paragraph beside them; every step is within one row, nothing is shuffled.

    ``tables`` has a row per table: ``keys``, the columns ``beside``, ``_said`` (see ``said``) and
    ``cells``, an array of ``struct(cell_str, pos)`` (see ``position``). Cells that the paragraph does
    not mention leave before anything is sorted.
    """
    rest = [*keys, *beside]
    named = once(
        tables.select(*rest, "_said", F.filter("cells", lambda c: c["cell_str"].isNotNull()).alias("cells")),
        _texts=_mentioned(F.col("cells"), F.col("_said")),
    )
    mentioned = F.filter("cells", lambda c: F.array_contains("_texts", c["cell_str"]))
    ordered = once(named.select(*rest, "_said", "_texts", "cells"), _sorted=F.array_sort(mentioned))
    is_other = lambda at, x: F.coalesce(F.get("_sorted", at)["cell_str"] != x["cell_str"], F.lit(True))
    first = F.filter("_sorted", lambda x, at: (at == 0) | is_other(F.greatest(at - 1, F.lit(0)), x))
    last = F.filter("_sorted", lambda x, at: is_other(at + 1, x))
    index = once(
        ordered.select(*rest, "_said", "_sorted"),
        _cells=F.zip_with(first, last, lambda a, b: F.struct(*place_columns(a["cell_str"], a["pos"], b["pos"]))),
    )
    found = _hits(index.select(*rest, "_said", "_cells"), rest)
    return found.select(*rest, *[f"_cell.{c}" for c in _HIT], F.col("_is_whole").alias("whole"), "_said.sentence_idx", "_said.sentence")


def match_cells(
    cells: DataFrame,
    sentences: DataFrame,
    section_keys: list[str] = SECTION_KEYS,
    table_keys: list[str] = TABLE_KEYS,
) -> DataFrame:
    """Hits of cells in sentences: whole-sentence hits, and word hits for cells without one.

    For inputs that come apart: each is shuffled once, by section, and the cells and the sentences of
    a section meet as two arrays in one row (a section is part of a page, which is read whole
    anyway). Other columns of ``sentences`` stay beside the hits.
    """
    inner = [k for k in table_keys if k not in section_keys]
    known = {*section_keys, "sentence_idx", "sentence"}
    beside = [c for c in sentences.columns if c not in known]
    index = cell_index(cells.repartition(*section_keys), table_keys)
    nested = index.groupBy(*section_keys).agg(F.collect_list(F.struct(*inner, *_HIT)).alias("_all"))
    spoken = F.struct(
        "sentence_idx", "sentence", F.lower("sentence").alias("lower"), text.words(F.col("sentence")).alias("words"), *beside
    )
    told = sentences.groupBy(*section_keys).agg(F.collect_list(spoken).alias("_said"))
    both = once(nested.join(told.hint("merge"), section_keys), _texts=_mentioned(F.col("_all"), F.col("_said")))
    mentioned = F.filter("_all", lambda c: F.array_contains("_texts", c["cell_str"]))
    found = _hits(once(both, _cells=mentioned).select(*section_keys, "_said", "_cells"), section_keys)
    return found.select(
        *section_keys,
        *[f"_cell.{c}" for c in inner],
        *[f"_said.{c}" for c in beside],
        *[f"_cell.{c}" for c in _HIT],
        F.col("_is_whole").alias("whole"),
        "_said.sentence_idx",
        "_said.sentence",
    )


def numeric_only(matches: DataFrame) -> DataFrame:
    """Hits whose answer reads as a number."""
    return matches.filter(text.is_number(F.col("word")))
