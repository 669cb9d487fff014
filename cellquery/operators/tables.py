"""Data tables: from HTML or nested columns to long-form cells, and from cells back to text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellquery.functions import typing as typed
from cellquery.functions.fragments import SectionReader, grids
from cellquery.functions.text import strip

_ROW = T.ArrayType(T.StringType())
TABLES_TYPE = T.ArrayType(
    T.StructType([T.StructField("header", _ROW), T.StructField("rows", T.ArrayType(_ROW))])
)
_TEXTS = pa.list_(pa.string())
_TABLES = pa.list_(pa.struct([("header", _TEXTS), ("rows", pa.list_(_TEXTS))]))
SLICE_ROWS = 256
CELL_COLUMNS = ["row_idx", "col_idx", "col_name", "col_type", "cell", "cell_str", "word", "upcast"]


@F.pandas_udf(T.StringType())
def _remove_citations(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda f: SectionReader().read(f).html, na_action="ignore")


def remove_citations(c: Column) -> Column:
    """HTML without ``cite-bracket`` elements and ``sup`` elements of class ``reference``."""
    return _remove_citations(c)


def read_fragments(df: DataFrame, html: str, clean: bool = True) -> DataFrame:
    """Replace the column ``html`` by ``clean_html`` (no citation marks; if ``clean``) and ``tables``; one parse.

    A Python step of its own, so that no filter on its results can make Spark parse twice. Batches
    are read in slices, which bounds what Python holds of large pages.
    """
    keep = [f for f in df.schema.fields if f.name != html]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        for part in slices:
            values = [value or "" for value in part.column(html).to_pylist()]
            columns = {f.name: part.column(f.name) for f in keep}
            if clean:
                readers = [SectionReader().read(value) for value in values]
                columns["clean_html"] = pa.array([r.html for r in readers], pa.string())
                columns["tables"] = pa.array([r.grids() for r in readers], _TABLES)
            else:
                columns["tables"] = pa.array([grids(value) for value in values], _TABLES)
            yield pa.RecordBatch.from_pydict(columns)

    made = [T.StructField("clean_html", T.StringType())] if clean else []
    schema = T.StructType([*keep, *made, T.StructField("tables", TABLES_TYPE)])
    return df.mapInArrow(read, schema)


def explode_tables(df: DataFrame, tables: str = "tables") -> DataFrame:
    """One row per table: ``table_idx, header, rows`` beside the other columns."""
    rest = [c for c in df.columns if c != tables]
    return _explode(df, tables, rest, "table_idx", "_table").select(
        *rest, "table_idx", F.col("_table.header").alias("header"), F.col("_table.rows").alias("rows")
    )


def _explode(df: DataFrame, array: str, rest: list[str], at: str, item: str) -> DataFrame:
    """``posexplode`` of a computed array.

    The outer form, as for the plain one Spark adds a filter on the array's size below and so
    computes the array twice.
    """
    return df.select(*rest, F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that later lambdas may use.

    Spark moves a projection into the only expression that uses it, even into a lambda, where it
    would be computed anew for every element; it does not move one through a generator.
    """
    rest = df.columns
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*rest, F.explode_outer(F.array(made)).alias("_once")).select(*rest, "_once.*")


def position(row_idx: Column, col_idx: Column, upcast: Column) -> Column:
    """Row-major place in one long, the ``upcast`` mark in its lowest bit."""
    return (
        F.shiftleft(row_idx.cast("long"), 32) + F.shiftleft(col_idx.cast("long"), 1) + upcast.cast("long")
    )


def table_list(tables: DataFrame) -> DataFrame:
    """The tables themselves: their keys, ``header, n_rows, n_cols``; also those without rows."""
    keys = [c for c in tables.columns if c not in ("header", "rows")]
    widest = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))
    return tables.select(
        *keys,
        "header",
        F.size("rows").cast("bigint").alias("n_rows"),
        F.greatest(F.size("header"), widest).cast("bigint").alias("n_cols"),
    )


def _typed(tables: DataFrame, decimal: str, thousands: str | None) -> DataFrame:
    """Nested tables with ``_coded`` cells, the ``_types`` of their columns, and ``_all_numeric``."""
    keys = [c for c in tables.columns if c not in ("header", "rows")]
    coded = tables.select(
        *keys,
        "header",
        typed.coded_rows(F.col("rows"), decimal, thousands).alias("_coded"),
    )
    return coded.select(
        "*", typed.column_types(F.col("_coded"), F.size("header")).alias("_types")
    ).select(
        *keys,
        "header",
        "_types",
        "_coded",
        (
            F.forall("_types", lambda t: t.isin("int", "float"))
            & F.array_contains("_types", "float")
        ).alias("_all_numeric"),
    )


def _cell_text(cell: Column, col_type: Column, null_as_nan: bool) -> Column:
    """The lowercase text of a cell as its column reads."""
    text = typed.typed_text(cell, col_type)
    return strip(F.lower(F.coalesce(text, F.lit("nan")) if null_as_nan else text))


def _as_text(cell: Column) -> Column:
    return F.when(cell["code"] != 0, cell["text"])


def nested_cells(
    tables: DataFrame, decimal: str = ",", thousands: str | None = " ", null_as_nan: bool = False
) -> DataFrame:
    """Nested tables with ``cells``, all their match keys as ``array<struct(cell_str, pos)>``, instead of the rows.

    The same texts as those of ``type_cells``, for matching within one row.
    """
    keys = [c for c in tables.columns if c not in ("header", "rows")]
    kinds = _typed(tables, decimal, thousands)
    named = F.transform("_types", lambda t: F.struct(t.alias("type"), ((t == "int") & F.col("_all_numeric")).alias("upcast")))
    fixed = once(kinds.select(*keys, "_types", "_all_numeric", "_coded"), _kinds=named)

    def place(i: Column):
        def of_cell(c: Column, j: Column) -> Column:
            kind = F.get("_kinds", j)
            word = _cell_text(_as_text(c), kind["type"], null_as_nan)
            text = F.when(kind["upcast"], F.concat(word, F.lit(".0"))).otherwise(word)
            return F.struct(text.alias("cell_str"), position(i, j, F.coalesce(kind["upcast"], F.lit(False))).alias("pos"))

        return of_cell

    cells = F.flatten(F.transform("_coded", lambda row, i: F.transform(row, place(i))))
    return fixed.select(*keys, cells.alias("cells"))


def type_cells(
    tables: DataFrame,
    decimal: str = ",",
    thousands: str | None = " ",
    null_as_nan: bool = False,
) -> DataFrame:
    """Long-form typed cells of nested tables (``header``, ``rows``); every step is row-local.

    ``cell`` is the cleaned text, ``cell_str`` the lowercase match key as the row reads (in an
    all-numeric table with a float column, whole numbers read ``5.0``; ``upcast`` marks them) and
    ``word`` the answer as the column reads. A table without rows has no cells; ``table_list`` has it.
    """
    keys = [c for c in tables.columns if c not in ("header", "rows")]
    kinds = _typed(tables, decimal, thousands)
    rows = _explode(kinds, "_coded", [*keys, "header", "_types", "_all_numeric"], "row_idx", "_row")
    cells = rows.select(
        *keys,
        "row_idx",
        "header",
        "_types",
        "_all_numeric",
        F.posexplode("_row").alias("col_idx", "_cell"),
    ).select(
        *keys,
        "row_idx",
        "col_idx",
        F.get("header", F.col("col_idx")).alias("col_name"),
        F.get("_types", F.col("col_idx")).alias("col_type"),
        _as_text(F.col("_cell")).alias("cell"),
        "_all_numeric",
    )
    upcast = F.col("_all_numeric") & (F.col("col_type") == "int")
    word = _cell_text(F.col("cell"), F.col("col_type"), null_as_nan)
    cells = cells.withColumn("word", word).withColumn("upcast", upcast)
    return cells.withColumn(
        "cell_str", F.when(F.col("upcast"), F.concat("word", F.lit(".0"))).otherwise(F.col("word"))
    ).select(*keys, *CELL_COLUMNS)


def read_tables(df: DataFrame, html: str) -> DataFrame:
    """Nested tables (``table_idx, header, rows``) of the HTML column, also those without rows."""
    return explode_tables(read_fragments(df, html, clean=False))


def extract_cells(
    df: DataFrame, html: str, decimal: str = ",", thousands: str | None = " ", **typing
) -> DataFrame:
    """Typed cells of every table in the HTML column."""
    return type_cells(read_tables(df, html), decimal, thousands, **typing)


def flatten_nested_qa(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cells, qa)`` of rows ``question_id, table, question, answers``; short rows are filled with null."""
    rows = df.select("question_id", "table.header", F.posexplode("table.rows").alias("row_idx", "_row"))
    named = F.transform(
        "header",
        lambda name, at: F.struct(name.alias("col_name"), F.get("_row", at).alias("cell")),
    )
    cells = rows.select(
        F.col("question_id").alias("table_id"), "row_idx", F.posexplode(named).alias("col_idx", "_cell")
    ).select("table_id", "row_idx", "col_idx", "_cell.col_name", "_cell.cell")
    qa = df.select(
        F.col("question_id").alias("id"),
        F.col("question").alias("utterance"),
        F.col("question_id").alias("context"),
        F.array_join("answers", " ").alias("targetValue"),
    )
    return cells, qa


def normalize_headers(c: Column) -> Column:
    """Header ``%`` becomes ``Percentage``, an empty header ``Empty``."""
    return F.when(c == "%", "Percentage").when(c == "", "Empty").otherwise(c)


# -- whole tables ------------------------------------------------------------------------------


def _csv_field(c: Column, alone: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]') | ((text == "") & alone), quoted).otherwise(text)


def _ordered_text(idx: str, text: str, separator: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(idx, text)))
    return F.array_join(F.transform(items, lambda i: i[text]), separator)


def _csv_line(fields: Column) -> Column:
    alone = F.size(fields) == 1
    return F.array_join(F.transform(fields, lambda f: _csv_field(f, alone)), ",")


def table_to_csv(
    cells: DataFrame, keys: list[str], rows_per_block: int = 10_000, tables: DataFrame | None = None
) -> DataFrame:
    """``keys, csv``: each table as CSV text, header first, ``\\n`` after every line.

    Every row of a table has all its columns, as all sources here give it; the first one names them.
    With ``tables`` (``keys, header``) they are named there, and tables without rows come out too.

    One pass over the cells and one shuffle, by table. Lines are built per row, then per block of
    rows, then per table, so the only thing a single task holds whole is the text that is the result.
    """
    field = F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("text"), F.when(F.col("row_idx") == 0, F.col("col_name")).alias("name"))
    raw = (
        cells.repartition(*keys)
        .groupBy(*keys, F.col("row_idx").cast("bigint").alias("_row"))
        .agg(F.array_sort(F.collect_list(field)).alias("_fields"))
    )
    line = _csv_line(F.transform("_fields", lambda f: f["text"]))
    if tables is None:
        named = _csv_line(F.transform("_fields", lambda f: f["name"]))
        line = F.when(F.col("_row") == 0, F.concat(named, F.lit("\n"), line)).otherwise(line)
    lines = raw.select(*keys, "_row", F.floor(F.col("_row") / rows_per_block).alias("_block"), line.alias("_line"))
    blocks = lines.groupBy(*keys, "_block").agg(_ordered_text("_row", "_line", "\n").alias("_part"))
    body = blocks.groupBy(*keys).agg(F.concat(_ordered_text("_block", "_part", "\n"), F.lit("\n")).alias("csv"))
    if tables is None:
        return body
    header = tables.select(*keys, F.concat(_csv_line(F.col("header")), F.lit("\n")).alias("_header"))
    return header.join(body, keys, "left").select(*keys, F.concat("_header", F.coalesce("csv", F.lit(""))).alias("csv"))


def table_sizes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_rows, n_cols`` of every table."""
    return cells.groupBy(*keys).agg(
        (F.max("row_idx") + 1).cast("bigint").alias("n_rows"),
        (F.max("col_idx") + 1).cast("bigint").alias("n_cols"),
    )


def reduce_tables(cells: DataFrame, keys: list[str], max_size: int = 64) -> DataFrame:
    """Cells of tables cut from the end so that ``rows * cols + 1`` comes near ``max_size``.

    A table over the limit by less than one row keeps all its rows.
    """
    size = F.col("n_rows") * F.col("n_cols") + 1
    surplus = F.when(
        size > max_size, F.floor((size - max_size) / F.col("n_cols"))
    ).otherwise(0)
    limits = (
        table_sizes(cells, keys)
        .withColumn("_keep", F.greatest(F.col("n_rows") - surplus, F.lit(0)))
        .filter(F.col("_keep") < F.col("n_rows"))
        .select(*keys, "_keep")
    )
    return (
        cells.join(limits, keys, "left")
        .filter(F.col("_keep").isNull() | (F.col("row_idx") < F.col("_keep")))
        .drop("_keep")
    )
