"""Pages, nested QA, table trees, dumps, line lists, result files and model lists."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellquery.operators.numbering import dense_number
from cellquery.operators.tables import type_cells
from cellquery.session import materialize

PAGES = "page_id long, url string, html string"
NESTED_QA = "table struct<header:array<string>,rows:array<array<string>>>, question string, answers array<string>"
TRAINING = "id string, utterance string, context string, targetValue string"
MODELS = "name string, url string, model_type string, layer_offset int, prompt_format int"
DUMP_PAGE = "title string, revision array<struct<id:long,text:string>>"
RESULTS = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Dataset name", T.StringType()),
        T.StructField("Dataset size", T.LongType()),
        T.StructField("Dataset language", T.StringType()),
        T.StructField("Model name", T.StringType()),
        T.StructField("Iteration speed", T.StringType()),
        T.StructField("Score", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages."""
    return spark.read.schema(PAGES).parquet(path)


def read_nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, table, question, answers``; the id is the file name and the row in it."""
    row = F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return spark.read.schema(NESTED_QA).parquet(path).select(row.alias("question_id"), "*")


# -- table trees -------------------------------------------------------------------------------


def _parse_files(separator: str):
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            headers, rows = [], []
            for value in frame["value"]:
                try:
                    table = pd.read_csv(
                        io.StringIO(value), sep=separator, dtype=str, keep_default_na=False
                    )
                    headers.append([str(c) for c in table.columns])
                    rows.append(table.to_numpy().tolist())
                except ValueError:
                    headers.append(None)
                    rows.append(None)
            yield pd.DataFrame({"stem": frame["stem"], "header": headers, "rows": rows})

    return parse


def _stem(ending: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), rf"\Q{ending}\E$", "").alias("stem")


def _table_files(spark: SparkSession, paths: str | list[str], ending: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}")
    return reader.text(paths, wholetext=True).select(_stem(ending), "value")


def _substitutes(spark: SparkSession, folder: str, broken: DataFrame) -> list[str]:
    """The ``.csv`` files beside broken ``.tsv`` files. Only names are listed, no content is read; the
    driver lists all files of a folder anyway."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    return [r["path"] for r in listed.select(_stem(".csv"), "path").join(broken, "stem", "left_semi").collect()]


def read_table_tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(cells, qa)`` of a tree ``csv/<dir>/<n>.tsv`` with questions in ``data/training.tsv``.

    A ``.tsv`` that cannot be read is replaced by the ``.csv`` of the same name. Tables are named
    ``csv/<dir>/<n>.csv``, as the questions name them. Every file is parsed once: a parse gives its
    rows or, with a null header, the mark that it failed, and that is written out.
    """
    schema = "stem string, header array<string>, rows array<array<string>>"
    tsv = materialize(_table_files(spark, f"{folder}/csv", ".tsv").mapInPandas(_parse_files("\t"), schema))
    others = _substitutes(spark, f"{folder}/csv", tsv.filter(F.col("header").isNull()).select("stem"))
    csv = tsv.limit(0)
    if others:
        csv = _table_files(spark, others, ".csv").mapInPandas(_parse_files(","), schema)
    tables = tsv.unionByName(csv).filter(F.col("header").isNotNull())
    parts = F.split("stem", "/")
    name = F.concat(
        F.lit("csv/"), F.url_decode(F.element_at(parts, -2)), F.lit("/"), F.url_decode(F.element_at(parts, -1)), F.lit(".csv")
    )
    cells = type_cells(
        tables.select(name.alias("table_id"), "header", "rows"), decimal=".", thousands=None
    )
    qa = spark.read.schema(TRAINING).csv(
        f"{folder}/data/training.tsv", sep="\t", header=True, quote='"', escape='"'
    )
    return cells, qa


# -- dumps and line lists ----------------------------------------------------------------------


def dump_page_text(spark: SparkSession, path: str, titles: DataFrame) -> DataFrame:
    """``title, text`` of the first revision of the dump's pages with the given titles."""
    dump = spark.read.format("xml").option("rowTag", "page").schema(DUMP_PAGE).load(path)
    return dump.join(titles.select("title").distinct(), "title", "left_semi").select(
        "title", F.get("revision", F.lit(0))["text"].alias("text")
    )


def write_lines(df: DataFrame, path: str) -> None:
    """Write ``idx, text``: one text per line in ``path/lines``, with the numbers in ``path/numbered``."""
    df.select("text").write.mode("overwrite").text(f"{path}/lines")
    df.select("idx", "text").write.mode("overwrite").parquet(f"{path}/numbered")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, text`` as written by ``write_lines``."""
    return spark.read.parquet(f"{path}/numbered")


def read_line_file(spark: SparkSession, path: str) -> DataFrame:
    """``idx, text`` of a plain text file, numbered from 0 in file order."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return dense_number(lines, ["_file", "_start", "_row"], "idx").select("idx", "text")


# -- results and models ------------------------------------------------------------------------


def append_results(results: DataFrame, path: str) -> None:
    """Append result rows to the ``;``-separated result folder."""
    results.select(*RESULTS.names).write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with ``Date`` as a timestamp."""
    rows = spark.read.schema(RESULTS).option("sep", ";").option("header", True).csv(path)
    return rows.withColumn("Date", F.to_timestamp("Date", "yyyy-MM-dd HH:mm:ss"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The model list."""
    return spark.read.schema(MODELS).option("header", True).csv(path)


def export_qa_csv(qa: DataFrame, path: str) -> None:
    """QA rows as CSV with a header."""
    qa.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
