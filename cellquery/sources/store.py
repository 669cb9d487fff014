"""Stored tables and QA rows: versions of immutable rows under a commit log (``log.Log``).

Nothing stored is rewritten, so a job may replace the data it reads. Beside the cells of a write lies
the list of its tables (``table_id, header, n_rows, n_cols``); which tables a later version has replaced
is found from these lists alone. ``compact`` makes one version of all.

Numbered QA rows are stored with their place in their own write. Where they start is decided when
the version is taken, from the count the last one has left, so numbers are dense over any number
of writers, and a batch that is written again finds its entry and is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquery.operators.questions import question_id, question_number
from cellquery.operators.tables import normalize_headers
from cellquery.sources.log import Log, new_name

# -- QA rows -----------------------------------------------------------------------------------


def _after(last: dict, entry: dict, count: int = 0, **more) -> dict:
    """The entry that follows ``last``: ``next`` is the number that the next question gets."""
    return {**entry, "next": last.get("next", 0) + count, "batch": last.get("batch"), **more}


def _put(log: Log, rows: DataFrame, part: str = "") -> dict:
    """Write rows into a new data folder."""
    entry = {"name": new_name()}
    rows.write.parquet(log.folder(entry, part))
    return entry


def _rows(log: Log, entry: dict, part: str = "") -> DataFrame:
    return log.spark.read.parquet(log.folder(entry, part))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_qa(qa: DataFrame, path: str) -> int:
    """Overwrite the QA table. Numbers go on after its count, or its highest number."""
    spark = qa.sparkSession
    log = Log(spark, path)
    entry = _put(log, qa)
    number = question_number(F.col("id")) if "id" in qa.columns else F.lit(None).cast("bigint")
    found = spark.read.parquet(log.folder(entry)).agg(F.count("*").alias("n"), F.max(number).alias("m")).first()
    after = max(found.n, -1 if found.m is None else found.m + 1)
    return log.commit(lambda last: _after(last, entry, base=True, next=after))


def append_qa(qa: DataFrame, path: str) -> int:
    """Add rows with ids of their own; only the new rows are written."""
    log = Log(qa.sparkSession, path)
    entry = _put(log, qa)
    count = qa.sparkSession.read.parquet(log.folder(entry)).count()
    return log.commit(lambda last: _after(last, entry, count))


def append_numbered_qa(qa: DataFrame, path: str, batch: int | None = None) -> int:
    """Add rows ``nt-0, nt-1, ...``, numbered on from what is stored.

    ``batch`` counts the writes of a stream: one that is already in the store is not added again.
    """
    log = Log(qa.sparkSession, path)
    taken = lambda last: batch is not None and last.get("batch") is not None and last["batch"] >= batch
    number, last = log.last()
    if taken(last):
        return number
    entry = _put(log, qa.withColumn("id", question_number(F.col("id"))).withColumnRenamed("id", "n"))
    count = qa.sparkSession.read.parquet(log.folder(entry)).count()

    def make(last: dict) -> dict | None:
        if taken(last):
            return None
        made = _after(last, entry, count, start=last.get("next", 0))
        return made if batch is None else {**made, "batch": batch}

    return log.commit(make)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """The QA table."""
    log = Log(spark, path)
    parts = []
    for _, entry in log.live():
        rows = _rows(log, entry)
        if "start" in entry:
            rest = [c for c in rows.columns if c != "n"]
            rows = rows.select(question_id(F.col("n") + entry["start"]).alias("id"), *rest)
        parts.append(rows)
    return _together(parts)


def compact_qa(spark: SparkSession, path: str) -> int:
    """One version of all QA rows; fails if somebody has added to them meanwhile."""
    log = Log(spark, path)
    number, _ = log.last()
    entry = _put(log, read_qa(spark, path))
    return log.commit(lambda last: _after(last, entry, base=True), number)


# -- tables ------------------------------------------------------------------------------------


def _described(cells: DataFrame) -> DataFrame:
    """The tables that cells belong to."""
    name = F.when(F.col("row_idx") == 0, F.struct("col_idx", "col_name"))
    return cells.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_set(name)), lambda c: c["col_name"]).alias("header"),
        (F.max("row_idx") + 1).cast("bigint").alias("n_rows"),
        (F.max("col_idx") + 1).cast("bigint").alias("n_cols"),
    )


def save_cells(cells: DataFrame, path: str, mode: str = "replace", tables: DataFrame | None = None) -> int:
    """Store tables by ``table_id``: ``replace`` takes the place of same-named ones, ``append`` adds rows.

    ``tables`` (``table_id, header, n_rows, n_cols``) also names those without rows; without it they are
    found from the cells. Files are laid out by table and row, so reading one table touches few
    of them and a huge table is many files.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode: {mode}")
    log = Log(cells.sparkSession, path)
    laid_out = cells.withColumn("col_name", normalize_headers(F.col("col_name"))).repartitionByRange(
        "table_id", "row_idx"
    ).sortWithinPartitions("table_id", "row_idx", "col_idx")
    entry = _put(log, laid_out, "cells")
    if tables is None:
        listed = _described(_rows(log, entry, "cells"))
    else:
        listed = tables.select("table_id", F.transform("header", normalize_headers).alias("header"), "n_rows", "n_cols")
    listed.write.parquet(log.folder(entry, "tables"))
    return log.commit(lambda _: {**entry, "mode": mode})


def _replaced(log: Log, live: list[tuple[int, dict]]) -> tuple[DataFrame, DataFrame]:
    """All listed tables with their ``_version``, and those a later version has replaced."""
    listed = _together([_rows(log, e, "tables").withColumn("_version", F.lit(v)) for v, e in live])
    replacing = [v for v, e in live if e["mode"] == "replace"]
    since = listed.filter(F.col("_version").isin(replacing)).groupBy("table_id").agg(F.max("_version").alias("_since"))
    gone = listed.join(since, "table_id").filter(F.col("_version") < F.col("_since")).select("table_id", "_version")
    return listed, gone


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the stored tables.

    Versions of which nothing was replaced are read as they are; the others leave out the replaced
    tables by an anti-join on the table lists. No cell is grouped.
    """
    log = Log(spark, path)
    live = log.live()
    parts = {v: _rows(log, e, "cells") for v, e in live}
    if len(live) > 1:
        _, gone = _replaced(log, live)
        for version in {r["_version"] for r in gone.select("_version").distinct().collect()}:
            names = gone.filter(F.col("_version") == version).select("table_id")
            parts[version] = parts[version].join(names, "table_id", "left_anti")
    return _together(list(parts.values()))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """``table_id, header, n_rows, n_cols`` of the stored tables, also of those without rows."""
    log = Log(spark, path)
    listed, gone = _replaced(log, log.live())
    kept = listed.join(gone, ["table_id", "_version"], "left_anti")
    return kept.groupBy("table_id").agg(
        F.min_by("header", "_version").alias("header"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols")
    )


def compact_cells(spark: SparkSession, path: str) -> int:
    """One version of all stored tables; fails if somebody has written meanwhile."""
    log = Log(spark, path)
    number, _ = log.last()
    order = ["table_id", "row_idx"]
    cells = read_cells(spark, path).repartitionByRange(*order).sortWithinPartitions(*order, "col_idx")
    entry = _put(log, cells, "cells")
    read_tables(spark, path).write.parquet(log.folder(entry, "tables"))
    return log.commit(lambda _: {**entry, "mode": "replace", "base": True}, number)


# -- numbers -----------------------------------------------------------------------------------


def first_number(spark: SparkSession, path: str, batch: int) -> int:
    """Where the numbers of a stream's batch start: as noted before if it is run again, else after the last."""
    _, last = Log(spark, path).last()
    return last["start"] if last.get("batch") == batch else last.get("next", 0)


def note_numbers(spark: SparkSession, path: str, batch: int, count: int) -> None:
    """Note that a batch has taken ``count`` numbers; nothing if it is noted already."""

    def make(last: dict) -> dict | None:
        if last.get("batch") == batch:
            return None
        start = last.get("next", 0)
        return {"batch": batch, "start": start, "next": start + count}

    Log(spark, path).commit(make)
