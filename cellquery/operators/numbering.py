"""Dense numbers over a global order, without pulling the rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellquery.session import materialize

_LOCAL_BITS = 33


def dense_number(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_by`` (which must be unique).

    Rows are range-partitioned and sorted, and each takes its partition and its place there. That
    is written out once, so both passes over it see the same partitions even when executors are
    lost. Partition sizes are then summed up: one row per partition, which is the only thing that
    is ordered in one task and broadcast.
    """
    place = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", place)
        .select(
            "*",
            F.shiftright("_place", _LOCAL_BITS).alias("_part"),
            F.col("_place").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_local"),
        )
        .drop("_place")
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local") + start)
        .drop("_part", "_local", "_offset")
    )


def running_totals(counts: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """``counts`` with ``name``: the sum of ``count`` over all smaller keys (null first).

    Keys are unique. They are range-partitioned; sums run within a partition, and one total per
    partition is added up in one task and broadcast.
    """
    placed = materialize(
        counts.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    )
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = F.sum(count).over(upto.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()))
    before = F.sum("_total").over(upto.orderBy("_part"))
    totals = placed.groupBy("_part").agg(F.sum(count).alias("_total"))
    parts = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_within", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(parts), "_part")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_within", "_before")
    )


def number_by_group(df: DataFrame, group: str, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...``: group after group, in the order of ``order_by`` within.

    For groups that are small (the rows of a page). The rows are written out once and counted per
    group; running totals of the counts are where the groups start. The rows themselves are
    shuffled once, by group, and never sorted as a whole.
    """
    rows = materialize(df)
    counts = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_count"))
    starts = running_totals(counts, "_group", "_count", "_start").drop("_count")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order_by))
    return (
        rows.join(starts, rows[group].eqNullSafe(starts["_group"]))
        .withColumn(name, F.col("_start") + place - 1 + start)
        .drop("_group", "_start")
    )
