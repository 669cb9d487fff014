"""Intermediate tables, and small fixed-size arrays summed over all partitions."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquery.session import scratch

#: Arrow batches stay below this size whatever the length of the texts.
BATCH_BYTES = 16 << 20


def prepare(df: DataFrame) -> None:
    """Bound the Arrow batches of this session by bytes (long texts), not only by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    It cuts lineage, survives lost executors, and gives every later pass the same rows. The folder
    is deleted when the application ends, or when the work it was saved for is ``finished``.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if _saved:
        _saved[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether shuffle files go with the query that wrote them.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables saved within each ``finished`` that is under way, the innermost last.
_saved: list[list[str]] = []


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written out; what was saved on the way to it is deleted.

    Spark lets go of what the writing shuffled as soon as it ends. Shuffle files of earlier jobs go when
    nothing refers to these any more, which the driver only notices when it collects garbage, so it is
    asked to.
    """
    _saved.append([])
    try:
        result = build()
    except BaseException:
        _saved.pop()
        raise
    passed = _saved.pop()
    before = spark.conf.get(_LET_GO, "false")
    spark.conf.set(_LET_GO, "true")
    try:
        kept = save(result)
    finally:
        spark.conf.set(_LET_GO, before)
    del result
    for path in passed:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()
    return kept


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes, for one cell of a table."""
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)


def tree_combine(
    df: DataFrame, column: str, dtype, combine: Callable, zero: np.ndarray
) -> np.ndarray:
    """All packed arrays of ``column`` combined, in a tree on the executors.

    Each array has the fixed size of ``zero``, so what the driver gets does not grow with the data.
    """

    def fold(rows: Iterator) -> Iterator[bytes]:
        total = None
        for row in rows:
            part = unpack(row[0], dtype)
            total = part.copy() if total is None else combine(total, part)
        if total is not None:
            yield pack(total)

    def join(a: bytes, b: bytes) -> bytes:
        return pack(combine(unpack(a, dtype), unpack(b, dtype)))

    parts = df.filter(df[column].isNotNull()).select(column).rdd.mapPartitions(fold)
    if parts.getNumPartitions() == 0:
        return zero.copy()
    found = parts.map(lambda x: (True, x)).treeReduce(
        lambda a, b: a if not b[0] else b if not a[0] else (True, join(a[1], b[1])), 2
    ) if not parts.isEmpty() else None
    return unpack(found[1], dtype).copy() if found else zero.copy()


def bitset(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of the longs in ``column`` as ``2**bits`` bits (a filter: it may hold too many, never too few).

    Its size is fixed. A full filter lets everything pass, which only costs time, since an exact
    join follows each use.
    """
    import pyarrow as pa

    size = 1 << bits

    def mark(batches):
        seen = None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if seen is None:
                seen = np.zeros(size >> 3, np.uint8)
            at = slots(keys, bits)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(seen)], pa.binary())], ["blob"])

    blobs = df.filter(df[column].isNotNull()).select(column).mapInArrow(mark, "blob binary")
    return tree_combine(blobs, "blob", np.uint8, np.bitwise_or, np.zeros(size >> 3, np.uint8))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each long."""
    mixed = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def may_hold(bits_set: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which longs the filter may hold."""
    bits = int(bits_set.size).bit_length() - 1 + 3
    at = slots(keys, bits)
    return (bits_set[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit name of a document, from its id and text; both may be null."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))


def without(docs: DataFrame, key: Column, gone: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose key is not in the only column of ``gone``.

    Rows that a filter of fixed size rules out stay where they are; only the others are shuffled to
    the exact anti-join. What is gone grows with the documents, so it is never broadcast.
    """
    import pyarrow as pa

    prepare(docs)
    named = unused("_key", docs.columns)
    gone = gone.select(F.col(gone.columns[0]).alias(named))
    sent = docs.sparkSession.sparkContext.broadcast(bitset(gone, named, bits))
    keyed = docs.withColumn(named, key)
    place = len(docs.columns)

    def part(wanted):
        def rows(batches):
            for batch in batches:
                held = may_hold(sent.value, batch.column(place).to_numpy())
                yield batch.filter(pa.array(held == wanted))

        return keyed.mapInArrow(rows, keyed.schema)

    return part(False).unionByName(part(True).join(gone.hint("merge"), named, "left_anti")).drop(named)
