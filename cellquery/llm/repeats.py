"""What the two removers of repeated passages share: copies, candidate texts, and the final rows.

Copies of one content form a class, which is worked on once, as its first document. ``order`` is the
id as a long; a null id comes last. Repeated rows (equal id and content) count as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.llm import words as W
from cellquery.llm.scratch import bitset, finished, may_hold, save

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Bits (as a power of two) of the filter that keeps most texts out of a shuffle.
FILTER_BITS = 24


def order_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))


def settled(
    groups: np.ndarray, owner: np.ndarray, ranks: tuple = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combines the rows of one run before they are shuffled by ``groups`` (hashes, as longs).

    Gives ``key, again, first``: ``again`` marks the rows of groups that have several here, ``first``
    the least of each group by ``ranks``, the main one first (of equals all; without ranks any one).
    Only these go out under their group. What is known of the others needs no one else, so they go out
    under their owner, a class: a frequent group costs its task about one row a run.
    """
    order = np.lexsort((*ranks[::-1], groups))
    opens = np.ones(order.size, bool)
    opens[1:] = groups[order[1:]] != groups[order[:-1]]
    sizes = np.diff(np.append(np.flatnonzero(opens), order.size))
    least = np.repeat(order[opens], sizes)
    again, first = np.empty(groups.size, bool), np.empty(groups.size, bool)
    again[order] = np.repeat(sizes > 1, sizes)
    first[order] = np.logical_and.reduce([r[order] == r[least] for r in ranks]) if ranks else opens
    return np.where(first, groups, owner), again, first


def slim_rows(docs: DataFrame, describe: Callable) -> DataFrame:
    """``id, order, class, n, sha``, written out; ``describe(texts)`` gives the last three columns."""

    def rows(batches):
        for texts in W.runs(batches, "text"):
            marks, sizes, shas = describe(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    W.cell(texts, "id"),
                    W.cell(texts, "order"),
                    pa.array(W.signed(marks), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(shas, pa.string()),
                ],
                ["id", "order", "class", "n", "sha"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return save(docs.mapInArrow(rows, f"id {kind}, order long, class long, n long, sha string"))


def first_texts(docs: DataFrame, chosen: DataFrame, fingerprint: Callable) -> DataFrame:
    """The texts of the chosen classes' first documents, written out.

    ``chosen`` has ``class, first`` and more. A filter of fixed size keeps out nearly all other
    texts before the join; the join on order and class is exact. What it shuffles, about the texts
    themselves, is let go before they are worked on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitset(chosen, "first", FILTER_BITS))

    def passing(batches):
        for batch in batches:
            place = batch.schema.get_field_index("order")
            keep = may_hold(sent.value, batch.column(place).to_numpy())
            kept = batch.filter(pa.array(keep))
            for texts in W.runs([kept], "text"):
                marks = pa.array(W.signed(fingerprint(texts)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [W.cell(texts, "order"), marks, W.cell(texts, "text").cast(pa.string())],
                    ["first", "class", "text"],
                )

    texts = docs.select("order", "text").mapInArrow(passing, "first long, class long, text string")
    return finished(docs.sparkSession, lambda: texts.join(chosen, ["first", "class"]))


def assemble(slim: DataFrame, firsts: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """``id, n, n_removed, starts, ends, sha`` per row.

    ``cut`` holds what was removed per class (from its first document). A later copy of ``least``
    units or more goes as a whole; slim rows only are shuffled.
    """
    once = cut.groupBy("class").agg(
        F.min(F.struct("n_removed", "starts", "ends", "kept")).alias("cut")
    )
    copied = (F.col("order") > F.col("first")) & (F.col("n") >= least)
    none, whole = F.array().cast("array<int>"), F.array(F.lit(0))
    when = lambda gone, kept, rest: (
        F.when(copied, gone).when(F.col("cut").isNotNull(), kept).otherwise(rest)
    )
    return (
        slim.join(firsts, "class")
        .join(once, "class", "left")
        .select(
            "id",
            "n",
            when(F.col("n"), F.col("cut.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
            when(whole, F.col("cut.starts"), none).alias("starts"),
            when(F.array(F.col("n").cast("int")), F.col("cut.ends"), none).alias("ends"),
            when(F.lit(EMPTY_SHA256), F.col("cut.kept"), F.col("sha")).alias("sha"),
        )
    )


def covered(starts: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the windows ``[start, start + width)``, as starts and ends."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, size), -1)
    inside = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    return np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)


def cut_rows(frame: DataFrame, kept: Callable) -> DataFrame:
    """``class, n_removed, starts, ends, kept`` from rows ``class, text, spans...``; ``kept(row)``
    gives removed starts, ends, and the digest of what is left."""

    def rows(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                starts, ends, digest = kept(row)
                if len(starts):
                    total = int((ends - starts).sum())
                    out.append((row["class"], total, starts.tolist(), ends.tolist(), digest))
            many = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int64(), many, many, pa.string()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["class", "n_removed", "starts", "ends", "kept"],
            )

    return frame.mapInArrow(
        rows, "class long, n_removed long, starts array<int>, ends array<int>, kept string"
    )
