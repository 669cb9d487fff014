"""Exact largest inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; sorted by this key, the vectors
of a pivot are rings (annuli) around it. If a query is ``d`` away from a pivot, a vector of a ring
``[low, high]`` is at least ``max(0, d - high, low - d)`` away from the query, by the triangle
inequality, and its inner product is at most ``(|q|^2 + |x|^2 - that^2) / 2``. A query first looks at
the rings that may hold its best rows, and then, by the score it has, goes on outwards to those whose
bound is not below it. No other ring can hold a row of the answer, so it is exact.

Pivots are chosen from a bounded sample; that decides the speed only. Rows are blocks of a
range-sorted table, so a pivot that many vectors share (or one vector repeated any number of times)
is many blocks. Vectors of other lengths count as if filled up with zeros. Null vectors, and those
with null or non-finite components take no part, nor do those whose products would not fit in a long.
Empty and zero vectors do: they score 0. Ties go to the smaller id, a null id last. Repeated ids are
separate rows and separate queries; equal vectors are separate candidates. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellquery.llm import blocks as bl
from cellquery.llm.scratch import save

#: Rows of a ring within a block.
RING = 512
#: Rows per pivot at least, so that small tables are not cut into many small blocks.
PIVOT_ROWS = 1024
_FOUND = "query_key long, query_id long, key long, id long, score long"


def spread(sample: list[list[int]], count: int) -> list[np.ndarray]:
    """``count`` rows of the sample, each the farthest from those before it."""
    width = max(map(len, sample))
    rows = np.array([v + [0] * (width - len(v)) for v in sample], np.float64)
    chosen, near = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return [np.array(sample[c], np.int64).reshape(1, -1) for c in chosen]


class Pivots:
    """Distances to all pivots, and bounds of inner products from them."""

    def __init__(self, rows: list[np.ndarray]):
        self.width = max(r.shape[1] for r in rows)
        self.rows = np.concatenate([np.pad(r, ((0, 0), (0, self.width - r.shape[1]))) for r in rows])
        self.squares = bl.squares(self.rows)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x pivots."""
        inner = bl.product(vectors, self.rows).astype(np.float64)
        square = bl.squares(vectors)[:, None] + self.squares[None, :] - 2 * inner
        return np.sqrt(np.maximum(square, 0))

    def bounds(self, squares, distance, part, low, high, top) -> np.ndarray:
        """The largest inner product that a row of each ring can have: queries x rings.

        Distances are doubles, so each is allowed its rounding error before the bound is taken.
        """
        squares, pivot = squares[:, None], self.squares[part][None, :]
        slack = np.sqrt(1e-14 * (squares + pivot)) + np.sqrt(1e-14 * (top[None, :] + pivot))
        gap = np.maximum(np.maximum(distance[:, part] - high[None, :], low[None, :] - distance[:, part]) - slack, 0)
        most = np.minimum((squares + top - gap**2) / 2, np.sqrt(squares * top))
        return most + 1e-9 * (squares + top) + 1e-6


def largest_products(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    top: int = 10,
    pivots: int = 256,
    sample: int = 4096,
) -> DataFrame:
    """``query_key, query_id, rank, key, id, score`` of the ``top`` rows of largest integer inner product.

    ``is_query`` is a condition on ``id``. ``key`` tells rows of one id apart. Up to ``pivots``
    pivots are chosen from ``sample`` rows.
    """
    spark = vectors.sparkSession
    rows = bl.integer_rows(vectors, id_col, vector_col, scale)
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()
    if not drawn:
        return spark.createDataFrame([], "query_key long, query_id long, rank int, key long, id long, score long")
    chosen = spread([r.vector for r in drawn], min(pivots, -(-rows.count() // PIVOT_ROWS)))
    around = spark.sparkContext.broadcast(Pivots(chosen))

    def keyed(batches):
        for batch in batches:
            for same in bl.by_width(batch):
                distance = around.value.distances(bl.matrix(same.column("vector")))
                nearest = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array(nearest.astype(np.int32)), pa.array(distance.min(axis=1))],
                    ["key", "id", "vector", "pivot", "distance"],
                )

    placed = save(rows.mapInArrow(keyed, "key long, id long, vector array<int>, pivot int, distance double"))
    index = bl.cut(placed, "distance", "pivot")
    known = bl.overview(index)
    queries = rows.filter(is_query(F.col("id")))

    def ceilings(group, blocks):
        vectors = bl.matrix(group.column("vector"))
        distance = around.value.distances(vectors)
        return around.value.bounds(bl.squares(vectors), distance, *(blocks[k] for k in ("part", "low", "high", "top")))

    def home(group, blocks):
        most = ceilings(group, blocks)
        return np.arange(most.shape[1])[None, :] == most.argmax(axis=1)[:, None]

    def beyond(group, blocks):
        most = ceilings(group, blocks)
        least = group.column("least").to_numpy(zero_copy_only=False)
        at_home = np.arange(most.shape[1])[None, :] == most.argmax(axis=1)[:, None]
        return (most >= least[:, None]) & ~at_home

    def score(block, group):
        """The best rows of a block for a group of queries, ring by ring from the likeliest."""
        asked = bl.matrix(group.column("vector"))
        own = group.column("key").to_numpy()
        least = np.full(len(own), -np.inf)
        if "least" in group.schema.names:
            least = group.column("least").to_numpy(zero_copy_only=False).copy()
        starts = np.arange(0, len(block.keys), RING)
        ends = np.minimum(starts + RING, len(block.keys))
        around_rings = (
            np.full(len(starts), block.part),
            block.places[starts],
            block.places[ends - 1],
            np.maximum.reduceat(block.squares, starts),
        )
        most = around.value.bounds(bl.squares(asked), around.value.distances(asked), *around_rings)
        who, where, scores = (np.zeros(0, np.int64) for _ in range(3))
        for ring in np.argsort(-most.mean(axis=0), kind="stable"):
            live = np.flatnonzero(most[:, ring] >= least)
            if not len(live):
                continue
            found = bl.product(asked[live], block.data[starts[ring] : ends[ring]])
            other = own[live][:, None] != block.keys[None, starts[ring] : ends[ring]]
            at_least = least[live].copy()
            if found.shape[1] > top + 1:  # one of them may be the query's own row
                at_least = np.maximum(at_least, np.partition(found, -top - 1, axis=1)[:, -top - 1])
            q, x = np.nonzero(other & (found >= at_least[:, None]))
            who = np.concatenate([who, live[q]])
            where = np.concatenate([where, x + starts[ring]])
            scores = np.concatenate([scores, found[q, x]])
            kept = bl.best(who, scores, block.order[where], top)
            who, where, scores = who[kept], where[kept], scores[kept]
            counts = np.bincount(who, minlength=len(own))
            last = np.flatnonzero(np.r_[who[1:] != who[:-1], True]) if len(who) else np.zeros(0, int)
            full = last[counts[who[last]] >= top]
            least[who[full]] = np.maximum(least[who[full]], scores[full])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own[who], pa.int64()),
                group.column("id").take(pa.array(who)),
                pa.array(block.keys[where], pa.int64()),
                pa.array([block.ids[w] for w in where], pa.int64()),
                pa.array(scores, pa.int64()),
            ],
            ["query_key", "query_id", "key", "id", "score"],
        )

    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    first = save(ranked(bl.meet(index, bl.send(queries, known, home), known, score, _FOUND)))
    # A query with fewer rows than it wants has no bound yet and looks everywhere.
    full = first.filter(F.col("rank") == top).select(F.col("query_key").alias("key"), F.col("score").cast("double").alias("least"))
    asking = save(queries.join(full, "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    more = bl.meet(index, bl.send(asking, known, beyond), known, score, _FOUND)
    both = first.drop("rank").unionByName(more)
    return ranked(both).select("query_key", "query_id", F.col("rank").cast("int").alias("rank"), "key", "id", "score")
