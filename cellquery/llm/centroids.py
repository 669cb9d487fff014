"""Centroid clustering with a vantage-point tree over the centroids.

In each round the centroids are put in a vantage-point tree, which is broadcast: a node holds one
centroid and splits the others by their distance to it, near and far halves with their least and
largest distance. A vector keeps the pending nodes by their lower bound and always opens the nearest
one; it ends when that bound is over the distance to its best centroid. Bounds equal to that
distance are still opened, so ties are found, and the smaller centroid number wins. Distances to
centroids are exact integers; only bounds are doubles, widened by their rounding error.

A batch of vectors is worked on together, each vector with its own pending nodes and its own order.
New centroids are ``floor(sum / count)`` of exact sums, added up per task before the shuffle.

Vectors of other than ``size`` components, null ones and those with null or non-finite components take no
part, nor do those whose squared distances could be over a long (components of 2**26 and more).
Repeated ids and equal vectors are separate rows. Rows of one id come in the order of their
components when the first centroids are chosen; a null id comes last. With fewer vectors than ``count``
there are so many centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.llm.scratch import prepare, save

#: Vectors of a batch that are worked on together.
SLICE = 4096
LEAF = 2
LARGEST = float(1 << 26)


class Tree:
    """A vantage-point tree over integer centroids; node 0 is the root."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        #: Per node its centroids (all of a leaf; else the vantage point) and children ``(node, low, high)``.
        self.nodes: list[tuple[list[int], list[tuple[int, float, float]]]] = []
        self._add(list(range(len(centroids))))

    def _add(self, members: list[int]) -> int:
        node = len(self.nodes)
        self.nodes.append((members, []))
        if len(members) <= LEAF:
            return node
        point, *others = members
        away = np.sqrt(((self.centroids[others] - self.centroids[point]) ** 2).sum(axis=1).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = len(order) // 2
        children = []
        for part in (order[:half], order[half:]):
            if len(part):
                children.append((self._add([others[k] for k in part]), float(away[part].min()), float(away[part].max())))
        self.nodes[node] = ([point], children)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller of equally near ones, and its squared distance."""
        count = len(vectors)
        pending = np.full((count, len(self.nodes)), np.inf)
        pending[:, 0] = 0
        best = np.full(count, np.iinfo(np.int64).max)
        chosen = np.full(count, len(self.centroids))
        live = np.arange(count)
        while len(live):
            node = pending[live].argmin(axis=1)
            bound = pending[live, node]
            reach = np.sqrt(best[live].astype(np.float64))
            # Inclusive, and by a margin for the rounding of bound and reach.
            going = np.isfinite(bound) & (bound <= reach * (1 + 1e-9) + 1e-6)
            live, node = live[going], node[going]
            for opened in np.unique(node):
                rows = live[node == opened]
                pending[rows, opened] = np.inf
                held, children = self.nodes[opened]
                for centroid in held:
                    square = ((vectors[rows] - self.centroids[centroid]) ** 2).sum(axis=1)
                    nearer = (square < best[rows]) | ((square == best[rows]) & (centroid < chosen[rows]))
                    best[rows[nearer]], chosen[rows[nearer]] = square[nearer], centroid
                if children:  # ``square`` is the distance to the vantage point
                    away = np.sqrt(square.astype(np.float64))
                    for child, low, high in children:
                        gap = np.maximum(np.maximum(away - high, low - away), 0)
                        pending[rows, child] = np.maximum(gap - 1e-9 * away - 1e-6, 0)
        return chosen, best


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, size: int) -> DataFrame:
    """``id, vector`` of the rows that take part, written out once."""
    prepare(vectors)
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled.alias("scaled"))
    usable = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = rows.filter((F.size("scaled") == size) & usable)
    return save(kept.select("id", F.transform("scaled", lambda x: F.floor(x).cast("int")).alias("vector")))


def first_centroids(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The ``count`` vectors of smallest SHA-256 of ``seed:id``."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(name.alias("name"), "vector").orderBy(F.col("name").asc_nulls_last(), "vector").limit(count)
    return np.array([r.vector for r in first.collect()], np.int64)


def assign(rows: DataFrame, tree: Tree) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    sent, size = rows.sparkSession.sparkContext.broadcast(tree), tree.centroids.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                chosen, square = sent.value.nearest(matrix(part.column("vector"), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(chosen.astype(np.int32)), pa.array(square)], ["id", "cluster", "distance"]
                )

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def moved(rows: DataFrame, tree: Tree) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; empty ones stay.

    A task gives one sum per cluster; the driver gets one row per cluster.
    """
    count, size = tree.centroids.shape
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        sums, counts = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                vectors = matrix(batch.slice(at, SLICE).column("vector"), size)
                chosen, _ = sent.value.nearest(vectors)
                np.add.at(sums, chosen, vectors)
                counts += np.bincount(chosen, minlength=count)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    partial = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(size)]
    centroids = tree.centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        centroids[row["cluster"]] = [int(row[f"s{k}"]) // row["n"] for k in range(size)]
    return centroids


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    size: int = 64,
    count: int = 16,
    rounds: int = 3,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector, and the centroids.

    ``count`` centroids are held by the driver and sent to every task.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vector_col, scale, size)
    centroids = first_centroids(rows, count, seed)
    if not len(centroids):
        kind = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kind), centroids
    for _ in range(rounds):
        centroids = moved(rows, Tree(centroids))
    found = save(assign(rows, Tree(centroids)))
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    per_cluster = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}
    total = sum(per_cluster.values())
    named = spark.createDataFrame(
        [
            (k, inertia, total, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest())
            for k, inertia in per_cluster.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", *named.columns[1:]), centroids
