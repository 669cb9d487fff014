"""Hard negatives by threshold joins with an inverted index (in the manner of L2AP).

A threshold join finds all rows whose inner product with a query is at least ``t``. Let every row
with ``|x[:p]| * |q| < t`` for all queries leave its first ``p`` dimensions out of the index: a row
that meets the threshold must share an indexed dimension with the query. A task walks the postings of
a block from the last dimensions to the first, accumulates partial products, and drops a pair once its
sum and the norms of what remains of both cannot reach ``t``; what is left is scored exactly.

Every query has windows ``[low, high]`` of scores of which the first ``top`` rows are wanted.
Thresholds start where a bounded sample of rows says that enough rows lie above, and are lowered
for the windows that did not fill, at last to their ``low`` end, so all results are exact. The
sample decides the speed only. Blocks are sorted by label and key, so a label with any share of the
rows is many blocks, and searches within a label visit the blocks that hold it.

Rows with a null label or vector, or null or non-finite components take no part. A null id makes no
anchor; ties go to the smaller id, a null id last. Repeated ids are separate rows and anchors.
Vectors of other lengths count as if filled up with zeros. Vectors whose products would not fit in a
long take no part. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellquery.llm import blocks as bl
from cellquery.llm.scratch import save

#: Parts of the dimensions that are walked between two prunings.
PARTS = 4
#: Rows sampled for the first thresholds.
SAMPLE = 2048
#: Pairs scored at once.
PAIRS = 1 << 16
LOWEST, HIGHEST = -(1 << 62), 1 << 62
_WINDOW = "struct<number:int,low:long,high:long,floor:long>"
_FOUND = "query_key long, number int, key long, id long, score long"


def prefix_norms(rows: np.ndarray) -> np.ndarray:
    """``|x[:p]|`` for ``p = 0 ..`` width: rows x (width + 1)."""
    summed = np.cumsum(rows.astype(np.float64) ** 2, axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(rows), 1)), summed], axis=1))


class Postings:
    """The inverted index of a block for queries with thresholds of at least ``ratio`` times their length.

    Rows stand in the order of their first indexed dimension, so the list of a part of the
    dimensions is the first ``n`` rows; a row's values before its first dimension are not in it.
    """

    def __init__(self, data: np.ndarray, ratio: float):
        norms = prefix_norms(data)
        omitted = (norms * (1 + 1e-9) < ratio).sum(axis=1)
        first = np.maximum(omitted - 1, 0)
        self.rows = np.argsort(first, kind="stable")
        self.first, width = first[self.rows], data.shape[1]
        edges = np.linspace(0, width, min(PARTS, max(width, 1)) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:]))[::-1]
        self.lists, self.left = [], []
        for low, high in self.parts:
            n = int(np.searchsorted(self.first, high))
            values = data[self.rows[:n], low:high].astype(np.float64)
            values[np.arange(low, high)[None, :] < self.first[:n, None]] = 0
            self.lists.append(values)
            place = np.maximum(low, self.first)
            self.left.append((place, norms[self.rows, place]))

    def pairs(self, queries: np.ndarray, least: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and row places of all pairs allowed by ``other`` whose product may reach ``least``."""
        values, norms = queries.astype(np.float64), prefix_norms(queries)
        allowed = other[:, self.rows]
        total = np.zeros(allowed.shape)
        slack = 1e-9 * norms[:, -1]
        for (low, high), listed, (place, rest) in zip(self.parts, self.lists, self.left):
            total[:, : len(listed)] += values[:, low:high] @ listed.T
            reach = total + norms[:, np.minimum(place, norms.shape[1] - 1)] * rest[None, :]
            allowed = allowed & (reach + slack[:, None] * (1 + rest[None, :]) + 1e-6 >= least[:, None])
            if not allowed.any():
                break
        q, x = np.nonzero(allowed)
        return q, self.rows[x]


def exact_scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The products of the pairs; of all at once where most pairs are left."""
    if 4 * len(q) > len(queries) * len(rows):
        return bl.product(queries, rows)[q, x]
    pieces = [np.einsum("ij,ij->i", queries[q[at : at + PAIRS]], rows[x[at : at + PAIRS]]) for at in range(0, len(q), PAIRS)]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


def fill_windows(rows: DataFrame, index: DataFrame, known: dict, asked: DataFrame, same: bool, top: int) -> DataFrame:
    """``query_key, number, key, id, score, rank``: the first ``top`` rows of each window.

    ``asked`` has ``key, id, vector, label, windows``; ``same`` looks among the rows of the query's
    label, else among all others.
    """
    spark = rows.sparkSession
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector", "label").collect()
    widest = max((len(r.vector) for r in drawn), default=0)
    seen = np.array([r.vector + [0] * (widest - len(r.vector)) for r in drawn], np.int64).reshape(len(drawn), widest)
    sample = spark.sparkContext.broadcast((seen, np.array([r.label for r in drawn], np.int64)))
    kind = f"key long, id long, vector array<int>, label long, windows array<{_WINDOW}>"
    arrow_windows = pa.list_(pa.struct([("number", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("floor", pa.int64())]))

    def lowered(rank: int):
        """Each window's threshold: its sampled score of this rank, or its lower end."""

        def run(batches):
            vectors, labels = sample.value
            for batch in batches:
                for part in bl.by_width(batch):
                    for at in range(0, part.num_rows, bl.GROUP):
                        group = part.slice(at, bl.GROUP)
                        scores = bl.product(bl.matrix(group.column("vector")), vectors)
                        mine = group.column("label").to_numpy()
                        made = []
                        for row, windows in enumerate(group.column("windows").to_pylist()):
                            near = np.sort(scores[row][(labels == mine[row]) == same])[::-1]
                            for w in windows:
                                start = int(np.searchsorted(-near, -w["high"]))
                                floor = int(near[start + rank - 1]) if start + rank <= len(near) else w["low"]
                                w["floor"] = max(floor, w["low"])
                            made.append(windows)
                        yield pa.RecordBatch.from_arrays(
                            [*(group.column(c) for c in ("key", "id", "vector", "label")), pa.array(made, arrow_windows)],
                            ["key", "id", "vector", "label", "windows"],
                        )

        return run

    def wanted(group, blocks):
        label = group.column("label").to_numpy()[:, None].astype(float)
        if same:
            return (blocks["low"][None, :] <= label) & (label <= blocks["high"][None, :])
        least = np.array([min(w["floor"] for w in windows) for windows in group.column("windows").to_pylist()])
        reach = np.sqrt(bl.squares(bl.matrix(group.column("vector"))))[:, None] * np.sqrt(blocks["top"])[None, :]
        only = (blocks["low"] == blocks["high"])[None, :] & (blocks["low"][None, :] == label) & (np.abs(label) < bl.EXACT)
        return ~only & (reach * (1 + 1e-9) + 1e-6 >= least[:, None])

    def score_at(ratio: float):
        def score(block, group):
            if getattr(block, "postings", None) is None:
                block.postings = Postings(block.data, ratio)
            queries = bl.fit(bl.matrix(group.column("vector")), block.data.shape[1])
            keys, label = group.column("key").to_numpy(), group.column("label").to_numpy()
            windows = group.column("windows").to_pylist()
            least = np.array([min(w["floor"] for w in ws) for ws in windows], np.float64)
            other = ((label[:, None] == block.places[None, :]) == same) & (keys[:, None] != block.keys[None, :])
            q, x = block.postings.pairs(queries, least, other)
            scores = exact_scores(queries, block.data, q, x)
            parts = []
            for place in range(max(map(len, windows))):
                held = [ws[place] if place < len(ws) else {"number": -1, "floor": 1, "high": 0} for ws in windows]
                floor, high, number = (np.array([w[k] for w in held], np.int64) for k in ("floor", "high", "number"))
                inside = np.flatnonzero((scores >= floor[q]) & (scores <= high[q]))
                kept = inside[bl.best(q[inside], scores[inside], block.order[x[inside]], top)]
                parts.append((keys[q[kept]], number[q[kept]], x[kept], scores[kept]))
            query, number, x, scores = (np.concatenate([p[k] for p in parts]) for k in range(4))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(query, pa.int64()),
                    pa.array(number.astype(np.int32)),
                    pa.array(block.keys[x], pa.int64()),
                    pa.array([block.ids[k] for k in x], pa.int64()),
                    pa.array(scores, pa.int64()),
                ],
                ["query_key", "number", "key", "id", "score"],
            )

        return score

    order = Window.partitionBy("query_key", "number").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    rank = -(-2 * top * len(drawn) // max(total, 1)) + 1
    done = []
    while True:
        asking = save(asked.mapInArrow(lowered(rank), kind))
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
        floor = F.array_min(F.transform("windows", lambda w: w["floor"])).cast("double")
        lowest = asking.agg(F.min(F.when(length > 0, floor / length).otherwise(0.0))).first()[0]
        if lowest is None:  # nobody asks any more
            break
        found = bl.meet(index, bl.send(asking, known, wanted), known, score_at(lowest), _FOUND)
        ranked = save(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        done.append(ranked)
        counts = ranked.groupBy(F.col("query_key").alias("key"), "number").agg(F.count("*").alias("n"))
        windows = asking.select("key", F.explode("windows").alias("w")).select("key", "w", F.col("w.number").alias("number"))
        short = windows.join(counts, ["key", "number"], "left").filter(
            (F.coalesce("n", F.lit(0)) < top) & (F.col("w.floor") > F.col("w.low"))
        )
        again = short.groupBy("key").agg(F.sort_array(F.collect_list("w")).alias("windows"))
        asked = save(asking.drop("windows").join(again, "key").select("key", "id", "vector", "label", "windows"))
        done[-1] = ranked.join(short.select(F.col("key").alias("query_key"), "number"), ["query_key", "number"], "left_anti")
        rank = 8 * rank
    if not done:
        return spark.createDataFrame([], _FOUND + ", rank int")
    return save(reduce(DataFrame.unionByName, done))


def hard_negatives(
    vectors: DataFrame,
    is_anchor,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """``anchor_key, anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are the ``positives`` other rows of its label with the highest integer
    inner products; for each, the ``negatives`` best rows of other labels whose score is from
    ``low_percent`` to ``high_percent`` of the positive's (none if that score is negative).
    ``is_anchor`` is a condition on ``id``.
    """
    rows = bl.integer_rows(vectors, id_col, vector_col, scale, label=label.cast("long"))
    rows = rows.filter(F.col("label").isNotNull())
    index = bl.cut(rows, "label")
    known = bl.overview(index)
    anchors = rows.filter(is_anchor(F.col("id")))
    window = lambda number, low, high: F.struct(
        number.cast("int").alias("number"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(None).cast("long").alias("floor")
    )
    every = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST))))
    found = fill_windows(rows, index, known, every, True, positives)
    score = F.col("score").cast("decimal(20,0)")
    low = F.ceil(score * low_percent / 100)
    high = F.floor(score * high_percent / 100)
    windows = found.filter(low <= high).groupBy(F.col("query_key").alias("key")).agg(
        F.sort_array(F.collect_list(window(F.col("rank"), low, high))).alias("windows")
    )
    mined = fill_windows(rows, index, known, anchors.join(windows, "key"), False, negatives)
    pairs = found.select(
        "query_key", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    names = anchors.select(F.col("key").alias("query_key"), F.col("id").alias("anchor_id"))
    return mined.join(pairs, ["query_key", "number"]).join(names, "query_key").select(
        F.col("query_key").alias("anchor_key"),
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
