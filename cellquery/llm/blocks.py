"""Integer vectors in blocks, and groups of queries sent to the blocks they need.

An index is a table with one row per block of sorted vectors: so many rows or bytes at most, all of
one length. What a search needs to know of every block (a few numbers) is broadcast; there are
``MOST_BLOCKS`` of them at most (and one more per task and part that writes them), as blocks grow
beyond that. Queries travel in groups, one row per group and block; a task holds one block and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.llm.scratch import prepare, save

BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 100_000
#: Queries that travel together.
GROUP = 256
#: Tasks that blocks are dealt to, at most.
MOST_TASKS = 20_000
#: Squared lengths stay below this, so that every inner product fits in a long.
LARGEST = float(1 << 62)
#: Below this, doubles hold integer inner products exactly.
EXACT = float(1 << 52)

_BLOCK = (
    "block long, part int, width int, low double, high double, top double, "
    "ids array<long>, keys binary, places binary, whole boolean, data binary"
)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, **more: Column) -> DataFrame:
    """``key, id, vector`` (each component ``floor(scale * x)``) and ``more``, written out once.

    ``key`` names the row. Null vectors and those with null or non-finite components take no part,
    nor do vectors so long that their products would not fit in a long (2**31 and more).
    """
    prepare(vectors)
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled.alias("scaled"), *[c.alias(n) for n, c in more.items()])
    finite = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    squares = F.aggregate("scaled", F.lit(0.0), lambda s, x: s + F.floor(x).cast("double") * F.floor(x).cast("double"))
    kept = rows.filter(finite & (squares < LARGEST))
    whole = F.transform("scaled", lambda x: F.floor(x).cast("int"))
    return save(kept.select(F.monotonically_increasing_id().alias("key"), "id", whole.alias("vector"), *more))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), flat.size // max(len(column), 1))


def fit(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled up with zeros to ``width``, which leaves products with such vectors as they are."""
    rows = rows[:, :width]
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows).astype(np.float64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact, over the components that both have."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.sqrt(squares(a).max(initial=0) * squares(b).max(initial=0))
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def by_width(batch: pa.RecordBatch, column: str = "vector") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, those of one vector length at a time."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def cut(rows: DataFrame, place: str, part: str | None = None) -> DataFrame:
    """The index: ``rows`` sorted by vector length, ``part`` and ``place`` (a long or a double) and cut into blocks.

    Ties are broken by the row's key, so equal rows in any number spread over blocks and tasks.
    ``low`` and ``high`` are a block's first and last place, ``top`` its largest squared length.
    """
    part_of = F.col(part).cast("int") if part else F.lit(0)
    sorted_rows = rows.select(
        F.size("vector").alias("width"), part_of.alias("part"), F.col(place).alias("place"), "key", "id", "vector"
    )
    order = ["width", "part", "place", "key"]
    dealt = sorted_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    wanted = max(BLOCK_ROWS, -(-rows.count() // MOST_BLOCKS))

    def flush(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        places = table["place"].to_numpy()
        data = matrix(table["vector"].combine_chunks())
        row = {
            "block": (TaskContext.get().partitionId() << 32) + number,
            "part": table["part"][0].as_py(),
            "width": data.shape[1],
            "low": float(places[0]),
            "high": float(places[-1]),
            "top": squares(data).max(initial=0),
            "ids": table["id"].to_pylist(),
            "keys": table["key"].to_numpy().tobytes(),
            "places": places.tobytes(),
            "whole": places.dtype == np.int64,
            "data": data.astype(np.int32).tobytes(),
        }
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def run(batches):
        held, current, count, number = [], None, 0, 0
        for batch in batches:
            marks = np.stack([batch.column("width").to_numpy(), batch.column("part").to_numpy()], axis=1)
            at = 0
            while at < batch.num_rows:
                mark = tuple(marks[at])
                same = np.flatnonzero((marks[at:] != marks[at]).any(axis=1))
                end = at + int(same[0]) if len(same) else batch.num_rows
                limit = max(1, min(wanted, max(BLOCK_BYTES, 256 * wanted) // (4 * max(int(mark[0]), 1))))
                if held and (mark != current or count >= limit):
                    yield flush(held, number)
                    held, count, number = [], 0, number + 1
                taken = min(end - at, limit - count)
                held.append(batch.slice(at, taken))
                current, count, at = mark, count + taken, at + taken
        if held:
            yield flush(held, number)

    return save(dealt.mapInArrow(run, _BLOCK))


class Block:
    """One block in a task, with an order of its ids for ties: by id, null last, then by key."""

    def __init__(self, row: dict):
        self.number, self.part = row["block"], row["part"]
        self.ids = row["ids"]
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.places = np.frombuffer(row["places"], np.int64 if row["whole"] else np.float64)
        self.data = np.frombuffer(row["data"], np.int32).astype(np.int64).reshape(len(self.keys), row["width"])
        self.squares = squares(self.data)
        no_id = np.array([i is None for i in self.ids])
        order = np.lexsort((self.keys, [0 if i is None else i for i in self.ids], no_id))
        self.order = np.empty(len(order), np.int64)
        self.order[order] = np.arange(len(order))


def overview(blocks: DataFrame) -> dict[str, np.ndarray]:
    """What every search knows of all blocks: a few numbers each."""
    rows = blocks.select("block", "part", "width", "low", "high", "top").orderBy("block").collect()
    kinds = {"block": np.int64, "part": np.int64, "width": np.int64, "low": float, "high": float, "top": float}
    return {name: np.array([r[name] for r in rows], kind) for name, kind in kinds.items()}


def send(queries: DataFrame, known: dict[str, np.ndarray], wanted: Callable) -> DataFrame:
    """``block, asked``: groups of queries (as Arrow bytes) for each block that one of them wants.

    ``wanted(group, known)`` says which query wants which block.
    """
    sent = queries.sparkSession.sparkContext.broadcast(known)
    fields = queries.columns

    def run(batches):
        blocks = sent.value
        step = max(1, min(GROUP, 4_000_000 // max(len(blocks["block"]), 1)))
        for batch in batches:
            for same in by_width(batch.rename_columns(fields)):
                for at in range(0, same.num_rows, step):
                    group = same.slice(at, step)
                    need = wanted(group, blocks)
                    for b in np.flatnonzero(need.any(axis=0)):
                        asked = group.take(pa.array(np.flatnonzero(need[:, b])))
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, asked.schema) as out:
                            out.write_batch(asked)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([blocks["block"][b]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                            ["block", "asked"],
                        )

    groups = max(1, -(-queries.count() // (4 * GROUP)))
    return queries.repartition(groups, "key").mapInArrow(run, "block long, asked binary")


def meet(blocks: DataFrame, asked: DataFrame, known: dict[str, np.ndarray], score: Callable, kind: str) -> DataFrame:
    """``score(block, group)`` for every group and block; each block is loaded once per task."""
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema.fields}
    rest = [f for f in blocks.columns if f != "block"]
    rows = blocks.select("block", F.lit(0).alias("kind"), *rest, F.lit(None).cast("binary").alias("asked")).union(
        asked.select("block", F.lit(1), *[none[f] for f in rest], "asked")
    )
    tasks = max(1, min(3 * len(known["block"]), MOST_TASKS))
    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "kind")

    def run(batches):
        block = None
        for batch in batches:
            for row in (batch.slice(at, 1) for at in range(batch.num_rows)):
                if row.column("kind")[0].as_py() == 0:
                    block = Block(row.to_pylist()[0])
                    continue
                with pa.ipc.open_stream(row.column("asked")[0].as_buffer()) as stream:
                    group = stream.read_next_batch()
                found = score(block, group)
                if found is not None and found.num_rows:
                    yield found

    return dealt.mapInArrow(run, kind)


def best(rows: np.ndarray, scores: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of each row: by score, then by ``order``; sorted by row and rank."""
    at = np.lexsort((order, -scores, rows))
    sorted_rows = rows[at]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(at) else np.array([], int)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return at[rank < top]
