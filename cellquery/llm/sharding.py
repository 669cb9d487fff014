"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring in many places; a document belongs to the first shard clockwise of
its own place. A shard that is full sends what overflows on clockwise. Only counts per ring slot, a
table of fixed size, decide how many rows of each slot stay and how many go on; rows then find
their shard by their number within the slot. All of it is native DataFrame work.

The rows of a slot are numbered in parts, by a hash of id and text, each part from the sum of the
parts before it: an id that many documents have (or none) is no single task's work. Only rows that
agree in id and text stay in one part.

Loads are counted in rows. ``balance`` 1.0 gives counts at most one apart; with more room fewer
rows move when shards are added. A null id has a place like any other; rows are never merged, and
rows with one id stay in one slot. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellquery.llm.scratch import save, unused

#: Slots of the ring; the only thing the driver sees is one count per slot.
RING_SLOTS = 8192
VIRTUAL_NODES = 64
#: Parts of a slot, which are numbered apart.
PARTS = 4096


def place_of(id_col: str, slots: int) -> Column:
    """The ring slot of a document."""
    return F.pmod(F.xxhash64(F.lit("key"), F.col(id_col).cast("string")), F.lit(slots)).cast("int")


def part_of(id_col: str, text_col: str) -> Column:
    """The part of its slot that a document is numbered in."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col(id_col).cast("string"), text_col), F.lit(PARTS)).cast("int")


def ring(spark, shards: int, slots: int, nodes: int) -> list[int]:
    """The shards in clockwise order per slot: for each slot, the number of the first node at or
    after it, and the shard of every node (nodes in ring order)."""
    names = spark.range(shards).crossJoin(spark.range(nodes).withColumnRenamed("id", "node"))
    place = F.pmod(F.xxhash64(F.lit("node"), "id", "node"), F.lit(slots))
    order = F.xxhash64("node", "id")
    rows = names.select("id", place.alias("slot"), order.alias("tie")).collect()
    ordered = sorted((r.slot, r.tie, r.id) for r in rows)
    owners, at = [], 0
    for slot in range(slots):
        while at < len(ordered) and ordered[at][0] < slot:
            at += 1
        owners.append(at % len(ordered))
    return owners, [shard for _, _, shard in ordered]


def capacities(rows: int, shards: int, balance: float) -> list[int]:
    """Rows each shard may hold; they add up to ``balance`` times all rows, rounded up."""
    total = max(rows, math.ceil(rows * balance))
    return [total // shards + (k < total % shards) for k in range(shards)]


def deal(counts: dict[int, int], owners: list[int], nodes: list[int], room: list[int]) -> list[tuple]:
    """``(slot, first, last, shard, offset)``: which rows of each slot go to which shard.

    All slots offer their rows to the node they stand before; a full shard passes the rest to the
    next node of the ring, which is offered to in the next round. Loads don't depend on the order.
    """
    waiting: dict[int, list[list[int]]] = {}
    for slot in sorted(counts):
        waiting.setdefault(owners[slot], []).append([slot, 0, counts[slot]])
    left, filled, dealt = list(room), [0] * len(room), []
    while waiting:
        onward: dict[int, list[list[int]]] = {}
        for node in sorted(waiting):
            shard = nodes[node]
            for slot, first, last in waiting[node]:
                taken = min(last - first, left[shard])
                if taken:
                    dealt.append((slot, first, first + taken, shard, filled[shard] - first))
                    left[shard] -= taken
                    filled[shard] += taken
                if first + taken < last:
                    step = node + 1
                    while not left[nodes[step % len(nodes)]]:
                        step += 1
                    onward.setdefault(step % len(nodes), []).append([slot, first + taken, last])
        waiting = onward
    return dealt


def shard(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    balance: float = 1.05,
    slots: int = RING_SLOTS,
    nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (its number in the shard, gapless from 0); columns
    of these names that ``docs`` has are replaced.

    The first pass counts the rows of each part of each ring slot. The second numbers the rows of
    each part and joins the counts before it, and at most ``slots + shards * nodes`` intervals, a
    proven bound, by broadcast.
    """
    spark = docs.sparkSession
    names = ("place", "part", "before", "slot", "first", "last", "offset", "number")
    own = {n: unused(f"_{n}", docs.columns) for n in names}
    place = place_of(id_col, slots).alias(own["place"])
    part = part_of(id_col, text_col).alias(own["part"])
    keys = [own["place"], own["part"]]
    counted = save(docs.select(place, part).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in counted.groupBy(own["place"]).agg(F.sum("n")).collect()}
    so_far = F.sum("n").over(Window.partitionBy(own["place"]).orderBy(own["part"])) - F.col("n")
    before = counted.select(*keys, so_far.alias(own["before"]))
    owners, ring_nodes = ring(spark, shards, slots, nodes)
    dealt = deal(counts, owners, ring_nodes, capacities(sum(counts.values()), shards, balance))
    kind = f"array<struct<{own['slot']}:int,{own['first']}:bigint,{own['last']}:bigint,shard:int,{own['offset']}:bigint>>"
    fields = (own["slot"], own["first"], own["last"], "shard", own["offset"])
    sent = json.dumps([dict(zip(fields, d)) for d in dealt])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(sent), kind)))
    order = Window.partitionBy(*keys).orderBy(
        F.xxhash64(F.col(id_col).cast("string")), F.col(id_col), F.xxhash64(text_col)
    )
    named = [c for c in docs.columns if c not in ("shard", "slot")]
    within = (F.row_number().over(order) - 1).cast("long")
    numbered = (
        docs.select(*[F.col(f"`{c}`") for c in named], place, part)
        .withColumn(own["number"], within)
        .join(before, keys)
        .withColumn(own["number"], F.col(own["number"]) + F.col(own["before"]))
    )
    number = F.col(own["number"])
    inside = (number >= F.col(own["first"])) & (number < F.col(own["last"]))
    return (
        numbered.join(F.broadcast(table), (F.col(own["place"]) == F.col(own["slot"])) & inside)
        .withColumn("slot", number + F.col(own["offset"]))
        .select(*[F.col(f"`{c}`") for c in named], "shard", "slot")
    )
