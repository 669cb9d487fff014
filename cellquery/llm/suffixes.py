"""Removing repeated byte strings with a sparse, distributed suffix array.

Sorting the suffixes of every byte would move dozens of times the text. Instead the suffixes sorted
are those at anchors: in each ``width`` bytes, the place whose leading bytes hash lowest. Equal
strings have their anchor at the same place, so nothing is missed. Splitters sampled from the data
range-partition the suffixes by their leading bytes; each bucket sorts its suffixes, which leaves those
whose leading text another content shares. These are dealt and sorted again with the bytes around
them, and all strings around one leading text are compared, across batch boundaries too, with the
first document that has them. A task holds a bounded number of these strings; new ones beyond it leave
the task as hashes, and their first document is found by a shuffle.

Bytes are UTF-8; null is empty; nothing is compared across documents; strings of one document never
count against it. Texts shorter than ``width`` lose nothing. Copies and repeated rows: see
``repeats``. Texts are copies if the first 64 bits of their SHA-256 are equal; equality of long
strings is equality of 64-bit hashes within one leading text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.llm import repeats
from cellquery.llm import words as W
from cellquery.llm.scratch import finished, prepare, save

#: Leading bytes of a suffix, which decide on its anchor.
LEAD = 16
#: Texts from which splitters are sampled, and leading texts taken of each.
SAMPLE_TEXTS = 2_000
SAMPLE_LEADS = 50
#: Records that are compared at once within one leading text.
BLOCK = 20_000
#: Strings around one leading text that a task holds; it stops taking more in above this.
HELD = 1_000_000
#: Places of a text that are hashed at once, so that the arrays stay in the processor's cache.
PIECE = 1 << 14
#: Suffixes or records that leave a Python step at once.
SENT = 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def digests(texts: W.Texts) -> list:
    data = memoryview(texts.data)
    return [hashlib.sha256(data[a:b]) for a, b in zip(texts.starts, texts.ends)]


def named(found: list) -> np.ndarray:
    """The first 64 bits of each SHA-256, the name of a class."""
    return np.frombuffer(b"".join(d.digest()[:8] for d in found), np.uint64)


def fingerprint(texts: W.Texts) -> np.ndarray:
    return named(digests(texts))


def describe(texts: W.Texts):
    found = digests(texts)
    return named(found), texts.ends - texts.starts, [d.hexdigest() for d in found]


def leads(data: np.ndarray) -> np.ndarray:
    """For every place with ``LEAD`` bytes after it the first eight, as a number that sorts like the bytes."""
    return W.eights(data)[: max(data.size - LEAD + 1, 0)].byteswap()


def lowest(eight: np.ndarray, count: int) -> np.ndarray:
    """For each run of ``count`` neighbours the place whose ``LEAD`` bytes hash lowest, the leftmost of equals.

    ``eight`` has the eight bytes from each place on. A place shares a number with the upper bits of
    its hash, which are enough to choose by.
    """
    total = eight.size - LEAD - count + 1
    bits = (PIECE + count).bit_length()
    below = np.uint32((1 << bits) - 1)
    places = np.arange(PIECE + count, dtype=np.uint32)
    out = np.empty(total, np.int32)
    for start in range(0, total, PIECE):
        end = min(start + PIECE, total)
        part = eight[start : end + count + 7].copy()
        hashed = part[:-8] * _LEFT
        hashed += part[8:] * _RIGHT
        low = (hashed >> np.uint64(32)).astype(np.uint32)
        low &= ~below
        low |= places[: low.size]
        reach = 1
        while reach * 2 <= count:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < count:
            low = np.minimum(low[: low.size - (count - reach)], low[count - reach :])
        low &= below
        np.add(low, start, out=out[start:end], casting="unsafe")
    return out


def anchored(texts: W.Texts, width: int):
    """``owner, anchor, first, last, lead, hash`` of all anchors: byte places of the run, the first eight
    bytes of the leading text as a number that sorts like them, and a hash of all its bytes.

    The strings of ``width`` bytes that start at ``first`` to ``last`` are those around the anchor.
    """
    if texts.data.size < width:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    eight = W.eights(texts.data)
    at = lowest(eight, width - LEAD + 1)
    sizes = texts.ends - texts.starts
    room = np.maximum(sizes - width + 1, 0)
    inside = np.repeat(np.tile([True, False], sizes.size), np.stack([room, sizes - room], 1).ravel())[: at.size]
    other = at[1:] != at[:-1]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= other | ~inside[:-1]
    closes[:-1] &= other | ~inside[1:]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
    owner, anchor = np.searchsorted(texts.ends, begin, "right"), at[begin].astype(np.int64)
    lead = eight[anchor]
    return owner, anchor, begin, end, lead.byteswap(), W.mix(W.mix(lead) + eight[anchor + 8])


def splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """``buckets - 1`` leading texts that deal out the suffixes evenly, from a bounded sample."""

    def some(batches):
        for texts in W.runs(batches, "text"):
            if texts.data.size > LEAD:
                eight = leads(texts.data)
                step = max(1, eight.size // (SAMPLE_LEADS * len(texts.starts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(eight[::step] ^ np.uint64(1 << 63)), pa.int64())], ["lead"]
                )

    # a bounded sample, spread over all files: the texts with the smallest hashes
    spread = docs.select("text", F.xxhash64("order").alias("_h")).filter("length(text) > 16")
    total = docs.count()
    share = min(1.0, 2 * SAMPLE_TEXTS / max(total, 1))
    bound = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    sample = spread.filter(F.col("_h") <= bound).limit(SAMPLE_TEXTS).select("text")
    found = np.array([r[0] for r in sample.mapInArrow(some, "lead long").collect()], np.int64)
    found = np.sort(found)
    if not found.size:
        return found
    return np.unique(found[np.arange(1, buckets) * found.size // buckets])


def ordered(eight: np.ndarray) -> np.ndarray:
    return W.signed(eight ^ np.uint64(1 << 63))


def suffixes(docs: DataFrame, width: int, split_at) -> DataFrame:
    """``bucket, hash, class, place`` of all anchor suffixes, once per class and task.

    ``place`` is ``-1 - place`` if another class of the same run has the leading text too (see
    ``repeats.settled``). Rows that need not meet others of their leading text are dealt to any bucket.
    """
    buckets = len(split_at.value) + 1

    def rows(batches):
        seen: set[int] = set()
        for texts in W.runs(batches, "text"):
            owner, anchor, _, _, lead, hashed = anchored(texts, width)
            marks = W.signed(fingerprint(texts))
            fresh = np.array([m not in seen and not seen.add(m) for m in marks.tolist()], bool)
            keep = fresh[owner]
            owner, anchor, lead, hashed = owner[keep], anchor[keep], lead[keep], hashed[keep]
            if anchor.size:
                place, mark = anchor - texts.starts[owner], marks[owner]
                key, again, first = by_class(W.signed(hashed), mark)
                bucket = np.searchsorted(split_at.value, ordered(lead), "right")
                bucket = np.where(first, bucket, (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)),
                        pa.array(key, pa.int64()),
                        pa.array(mark, pa.int64()),
                        pa.array(np.where(again, -1 - place, place).astype(np.int32)),
                    ],
                    ["bucket", "hash", "class", "place"],
                )

    return docs.select("text").mapInArrow(
        rows, "bucket int, hash long, class long, place int"
    )


def by_class(groups: np.ndarray, mark: np.ndarray):
    """``settled`` for groups that count as repeated only if two classes have them."""
    key, again, first = repeats.settled(groups, mark, (mark,))
    if not again.any():
        return key, again, first
    # all rows of the least class are firsts; a group of firsts only is of one class
    values, inverse = np.unique(groups[again], return_inverse=True)
    two = np.zeros(values.size, bool)
    two[inverse[~first[again]]] = True
    again[again] = two[inverse]
    return key, again, first


def shared(found: DataFrame, buckets: int) -> DataFrame:
    """``class, places``: suffixes whose leading text another class has too.

    Rows are dealt by range bucket and sorted there; equal leading texts then stand together.
    """

    def rows(batches):
        state, held, count = {}, [], 0
        for batch in batches:
            held.append(neighbours(batch, state))
            count += held[-1][0].size
            if count >= SENT:
                yield places_of(held)
                held, count = [], 0
        if count:
            yield places_of(held)

    # one number to sort by is sorted by its digits, without comparisons; Spark measures its Arrow batch
    # after each row and column, so no column goes to Python that is not needed there
    dealt = found.repartition(buckets, "bucket").select("hash", "class", "place")
    sorted_rows = dealt.sortWithinPartitions("hash")
    flagged = sorted_rows.mapInArrow(rows, "class long, places array<int>")
    return flagged.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def neighbours(batch: pa.RecordBatch, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """``class, place`` of the rows of a sorted batch whose hash several classes have, by the rows or as a
    place below 0 tells (see ``suffixes``).

    ``state`` holds the hash that the last batch ended in, whether it is known to be shared, and its
    rows if it is not: they are of one class then, and each place is held once.
    """
    hashed, mark, place = (batch.column(k).to_numpy() for k in range(3))
    if not hashed.size:
        return mark, place
    again = place < 0
    place = np.where(again, -1 - place, place)
    if state.get("hash") == hashed[0]:
        # the open group goes on; one row tells that it is shared
        mark, place = np.concatenate([state["class"], mark]), np.concatenate([state["place"], place])
        more = mark.size - hashed.size
        hashed = np.concatenate([np.full(more, hashed[0]), hashed])
        again = np.concatenate([np.zeros(more, bool), again])
        again[0] |= state["shared"]
    equal = hashed[1:] == hashed[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~equal]))
    two = again.copy()
    two[1:] |= equal & (mark[1:] != mark[:-1])
    two = np.logical_or.reduceat(two, starts)
    sizes = np.diff(np.append(starts, hashed.size))
    keep = np.repeat(two, sizes)
    last = starts[-1]
    state |= {"hash": hashed[-1], "shared": bool(two[-1]), "class": mark[:0], "place": place[:0]}
    if not two[-1]:
        state["place"] = np.unique(place[last:])
        state["class"] = np.full(state["place"].size, mark[-1])
    return mark[keep], place[keep]


def places_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """``class, places`` from rows ``class, place``."""
    mark, place = (np.concatenate(x) for x in zip(*held))
    by_mark = np.argsort(mark, kind="stable")
    mark, place = mark[by_mark], place[by_mark]
    starts = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    offsets = pa.array(np.append(starts, mark.size).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(mark[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32()))],
        ["class", "places"],
    )


def compare(candidates: DataFrame, width: int, split_at, buckets: int) -> DataFrame:
    """``class, starts, ends``: runs of places whose string an earlier document has.

    A record is a shared suffix with the bytes around it that its strings can reach. Records are
    dealt by range bucket and sorted by leading text, then document, so the first record that shows
    a string belongs to the first document that has it.
    """
    block, most = BLOCK, HELD
    sent = max(1, min(SENT, (8 << 20) // width))

    def records(batches):
        for texts in W.runs(batches, "text"):
            owner, anchor, first, last, lead, _ = anchored(texts, width)
            marks, orders = (W.cell(texts, c).to_numpy() for c in ("class", "first"))
            places = W.cell(texts, "places")
            at = np.repeat(texts.starts, places.value_lengths().to_numpy()) + places.flatten().to_numpy()
            chosen = np.zeros(texts.data.size, bool)
            chosen[at[at < chosen.size]] = True
            kept = np.flatnonzero(chosen[anchor])
            for some in (kept[k : k + sent] for k in range(0, kept.size, sent)):
                who, here, low = owner[some], anchor[some], first[some]
                bucket = np.searchsorted(split_at.value, ordered(lead[some]), "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)),
                        pieces(texts.data, here, here + LEAD),
                        pa.array(orders[who], pa.int64()),
                        pa.array(marks[who], pa.int64()),
                        pa.array((low - texts.starts[who]).astype(np.int32)),
                        pa.array((here - low).astype(np.int32)),
                        pieces(texts.data, low, last[some] + width),
                    ],
                    ["bucket", "lead", "order", "class", "place", "before", "bytes"],
                )

    kind = "bucket int, lead binary, order long, class long, place int, before int, bytes binary"
    sorted_records = (
        candidates.select("class", "first", "text", "places")
        .mapInArrow(records, kind)
        .repartition(buckets, "bucket")
        .drop("bucket")
        .sortWithinPartitions("lead", "order", "place")
    )

    def runs(batches):
        state: dict[str, object] = {"lead": None, "hash": np.empty(0, np.uint64), "order": np.empty(0, np.int64)}
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                yield from compare_block(batch.slice(at, block), state, width, most)

    found = finished(candidates.sparkSession, lambda: sorted_records.mapInArrow(runs, _FOUND))
    known = found.filter("hash is null").select("class", "start", "end")
    # strings that no task could hold: one row each, of the first document in its block
    undecided = found.filter("hash is not null")
    firsts = undecided.groupBy("lead", "hash").agg(F.min("order").alias("least"))
    later = undecided.join(firsts, ["lead", "hash"]).filter(F.col("order") > F.col("least"))
    return known.unionByName(later.select("class", "start", "end"))


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data[start:end]`` of each, as binary values."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.binary(), sizes.size, buffers)


_FOUND = "class long, start int, end int, lead binary, hash long, order long"


def compare_block(batch: pa.RecordBatch, state: dict, width: int, most: int):
    """Later strings of a block of sorted records, and its undecided strings: those of a leading text
    with more than ``most`` strings that are neither held nor earlier in the block.

    ``state`` holds strings of the leading text that the last block ended in, with their first
    documents. Records come in the order of documents, so what is held is never too late.
    """
    lead = batch.column("lead").cast(pa.large_binary())
    order, mark, place, before = (batch.column(c).to_numpy() for c in ("order", "class", "place", "before"))
    column = batch.column("bytes").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    counts = np.diff(offsets) - width + 1
    record = np.repeat(np.arange(len(column)), counts)
    step = np.arange(record.size) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[record] + step
    hashed = W.strings(data, width)[begin]
    # the same string has its anchor at the same distance, so this tells leading texts apart too
    hashed = W.mix(hashed + (before[record] - step).astype(np.uint64))
    owner = order[record]
    values, inverse = np.unique(hashed, return_inverse=True)
    first = np.full(values.size, np.iinfo(np.int64).max)
    np.minimum.at(first, inverse, owner)
    held, held_order = state["hash"], state["order"]
    missing = np.ones(values.size, bool)
    if held.size:
        at = np.minimum(np.searchsorted(held, values), held.size - 1)
        missing = held[at] != values
        first = np.where(missing, first, np.minimum(first, held_order[at]))
    later = first[inverse] < owner
    final, opening = lead[len(lead) - 1].as_py(), lead[0].as_py()
    same = state["lead"] == opening
    full = same and held.size >= most
    if full:
        head = 0
        while head < len(lead) and lead[head].as_py() == opening:
            head += 1
        open_strings = (record < head) & missing[inverse] & ~later
    if not (same and opening == final):
        tail = len(lead) - 1
        while tail and lead[tail - 1].as_py() == final:
            tail -= 1
        mine = np.unique(inverse[record >= tail])
        state["hash"], state["order"] = values[mine], first[mine]
    elif not full:
        state["hash"] = np.concatenate([held, values[missing]])
        state["order"] = np.concatenate([held_order, first[missing]])
        by_hash = np.argsort(state["hash"], kind="stable")
        state["hash"], state["order"] = state["hash"][by_hash], state["order"][by_hash]
    state["lead"] = final
    edge = np.diff(later.astype(np.int8), prepend=0, append=0)
    fresh = np.concatenate([[True], record[1:] != record[:-1]]) if record.size else later
    starts = np.flatnonzero(later & (fresh | (edge[:-1] == 1)))
    ends = np.flatnonzero(later & np.concatenate([fresh[1:] | (edge[1:-1] == -1), [True]]))
    names = ["class", "start", "end", "lead", "hash", "order"]
    if starts.size:
        who = record[starts]
        none = [pa.nulls(who.size, k) for k in (pa.binary(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(mark[who], pa.int64()),
                pa.array((place[who] + step[starts]).astype(np.int32)),
                pa.array((place[who] + step[ends] + 1).astype(np.int32)),
                *none,
            ],
            names,
        )
    if full and open_strings.any():
        at = np.flatnonzero(open_strings)
        who = record[at]
        start = (place[who] + step[at]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(mark[who], pa.int64()),
                pa.array(start),
                pa.array(start + np.int32(1)),
                pa.array([opening] * at.size, pa.binary()),
                pa.array(W.signed(hashed[at]), pa.int64()),
                pa.array(owner[at], pa.int64()),
            ],
            names,
        )


def cut_texts(texts: W.Texts, width: int) -> pa.RecordBatch:
    """``class, n_removed, starts, ends, kept`` of a run of texts with places in ``gone``: what the strings
    of ``width`` bytes that start there cover, and the SHA-256 of what is left."""
    gone = W.cell(texts, "gone")
    start, end = (x.to_numpy() for x in gone.flatten().flatten())
    owner = np.repeat(np.arange(len(gone)), gone.value_lengths().to_numpy())
    begin = texts.starts[owner] + start
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    # no string goes over the end of its text, so the furthest end so far is of the same text
    reach = np.maximum.accumulate(np.minimum(texts.starts[owner] + end + (width - 1), texts.ends[owner])[order])
    owner = owner[order]
    fresh = np.ones(begin.size, bool)
    fresh[1:] = (begin[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    who, low = owner[first], begin[first]
    high = reach[np.append(first[1:], begin.size) - 1]
    bounds = np.searchsorted(who, np.arange(len(gone) + 1))
    data = memoryview(texts.data)
    kept = []
    spans = list(zip(low.tolist(), high.tolist()))
    for a, b, opens, closes in zip(bounds, bounds[1:], texts.starts.tolist(), texts.ends.tolist()):
        left = hashlib.sha256()
        for at, to in spans[a:b]:
            left.update(data[opens:at])
            opens = to
        left.update(data[opens:closes])
        kept.append(left.hexdigest())
    total = np.concatenate([[0], np.cumsum(high - low)])
    offsets = pa.array(bounds.astype(np.int32))
    runs = [pa.array((x - texts.starts[who]).astype(np.int32)) for x in (low, high)]
    return pa.RecordBatch.from_arrays(
        [
            W.cell(texts, "class"),
            pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()),
            *(pa.ListArray.from_arrays(offsets, x) for x in runs),
            pa.array(kept, pa.string()),
        ],
        ["class", "n_removed", "starts", "ends", "kept"],
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50
) -> DataFrame:
    """``id, n, n_removed, starts, ends, sha`` per row: bytes, removed bytes and their maximal runs
    ``[start, end)``, and the SHA-256 of the remaining bytes.

    A byte goes if a string of ``width`` bytes over it also starts in a document of smaller id.
    """
    if width < LEAD:
        raise ValueError(f"width must be {LEAD} at least")
    prepare(docs)
    docs = docs.select(
        F.col(id_col).alias("id"), repeats.order_of(id_col).alias("order"), F.col(text_col).alias("text")
    )
    spark = docs.sparkSession
    slim = repeats.slim_rows(docs, describe)
    firsts = save(slim.groupBy("class").agg(F.min("order").alias("first")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split_at = spark.sparkContext.broadcast(splitters(docs, 4 * buckets))
    # what was shuffled so far goes before more is
    chosen = finished(
        spark, lambda: shared(suffixes(docs, width, split_at), buckets).join(firsts, "class")
    )
    candidates = repeats.first_texts(docs, chosen, fingerprint)
    gone = compare(candidates, width, split_at, buckets).groupBy("class").agg(
        F.collect_set(F.struct("start", "end")).alias("gone")
    )

    found = candidates.select("class", "text").join(gone, "class")
    cut = found.mapInArrow(
        lambda batches: (cut_texts(texts, width) for texts in W.runs(batches, "text")),
        "class long, n_removed long, starts array<int>, ends array<int>, kept string",
    )
    return repeats.assemble(slim, firsts, cut, width)
