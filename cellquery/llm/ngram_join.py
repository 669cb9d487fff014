"""Jaccard self-join on word n-grams by rare-first prefix filtering.

A document's distinct n-grams are put in one global order, rare before frequent. Two sets of the
needed similarity share an n-gram within short prefixes of that order, so only prefixes are joined;
candidates must pass length, positional and suffix bounds and are verified once per pair.

The order comes from counts of n-gram hashes in a table of fixed size: any order the documents
agree on is right, and this one puts what is frequent last. Documents with one set form a class;
pairs are between classes. Lists of more than ``STAR`` classes are not expanded into pairs at first:
each member is held against one of them. Once components are known, what is left in other components
is paired in lists of up to ``PAIRED`` classes, and in longer ones held in blocks against all others
of the lists, so no link is lost.

A null or empty text has no n-grams and is linked with nothing; a text of fewer words than ``size``
has its whole sequence as the only one. Equal rows count as one document. A null id never is the
smallest id. N-grams are compared by 64-bit hashes. Lists and texts grow with the input, so hints
keep them from being broadcast at any size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.llm import words as W
from cellquery.llm.graph import components
from cellquery.llm.repeats import first_texts, order_of
from cellquery.llm.scratch import (
    bitset,
    finished,
    may_hold,
    pack,
    prepare,
    row_key,
    save,
    slots,
    tree_combine,
    unused,
    without,
)
from cellquery.llm.substrings import sequences

#: Counters of the frequency table, as a power of two: 16 MB.
COUNTER_BITS = 21
#: Bits of the filter for n-grams in the prefixes of two classes, as a power of two: 16 MB.
SHARED_BITS = 27
#: Bits of the filter for first documents, as a power of two: 4 MB.
FIRST_BITS = 25
#: Lists of up to so many classes are expanded into pairs at once.
STAR = 4
#: Lists of up to so many classes are expanded into pairs of different components later.
PAIRED = 32
#: Bits of the filter for texts of pairs, as a power of two: 2 MB.
TEXT_BITS = 24
#: N-grams of a block of sets that meets another.
BLOCK = 1_000_000
NOBODY = (1 << 63) - 1


def sets(texts: W.Texts, size: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    cut = W.split(texts, W.SPACES)
    hashed = W.hashes(texts, cut, True)
    spans = W.windows(hashed, size)
    short = sequences(hashed, cut)
    return [
        np.unique(spans[a : b - size + 1]) if b - a >= size else short[k : k + (b > a)]
        for k, (a, b) in enumerate(zip(cut.first, cut.last))
    ]


def column_sets(batches: Iterable[pa.RecordBatch], column: str, size: int) -> list[np.ndarray]:
    """The sets of all texts in a column."""
    return [grams for texts in W.runs(batches, column) for grams in sets(texts, size)]


def class_of(grams: np.ndarray) -> np.uint64:
    """A hash of the whole set."""
    with np.errstate(over="ignore"):
        return W.mix(W.mix(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(grams.size))[0]


def described(docs: DataFrame, size: int) -> DataFrame:
    """``id, order, key, class, n`` per row, and per task one row with its table of counts."""

    def rows(batches):
        counts, seen = np.zeros(1 << COUNTER_BITS, np.int64), set()
        for texts in W.runs(batches, "text"):
            grams = sets(texts, size)
            marks = [class_of(g) for g in grams]
            fresh = [g for m, g in zip(marks, grams) if m not in seen and not seen.add(m)]
            if fresh:
                counts += np.bincount(slots(np.concatenate(fresh), COUNTER_BITS), minlength=counts.size)
            columns = [W.cell(texts, c) for c in ("id", "order", "key")]
            columns.append(pa.array(W.signed(np.array(marks, np.uint64)), pa.int64()))
            columns.append(pa.array([g.size for g in grams], pa.int64()))
            blobs = pa.nulls(len(grams), pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, blobs], names)
        if seen:
            kind = texts.batch.schema.field("id").type
            empty = [pa.nulls(1, k) for k in (kind, *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([pack(counts)], pa.binary())], names)

    names = ["id", "order", "key", "class", "n", "blob"]
    kind = docs.schema["id"].dataType.simpleString()
    return save(
        docs.mapInArrow(rows, f"id {kind}, order long, key long, class long, n long, blob binary")
    )


def prefixes(docs: DataFrame, size: int, percent: int, counts, firsts) -> DataFrame:
    """``hash, class, n, pos, sig`` of every prefix n-gram, for the first document of each class.

    ``firsts`` is a filter of ``class ^ order`` of the first documents. Where it lets others pass, or
    several rows are the first, a class has rows from more than one task; that only loosens bounds.
    ``sig`` holds how many of the set's n-grams fall in each of 8 parts of the hash space (up to
    255), for the suffix bound.
    """

    def rows(batches):
        seen: set[int] = set()
        for texts in W.runs(batches, "text"):
            parts, fields = [], []
            held = sets(texts, size)
            marks = W.signed(np.array([class_of(g) for g in held], np.uint64))
            first = may_hold(firsts.value, marks ^ W.cell(texts, "order").to_numpy())
            for grams, mark, is_first in zip(held, marks, first):
                if not grams.size or not is_first or mark in seen:
                    continue
                seen.add(mark)
                n = grams.size
                length = n + 1 - -(-percent * n // 100)
                frequency = counts.value[slots(grams, COUNTER_BITS)]
                ranked = grams[np.argsort(frequency, kind="stable")[:length]]
                spread = np.minimum(np.bincount((grams >> np.uint64(61)).astype(np.int64), minlength=8), 255)
                sig = int.from_bytes(spread.astype(np.uint8).tobytes(), "little", signed=True)
                parts.append(ranked)
                fields.append((mark, n, sig, length))
            if parts:
                marks, ns, sigs, lengths = map(np.array, zip(*fields))
                repeat = lambda x, k: pa.array(np.repeat(x, lengths), k)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(np.concatenate(parts)), pa.int64()),
                        repeat(marks, pa.int64()),
                        repeat(ns.astype(np.int32), pa.int32()),
                        pa.array(np.concatenate([np.arange(x) for x in lengths]).astype(np.int32)),
                        repeat(sigs, pa.int64()),
                    ],
                    ["hash", "class", "n", "pos", "sig"],
                )

    return save(
        docs.select("order", "text").mapInArrow(
            rows, "hash long, class long, n int, pos int, sig long"
        )
    )


def passing(rows: DataFrame, wanted: DataFrame, column: str, bits: int) -> DataFrame:
    """The rows whose first column a filter of the longs in ``column`` of ``wanted`` lets through."""
    sent = rows.sparkSession.sparkContext.broadcast(bitset(wanted, column, bits))

    def let_through(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(sent.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(let_through, rows.schema)


def shared_only(postings: DataFrame) -> DataFrame:
    """``hash, class, n, pos, sig, f, hub``: postings of n-grams that several classes have in their
    prefix, ``f`` postings in all, with the least class among them."""
    heads = save(
        postings.groupBy("hash")
        .agg(F.min("class").alias("hub"), F.max("class").alias("_last"), F.count("*").alias("f"))
        .filter("hub < _last")
        .drop("_last")
    )
    return save(passing(postings, heads, "hash", SHARED_BITS).join(heads.hint("merge"), "hash"))


def long_enough(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def needed(a: Column, b: Column, percent: int) -> Column:
    """N-grams two sets of these sizes need in common."""
    return F.ceil((a + b) * percent / (100 + percent))


def rest(n: Column, percent: int) -> Column:
    """N-grams after the prefix."""
    return F.ceil(n * percent / 100) - 1


def candidates(
    left: DataFrame, right: DataFrame, hot: DataFrame, percent: int, also: Column | bool = True
) -> DataFrame:
    """``a, b``: pairs of a class of ``left`` and a greater one of ``right`` that meet in a list and
    may be similar.

    Bounds on what they can have in common: the sizes; at every shared n-gram, the smaller number
    before it and after it; the parts of the hash space; and the shared prefix n-grams plus all
    n-grams after the longer rest. Those in ``hot``, lists that are not expanded, count as shared.
    ``also`` is a further condition on the two sides ``x`` and ``y``.
    """
    part = lambda side, k: F.shiftrightunsigned(f"{side}.sig", 8 * k).bitwiseAND(255)
    apart = sum((F.abs(part("x", k) - part("y", k)) for k in range(8)), F.lit(0))
    both, least = F.col("x.n") + F.col("y.n"), needed(F.col("x.n"), F.col("y.n"), percent)
    met = left.alias("x").join(
        right.alias("y").hint("merge"),
        (F.col("x.hash") == F.col("y.hash"))
        & (F.col("x.class") < F.col("y.class"))
        & long_enough(F.col("x.n"), F.col("y.n"), percent)
        & (apart <= both - least * 2)
        & F.lit(also),
    )
    after = [F.col(f"{s}.n") - F.col(f"{s}.pos") - 1 for s in "xy"]
    reach = F.least("x.pos", "y.pos") + 1 + F.least(*after)
    pairs = met.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(
        F.count("*").alias("shared"),
        F.min(reach).alias("reach"),
        F.first("x.n").alias("n_a"),
        F.first("y.n").alias("n_b"),
    )
    crowded = hot.groupBy("class").agg(F.count("*").alias("crowded"))
    for side in "ab":
        pairs = pairs.join(crowded.select(F.col("class").alias(side), F.col("crowded").alias(f"hot_{side}")), side, "left")
    n_a, n_b = F.col("n_a"), F.col("n_b")
    unseen = F.least(*[F.coalesce(f"hot_{s}", F.lit(0)) for s in "ab"])
    longest = F.col("shared") + unseen + F.greatest(rest(n_a, percent), rest(n_b, percent))
    least = needed(n_a, n_b, percent)
    return pairs.filter((F.col("reach") >= least) & (longest >= least)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough.

    Texts are sent, and cut into n-grams again for each pair: compressed prose takes less than half
    of the bytes of its n-gram hashes.
    """

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(column_sets([batch], f"text_{c}", size) for c in "ab")):
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * common >= percent * (x.size + y.size - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select("a").union(pairs.select("b"))
    texts = passing(texts.select("class", "text"), wanted, "a", TEXT_BITS)
    sides = [texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    both = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long")


def later_pairs(
    middle: DataFrame, hot: DataFrame, labels: DataFrame, percent: int
) -> DataFrame:
    """Pairs ``a, b`` of different components that meet in a list of ``middle`` and may be similar.

    Pairs that share an n-gram of a shorter list have been decided before, so only those of ``hot``
    lists count as shared unseen.
    """
    own = labels.select(F.col("node").alias("class"), F.col("component").alias("own"))
    known = middle.join(own, "class", "left").withColumn("own", F.coalesce("own", "class"))
    several = known.groupBy("hash").agg(F.min("own").alias("_low"), F.max("own").alias("_high"))
    mixed = known.join(several.filter("_low < _high").select("hash"), "hash", "left_semi")
    return candidates(mixed, mixed, hot, percent, F.col("x.own") != F.col("y.own"))


def leftovers(hot: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between members of one hot list that are in different components.

    Lists whose first documents are in one component form a group. Its members of other components
    are the queries, all its members the targets; both are cut into blocks, and every block of
    queries meets every block of targets.
    """
    label = lambda c, to: labels.select(F.col("node").alias(c), F.col("component").alias(to))
    members = (
        hot.select("hub", "class", "n").distinct()
        .join(label("class", "own"), "class", "left")
        .join(label("hub", "group"), "hub", "left")
        .select(
            F.coalesce("group", "hub").alias("group"),
            "class",
            "n",
            F.coalesce("own", "class").alias("own"),
        )
        .distinct()
    )
    members = save(members)
    asks = F.col("own") != F.col("group")
    blocks = lambda s: F.ceil(F.coalesce(F.sum(s), F.lit(0)) / BLOCK).cast("int")
    sizes = members.groupBy("group").agg(
        blocks(F.col("n")).alias("parts"), blocks(F.when(asks, F.col("n"))).alias("asked")
    )
    members = members.join(sizes.filter("asked > 0"), "group")
    block = lambda of: F.pmod(F.xxhash64("class"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    targets = members.select("group", "class", "own", F.lit(False).alias("ask"), block("parts").alias("p"), every("asked").alias("q"))
    queries = members.filter(asks).select("group", "class", "own", F.lit(True).alias("ask"), every("parts").alias("p"), block("asked").alias("q"))

    def match(table: pa.Table) -> pa.Table:
        marks, own = table["class"].to_numpy(), table["own"].to_numpy()
        ask = table["ask"].to_numpy(zero_copy_only=False)
        held = column_sets(table.to_batches(), "text", size)
        target = np.flatnonzero(~ask)
        found: list[tuple[int, int]] = []
        if target.size:
            sizes = np.array([held[t].size for t in target])
            values = np.concatenate([held[t] for t in target])
            owner = np.repeat(np.arange(target.size), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for query in np.flatnonzero(ask):
                mine = held[query]
                low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, "right")
                count = high - low
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                common = np.bincount(owner[at], minlength=target.size)
                near = 100 * common >= percent * (mine.size + sizes - common)
                near = target[near & (own[target] != own[query])]
                _, first = np.unique(own[near], return_index=True)
                found += [(int(marks[query]), int(marks[t])) for t in near[first]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cells = targets.union(queries).join(texts, "class")
    return cells.groupBy("group", "p", "q").applyInArrow(match, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``id, key, n, component, component_id`` per row.

    Documents are linked if ``100 * common >= percent * all`` of their n-grams; ``component`` names
    what links reach, ``component_id`` is the smallest id in it, ``n`` the size of the set.
    """
    prepare(docs)
    named = docs.select(
        F.col(id_col).alias("id"),
        order_of(id_col).alias("order"),
        row_key(id_col, text_col).alias("key"),
        F.col(text_col).alias("text"),
    )
    return finished(docs.sparkSession, lambda: _near_duplicates(named, size, percent))


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    table = described(docs, size)
    slim = table.filter("blob is null").drop("blob")
    counts = tree_combine(table, "blob", np.int64, np.add, np.zeros(1 << COUNTER_BITS, np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    firsts = save(slim.filter("n > 0").groupBy("class").agg(F.min("order").alias("first")))
    named = firsts.select(F.col("class").bitwiseXOR(F.col("first")).alias("name"))
    is_first = docs.sparkSession.sparkContext.broadcast(bitset(named, "name", FIRST_BITS))

    lists = shared_only(prefixes(docs, size, percent, sent, is_first))
    short, hot = lists.filter(F.col("f") <= STAR), lists.filter(F.col("f") > STAR)
    middle, crowds = hot.filter(F.col("f") <= PAIRED), hot.filter(F.col("f") > PAIRED)
    near = candidates(short, short, hot, percent)
    # the hub is the least class of its list
    star = candidates(hot.filter(F.col("class") == F.col("hub")), hot, lists, percent)
    pairs = save(near.union(star).distinct())
    asked = pairs.select("a").union(pairs.select("b")).union(hot.select("class")).distinct()
    chosen = save(asked.withColumnRenamed("a", "class").join(firsts, "class"))

    def fingerprint(texts):
        return np.array([class_of(g) for g in sets(texts, size)], np.uint64)

    # What is chosen grows with the documents, so it is never broadcast.
    texts = first_texts(docs, chosen.hint("merge"), fingerprint).select("class", "text")
    links = save(verified(pairs, texts, size, percent))
    labels = components(links)
    later = save(later_pairs(middle, crowds, labels, percent))
    more = verified(later, texts, size, percent).union(leftovers(crowds, labels, texts, size, percent))
    # components of components: the second round of links is between labels
    to_label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    between = (
        more.join(to_label("a"), "a", "left").join(to_label("b"), "b", "left")
        .select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    )
    merged = components(save(between.distinct()))
    root = firsts.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "node", F.coalesce("component", "class")
    ).drop("component")
    root = root.join(merged, "node", "left").select(
        "class", "first", F.coalesce("component", "node").alias("component")
    )
    smallest = root.groupBy("component").agg(F.min("first").alias("smallest"))
    classes = save(root.join(smallest, "component").select("class", "component", "smallest"))
    known = F.when(F.col("smallest") < NOBODY, F.col("smallest"))
    alone = F.when(F.col("order") < NOBODY, F.col("order"))
    return slim.join(classes, "class", "left").select(
        "id",
        "key",
        "order",
        "n",
        "component",
        F.when(F.col("n") > 0, known).otherwise(alone).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates (the smallest id), and all rows linked with nothing."""
    rows = near_duplicates(docs, id_col, text_col, **options).select("key", "order", "n", "component")

    def decided() -> DataFrame:
        linked = rows.filter("n > 0")
        kept = linked.groupBy("component").agg(F.min(F.struct("order", "key")).alias("_kept")).select("_kept.key")
        times = linked.groupBy("key").agg(F.count("*").alias("times"))
        # rows that go, and keys of several equal rows, of which one stays
        return times.join(kept.withColumn("stays", F.lit(True)), "key", "left")

    status = finished(docs.sparkSession, decided)
    gone = status.filter("stays is null or times > 1").select("key")
    rest = without(docs, row_key(id_col, text_col), gone)
    named = unused("_key", docs.columns)
    several = status.filter("stays and times > 1").select(F.col("key").alias(named))
    again = docs.withColumn(named, row_key(id_col, text_col)).join(several, named, "left_semi")
    return rest.unionByName(again.dropDuplicates([named]).drop(named))
