"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of whole documents. Each segment stores the postings (places, in
word order) of the test terms that occur in it, so a phrase is found inside one segment and nothing
is shuffled: the offset-adjusted lists of a window are intersected from its rarest term on.

Words are case-folded (A-Z) runs of digits, letters and non-ASCII characters, compared by 64-bit
hashes. Nulls and texts without words have no words and no hits; an item without words has no
windows; items with one id count once, a null id is the empty string; rows are never merged, so
repeated documents give repeated rows. Empty tables give empty results or documents without hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.llm import words as W
from cellquery.llm.scratch import prepare, row_key, save, without

#: Words of a segment, at least; a segment is one row of the stored index.
SEGMENT_WORDS = 2_000_000
#: Words of the benchmark that are sent to every task at once (8 bytes each); a larger benchmark
#: is searched in blocks of this size.
BLOCK_WORDS = 1_000_000

_INDEX = """keys array<long>, ids array<string>, first array<long>, last array<long>,
    terms array<int>, counts array<int>, places array<int>"""
_FOUND = """key long, id string, n_words long, n_hit long, starts array<int>, ends array<int>,
    items array<string>, near array<string>"""


def item_windows(items: DataFrame, id_col: str, text_col: str, length: int):
    """``(ids, windows)`` of one block of the benchmark: word hashes of each distinct window, and
    the positions in ``ids`` of the items that hold it."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    table = pa.Table.from_pandas(rows.toPandas(), preserve_index=False)
    table = table.cast(pa.schema([("id", pa.string()), ("t", pa.string())]))
    found: dict[bytes, set[int]] = {}
    ids: list[str] = []
    for texts in W.runs(table.to_batches(), "t"):
        cut = W.split(texts, W.MARKS)
        hashed = W.hashes(texts, cut, True)
        for name, low, high in zip(W.cell(texts, "id").to_pylist(), cut.first, cut.last):
            ids.append(name or "")
            for at in range(low, max(high - length, low) + 1) if high > low else ():
                key = hashed[at : min(at + length, high)].tobytes()
                found.setdefault(key, set()).add(len(ids) - 1)
    return ids, [(np.frombuffer(k, np.uint64), sorted(v)) for k, v in found.items()]


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The stored index of ``key, id, t``: postings of the terms in ``vocabulary`` (sorted hashes), one
    row a segment."""
    prepare(docs)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches):
        terms = known.value
        keys, ids, firsts, lasts, at_term, at_place, total = [], [], [], [], [], [], 0

        def segment():
            term, place = np.concatenate(at_term), np.concatenate(at_place)
            order = np.argsort(term, kind="stable")
            present, counts = np.unique(term, return_counts=True)
            values = [
                [x for part in keys for x in part.to_pylist()],
                [x for part in ids for x in part.to_pylist()],
                np.concatenate(firsts),
                np.concatenate(lasts),
                present,
                counts,
                place[order],
            ]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 2, *[pa.int32()] * 3]
            lists = [pa.array([v], pa.list_(k)) for v, k in zip(values, kinds)]
            names = ["keys", "ids", "first", "last", "terms", "counts", "places"]
            return pa.RecordBatch.from_arrays(lists, names)

        for texts in W.runs(batches, "t"):
            cut = W.split(texts, W.MARKS)
            hashed = W.hashes(texts, cut, True)
            slot = np.searchsorted(terms, hashed)
            slot[slot == terms.size] = 0
            held = np.flatnonzero(terms[slot] == hashed) if terms.size else slot[:0]
            keys.append(W.cell(texts, "key"))
            ids.append(W.cell(texts, "id"))
            firsts.append(cut.first + total)
            lasts.append(cut.last + total)
            at_term.append(slot[held].astype(np.int32))
            at_place.append((held + total).astype(np.int32))
            total += hashed.size
            if total >= SEGMENT_WORDS:
                yield segment()
                keys, ids, firsts, lasts, at_term, at_place, total = [], [], [], [], [], [], 0
        if ids:
            yield segment()

    return save(docs.select("key", "id", "t").mapInArrow(segments, _INDEX))


class Segment:
    """Postings of one segment, for phrase and proximity look-ups."""

    def __init__(self, first, last, terms, counts, places, vocabulary_size: int):
        self.first, self.last, self.places = first, last, places
        self.counts = np.zeros(vocabulary_size, np.int64)
        self.counts[terms] = counts
        self.begin = np.zeros(vocabulary_size, np.int64)
        self.begin[terms] = np.cumsum(counts) - counts

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.begin[term] : self.begin[term] + self.counts[term]]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, places, "right")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First places of all occurrences of the terms in a row, inside one document."""
        starts = None
        for k in np.argsort(self.counts[terms], kind="stable"):
            here = self.postings(terms[k]) - k
            if starts is not None:
                at = np.minimum(np.searchsorted(here, starts), here.size - 1)
                here = starts[here[at] == starts]
            starts = here
            if not starts.size:
                return starts
        doc = self.document(starts)
        ok = doc < self.last.size
        ok[ok] = (self.first[doc[ok]] <= starts[ok]) & (starts[ok] + terms.size <= self.last[doc[ok]])
        return starts[ok]

    def near(self, terms: np.ndarray, width: int) -> set[int]:
        """Documents in which ``width`` words in a row hold every term."""
        terms = np.unique(terms)
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        lists = [self.postings(t) for t in terms]
        found: set[int] = set()
        for place in lists[0]:
            doc = int(self.document(np.array([place]))[0])
            if doc in found:
                continue
            low, high = max(place - width + 1, self.first[doc]), min(place + width, self.last[doc])
            around = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
            if all(x.size for x in around):
                for start in np.unique(np.concatenate(around)):
                    if all(((x >= start) & (x < start + width)).any() for x in around):
                        found.add(doc)
                        break
        return found


def search(index: DataFrame, vocabulary: np.ndarray, ids: list[str], windows: list, slack: int | None):
    """One row per document: hit words as merged spans, items with a phrase, items near (if ``slack``)."""
    numbered = [(np.searchsorted(vocabulary, terms), items) for terms, items in windows]
    sent = index.sparkSession.sparkContext.broadcast((ids, numbered, vocabulary.size))

    def look(batches):
        names, asked, size = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys, doc_ids = (batch.column(c)[row].as_py() for c in range(2))
                part = Segment(*(batch.column(c)[row].values.to_numpy() for c in range(2, 7)), size)
                items = [set() for _ in doc_ids]
                close = [set() for _ in doc_ids]
                cover = np.zeros(int(part.last[-1]) + 1 if len(doc_ids) else 1, np.int32)
                for terms, held in asked:
                    if not part.counts[terms].all():
                        continue
                    starts = part.phrase(terms)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + terms.size, -1)
                    for doc in set(part.document(starts).tolist()):
                        items[doc].update(held)
                    if slack is not None:
                        for doc in part.near(terms, terms.size + slack):
                            close[doc].update(held)
                hit = (np.cumsum(cover) > 0).astype(np.int8)
                out = {k: [] for k in ("n_words", "n_hit", "starts", "ends", "items", "near")}
                for doc, (low, high) in enumerate(zip(part.first, part.last)):
                    edge = np.diff(hit[low:high], prepend=0, append=0) if items[doc] else hit[:0]
                    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    out["n_words"].append(int(high - low))
                    out["n_hit"].append(int((ends - starts).sum()))
                    out["starts"].append(starts.tolist())
                    out["ends"].append(ends.tolist())
                    out["items"].append(sorted({names[i] for i in items[doc]}))
                    out["near"].append(sorted({names[i] for i in close[doc]}))
                many = pa.list_(pa.int32())
                kinds = [pa.int64(), pa.int64(), many, many, *[pa.list_(pa.string())] * 2]
                arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(doc_ids, pa.string()), *arrays], ["key", "id", *out]
                )

    return index.mapInArrow(look, _FOUND)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    length: int = 10,
    slack: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id, n_words, n_hit, starts, ends, items, near``: one row per document.

    ``items`` holds the ids of benchmark items of which a window of ``length`` words (or the whole
    shorter item) occurs; the spans ``starts[i] <= word < ends[i]`` are all words inside such an
    occurrence. With ``slack``, ``near`` holds the items of which some window has all its words, in
    any order, among ``length + slack`` words in a row. ``id`` is the id as a string.
    """
    words = items.agg(F.coalesce(F.sum(F.length(item_text_col)), F.lit(0))).first()[0] / 2
    blocks = max(1, int(np.ceil(words / block_words)))
    key, name = F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("string").alias("id")
    slim = docs.select(key, name, F.col(text_col).alias("t"))
    if blocks > 1:
        slim = save(slim)  # every block sees a row by the same key
    parts = []
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64(item_id_col, item_text_col), F.lit(blocks)) == block)
        ids, windows = item_windows(chosen, item_id_col, item_text_col, length)
        terms = np.unique(np.concatenate([w for w, _ in windows])) if windows else np.empty(0, np.uint64)
        index = build_index(slim, terms)
        parts.append(search(index, terms, ids, windows, slack))
    return (parts[0] if blocks == 1 else _merge(parts)).drop("key")


def _merge(parts: list[DataFrame]) -> DataFrame:
    """The results of several blocks as one row per key."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    lists = ("starts", "ends", "items", "near")
    grouped = union.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("id", "n_words")],
        *[F.flatten(F.collect_list(c)).alias(c) for c in lists]
    )

    def tidy(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                spans: list[list[int]] = []
                for start, end in sorted(zip(row["starts"], row["ends"])):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                row |= {"starts": [s for s, _ in spans], "ends": [e for _, e in spans]}
                row |= {"n_hit": sum(e - s for s, e in spans)}
                row |= {"items": sorted(set(row["items"])), "near": sorted(set(row["near"]))}
            names = ["key", "id", "n_words", "n_hit", *lists]
            many, texts = pa.list_(pa.int32()), pa.list_(pa.string())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), many, many, texts, texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names
            )

    return grouped.mapInArrow(tidy, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """``found`` with ``n_items, items_sha256, contaminated``."""
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose document holds no window of any item."""
    key = row_key("doc_id", "text")
    found = find_items(docs.select(key.alias("_key"), "text"), items, id_col="_key", **options)
    gone = save(found.filter("n_hit > 0").select(F.col("id").cast("long")).distinct())
    return without(docs, key, gone)


def sha256_of(items: list[str]) -> str:
    """What ``digest`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
