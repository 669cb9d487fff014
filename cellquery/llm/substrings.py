"""Removing repeated passages of words, found by difference-cover anchors.

With a period ``v`` and a difference cover ``D`` of it, any two places meet at some offset below
``v`` at which both are in the cover. So two equal windows of ``w + v - 1`` words share an aligned
anchor of ``w`` words at cover places: hashing only those (4 of 13 places for 20 words) finds every
repeat. Anchors that occur twice are then extended: every window around one is hashed, and a window
stays if it is the first with its hash in the order of document and place.

Equality is equality of 64-bit hashes. Null and empty texts have no words; texts shorter than a
window lose nothing; equal rows count as one document (see ``repeats``); texts are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellquery.llm import repeats
from cellquery.llm import words as W
from cellquery.llm.scratch import finished, prepare, save

#: Perfect difference sets: every difference modulo the period occurs among the places.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(window: int) -> tuple[int, np.ndarray, int]:
    """Period, cover mask of the period, and anchor length: anchors of 8 words at least, if possible."""
    fitting = [p for p in COVERS if window - p + 1 >= 8] or [p for p in COVERS if p < window] or [1]
    period = max(fitting)
    mask = np.zeros(period, bool)
    mask[list(COVERS.get(period, (0,)))] = True
    return period, mask, window - period + 1


def fingerprint(texts: W.Texts) -> np.ndarray:
    """One hash per text of its words in order."""
    cut = W.split(texts, W.SPACES)
    return sequences(W.hashes(texts, cut, False), cut)


def sequences(hashed: np.ndarray, cut: W.Words) -> np.ndarray:
    """One hash per text of its words' hashes in order."""
    return W.sequences(hashed, cut.first, cut.last)


def describe(texts: W.Texts):
    cut = W.split(texts, W.SPACES)
    marks = sequences(W.hashes(texts, cut, False), cut)
    data = texts.data.tobytes()
    shas = [
        hashlib.sha256(b" ".join(data[a:b].split())).hexdigest()
        for a, b in zip(texts.starts, texts.ends)
    ]
    return marks, cut.last - cut.first, shas


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``hash, class, place`` of the anchors at cover places, once per class and task."""
    period, mask, length = cover_for(window)

    def rows(batches):
        seen: set[int] = set()
        for texts in W.runs(batches, "text"):
            cut = W.split(texts, W.SPACES)
            hashed = W.hashes(texts, cut, False)
            marks = W.signed(sequences(hashed, cut))
            spans = W.windows(hashed, length)
            at, places, owners = [], [], []
            for mark, low, high in zip(marks.tolist(), cut.first, cut.last):
                if high - low < window or mark in seen:
                    continue
                seen.add(mark)
                place = np.arange(high - low - length + 1)
                place = place[mask[place % period]]
                at.append(place + low)
                places.append(place)
                owners.append(np.full(place.size, mark))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(spans[np.concatenate(at)]), pa.int64()),
                        pa.array(np.concatenate(owners), pa.int64()),
                        pa.array(np.concatenate(places), pa.int32()),
                    ],
                    ["hash", "class", "place"],
                )

    return docs.select("text").mapInArrow(rows, "hash long, class long, place int")


def repeated(found: DataFrame) -> DataFrame:
    """``class, places``: anchors whose hash occurs at another place too. Rows stream by in sort order."""
    near = Window.partitionBy("hash").orderBy("class", "place")
    here = F.struct("class", "place")
    other = lambda x: x.isNotNull() & (x != here)
    flagged = found.select(
        "class", "place", F.lag(here).over(near).alias("_a"), F.lead(here).over(near).alias("_b")
    ).filter(other(F.col("_a")) | other(F.col("_b")))
    return flagged.groupBy("class").agg(F.collect_set("place").alias("places"))


def extended(candidates: DataFrame, window: int) -> DataFrame:
    """``hash, order, class, place`` of the windows around repeated anchors, once per document."""
    period, _, _ = cover_for(window)

    def rows(batches):
        for texts in W.runs(batches, "text"):
            cut = W.split(texts, W.SPACES)
            spans = W.windows(W.hashes(texts, cut, False), window)
            marks, firsts = (W.cell(texts, c).to_pylist() for c in ("class", "first"))
            places = W.cell(texts, "places")
            hashed, orders, owners, begins = [], [], [], []
            for k, (low, high) in enumerate(zip(cut.first, cut.last)):
                size = high - low - window + 1
                at = places[k].values.to_numpy()
                near = np.zeros(size + period, np.int32)
                np.add.at(near, np.clip(at - period + 1, 0, size), 1)
                np.add.at(near, np.clip(at + 1, 0, size), -1)
                place = np.flatnonzero(np.cumsum(near)[:size] > 0)
                values, begin = np.unique(spans[place + low], return_index=True)
                hashed.append(values)
                orders.append(np.full(values.size, firsts[k]))
                owners.append(np.full(values.size, marks[k]))
                begins.append(place[begin])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(W.signed(np.concatenate(hashed)), pa.int64()),
                    pa.array(np.concatenate(orders), pa.int64()),
                    pa.array(np.concatenate(owners), pa.int64()),
                    pa.array(np.concatenate(begins), pa.int32()),
                ],
                ["hash", "order", "class", "place"],
            )

    return candidates.mapInArrow(rows, "hash long, order long, class long, place int")


def removed_starts(found: DataFrame) -> DataFrame:
    """``class, gone``: windows of which an earlier document has the same."""
    ordered = Window.partitionBy("hash").orderBy("order", "place")
    here = F.struct("order", "place")
    later = found.select("class", "place", here.alias("_at"), F.first(here).over(ordered).alias("_first"))
    return later.filter("_first < _at").groupBy("class").agg(F.collect_set("place").alias("gone"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20
) -> DataFrame:
    """``id, n, n_removed, starts, ends, sha`` per row: words, removed words and their spans
    ``[start, end)``, and the SHA-256 of the kept words joined by one space.

    A word goes if a window of ``window`` words over it also starts earlier: in a document of smaller
    id, or before in the same one.
    """
    prepare(docs)
    docs = docs.select(
        F.col(id_col).alias("id"), repeats.order_of(id_col).alias("order"), F.col(text_col).alias("text")
    )
    slim = repeats.slim_rows(docs, describe)
    spark = docs.sparkSession
    # what was shuffled before a step goes before the next one shuffles more
    firsts = finished(spark, lambda: slim.groupBy("class").agg(F.min("order").alias("first")))
    chosen = finished(spark, lambda: repeated(anchors(docs, window)).join(firsts, "class"))
    candidates = repeats.first_texts(docs, chosen, fingerprint)
    gone = removed_starts(extended(candidates, window))

    def kept(row):
        text = (row["text"] or "").encode()
        texts = W.Texts(None, 0, np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
        spans = W.windows(W.hashes(texts, W.split(texts, W.SPACES), False), window)
        _, begin = np.unique(spans, return_index=True)
        again = np.ones(spans.size, bool)
        again[begin] = False
        again[np.array(row["gone"] or [], np.int64)] = True
        words = text.split()
        starts, ends = repeats.covered(np.flatnonzero(again), window, len(words))
        left, at = [], 0
        for start, end in zip(starts, ends):
            left += words[at:start]
            at = end
        return starts, ends, hashlib.sha256(b" ".join(left + words[at:])).hexdigest()

    cut = repeats.cut_rows(candidates.select("class", "text").join(gone, "class", "left"), kept)
    return repeats.assemble(slim, firsts, cut, window)
