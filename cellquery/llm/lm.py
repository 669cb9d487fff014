"""Hashed maximum-entropy language model with a class-factored softmax.

``P(word | before) = P(class | features) * P(word | class)``. The class of a word is read off its
last letters. The softmax over classes has hashed features: the word before, the ones two and three
before, and the pair of the last two. Its weights start from smoothed counts and are then trained by
full-batch gradient updates until they have converged: every task sums its part of the gradient and of the
likelihood over its documents, the sums meet in a tree, and the driver takes a step scaled by the expected
counts, with momentum, and takes it back when the likelihood fell. Updates end only when the next one
promises less than ``tolerance`` of the logarithm of each token's probability. Words within a class follow
their training counts plus one; all unseen words of a class share one count. So it sums to one.

A text is its case-folded words and one end token; null and empty texts are the end token alone.
Words are 59-bit hashes and five bits of class. Repeated rows are scored and counted each. Counts,
gradients and scores cover all texts whole; only the counts of the most frequent words travel to the
tasks, and those of all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.llm import words as W
from cellquery.llm.scratch import pack, prepare, save, tree_combine

CLASS_BITS = 5
CLASSES = 1 << CLASS_BITS
END_CLASS = CLASSES - 1
TEMPLATES = 4
#: Hashed features of each template, as a power of two.
FEATURE_BITS = 13
FEATURES = 1 << FEATURE_BITS
#: Tokens that are worked on at once; an array of 32 classes a token is held then.
BLOCK = 1 << 16
#: Tokens whose classes are worked out together, in a core's cache.
PIECE = 1 << 12
#: Sums of odds below this are worked out again from logarithms.
LEAST = 1e-30
#: Words whose counts travel to the tasks: 2 MB. The others are joined.
FREQUENT = 1 << 17
_END = np.uint64(0x5EED_0E4D_0000_0000 | END_CLASS)
_START = np.uint64(0x57A7_0000_0000_0000)


class Block(NamedTuple):
    """Tokens of whole documents; ``ends`` are the places after each document's end token."""

    tokens: np.ndarray
    ends: np.ndarray
    rows: list


def token_blocks(batches, columns: tuple[str, ...] = ()) -> Iterator[Block]:
    """All documents as tokens, some hundred thousand at a time."""
    held, sizes, rows, total = [], [], [], 0
    for texts in W.runs(batches, "text"):
        cut = W.split(texts, W.SPACES)
        hashed = W.hashes(texts, cut, True)
        low = np.uint64(CLASSES - 1)
        last = texts.data[np.maximum(cut.ends - 1, 0)].astype(np.int64)
        before = texts.data[np.maximum(cut.ends - 2, cut.starts)].astype(np.int64)
        kind = ((W.LOWER[last].astype(np.int64) * 31 + W.LOWER[before] * 7) % (CLASSES - 1)).astype(np.uint64)
        ids = (hashed & ~low) | kind
        count = cut.last - cut.first
        out = np.empty(ids.size + len(count), np.uint64)
        place = np.arange(ids.size) + np.repeat(np.arange(len(count)), count)
        out[place] = ids
        stop = np.cumsum(count + 1)
        out[stop - 1] = _END
        held.append(out)
        sizes.append(count + 1)
        rows.append([W.cell(texts, c) for c in columns])
        total += out.size
        if total >= BLOCK:
            yield Block(np.concatenate(held), np.cumsum(np.concatenate(sizes)), rows)
            held, sizes, rows, total = [], [], [], 0
    if held:
        yield Block(np.concatenate(held), np.cumsum(np.concatenate(sizes)), rows)


def contexts(block: Block) -> np.ndarray:
    """The feature of each template at each token: templates x tokens."""
    begins = np.concatenate([[0], block.ends[:-1]])
    before = []
    for back in (1, 2, 3):
        shifted = np.full(block.tokens.size, _START)
        shifted[back:] = block.tokens[:-back]
        for step in range(back):
            at = begins + step
            shifted[at[at < block.ends]] = _START
        before.append(shifted)
    one, two, three = before
    slots = [one, two, three, one * np.uint64(0x9E3779B97F4A7C15) ^ W.mix(two)]
    return np.stack(
        [
            (W.mix(s + np.uint64(k + 1)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
            for k, s in enumerate(slots)
        ]
    )


def classes_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CLASSES - 1)).astype(np.int64)


def scores_of(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Log-odds of each class, at most 0: tokens x classes."""
    scores = np.take(weights[0], slots[0], axis=0)
    for template in range(1, TEMPLATES):
        scores += np.take(weights[template], slots[template], axis=0)
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores


def log_chances(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities: tokens x classes."""
    scores = scores_of(weights, bias, slots)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


def chances(logs: np.ndarray, odds: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities, tokens x classes, and the logarithm of each token's sum of odds.

    The odds of a class are the product over templates of ``odds``, which are the exponentials of ``logs``.
    """
    found = np.take(odds[0], slots[0], axis=0)
    for template in range(1, TEMPLATES):
        found *= np.take(odds[template], slots[template], axis=0)
    sums = found @ np.ones(CLASSES, found.dtype)
    lost = np.flatnonzero(sums < LEAST)
    sums[lost] = 1
    found /= sums[:, None]
    sums = np.log(sums, dtype=np.float64)
    if lost.size:
        scores = sum(logs[template][slots[template, lost]] for template in range(TEMPLATES)).astype(np.float64)
        most = scores.max(axis=1, keepdims=True)
        exact = np.exp(scores - most)
        total = exact.sum(axis=1, keepdims=True)
        found[lost], sums[lost] = exact / total, (most + np.log(total))[:, 0]
    return found, sums


def add_chances(total: np.ndarray, logs: np.ndarray, odds: np.ndarray, slots: np.ndarray) -> float:
    """Add each feature's expected classes to ``total``, and give the sum of the logarithms of sums of odds."""
    spread = 0.0
    held = np.empty((CLASSES, min(BLOCK, slots.shape[1])))
    for low in range(0, slots.shape[1], BLOCK):
        part = slots[:, low : low + BLOCK]
        size = part.shape[1]
        for at in range(0, size, PIECE):
            found, sums = chances(logs, odds, part[:, at : at + PIECE])
            held[:, at : at + len(found)] = found.T
            spread += float(sums.sum())
        for template in range(TEMPLATES):
            for kind in range(CLASSES):
                total[template, kind] += np.bincount(part[template], held[kind, :size], FEATURES)
    return spread


def counted(training: DataFrame) -> DataFrame:
    """``token, count`` per task, and one row per task with its table of features and classes."""

    def merge(parts):
        tokens, counts = (np.concatenate(x) for x in zip(*parts))
        values, inverse = np.unique(tokens, return_inverse=True)
        return values, np.bincount(inverse, counts).astype(np.int64)

    def rows(batches):
        table = np.zeros((TEMPLATES, FEATURES * CLASSES), np.int64)
        parts, waiting = [], 0
        for block in token_blocks(batches):
            kind = classes_of(block.tokens)
            for template, slots in enumerate(contexts(block)):
                table[template] += np.bincount(slots * CLASSES + kind, minlength=table.shape[1])
            parts.append(np.unique(block.tokens, return_counts=True))
            waiting += parts[-1][0].size
            if waiting > 2_000_000:
                parts = [merge(parts)]
                waiting = parts[0][0].size
                if waiting > 1_000_000:
                    yield vocabulary_rows(*parts[0])
                    parts, waiting = [], 0
        if parts:
            yield vocabulary_rows(*merge(parts))
        if table.any():
            blob = pa.array([pack(table)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), blob], ["token", "count", "blob"]
            )

    return save(training.mapInArrow(rows, "token long, count long, blob binary"))


def vocabulary_rows(tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(W.signed(tokens), pa.int64()),
            pa.array(counts, pa.int64()),
            pa.nulls(tokens.size, pa.binary()),
        ],
        ["token", "count", "blob"],
    )


def expect(training: DataFrame, weights: np.ndarray, bias: np.ndarray, seen: np.ndarray) -> tuple[float, np.ndarray]:
    """The logarithm of the likelihood of all classes, and how often each class is expected with each feature."""
    # softmax doesn't mind a shift, so the likeliest class of a feature has odds of 1
    logs = (weights - weights.max(axis=2, keepdims=True)).astype(np.float32)
    logs[0] += bias - bias.max()
    sent = training.sparkSession.sparkContext.broadcast(logs)

    def expected(batches):
        logs = sent.value
        odds = np.exp(logs)
        total, spread = np.zeros((TEMPLATES, CLASSES, FEATURES), np.float64), 0.0
        for block in token_blocks(batches):
            spread += add_chances(total, logs, odds, contexts(block))
        yield pa.RecordBatch.from_arrays(
            [pa.array([pack(total.astype(np.float32))], pa.binary()), pa.array([spread])], ["blob", "spread"]
        )

    blobs = save(training.mapInArrow(expected, "blob binary, spread double"))
    zero = np.zeros(TEMPLATES * CLASSES * FEATURES, np.float32)
    guess = tree_combine(blobs, "blob", np.float32, np.add, zero).astype(np.float64)
    spread = blobs.agg(F.coalesce(F.sum("spread"), F.lit(0.0))).first()[0]
    sent.destroy()
    # each token has one feature of each template
    return float((seen * logs).sum()) - spread, guess.reshape(TEMPLATES, CLASSES, FEATURES).transpose(0, 2, 1)


def train(training: DataFrame, table: np.ndarray, ridge: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (templates x features x classes) and class bias that maximize the likelihood with a
    Gaussian prior of precision ``ridge`` on the weights.

    Updates end when the slope promises less than ``tolerance`` a token for the next one.
    """
    seen = table.reshape(TEMPLATES, FEATURES, CLASSES).astype(np.float64)
    share = seen[0].sum(axis=0) + 1.0
    share /= share.sum()
    bias = np.log(share).astype(np.float32)
    prior = ridge * share
    rate = (seen + prior) / (seen.sum(axis=2, keepdims=True) + ridge)
    # templates overlap, so each starts with a part of what it says alone
    start = np.array([0.4, 0.2, 0.15, 0.25])[:, None, None]
    at = before = start * (np.log(rate) - np.log(share))
    tokens = max(float(seen[0].sum()), 1.0)
    speed, best = 1.5 / TEMPLATES, -np.inf
    while True:
        likely, guess = expect(training, at, bias, seen)
        value = likely - ridge / 2 * float((at**2).sum())
        if value >= best:
            slope = seen - guess - ridge * at
            best, top, way = value, at, slope / (guess + ridge)
            step = np.clip(way * speed, -1, 1)
            ahead = top + step
            if float((slope * np.clip(way * (1.5 / TEMPLATES), -1, 1)).sum()) < tolerance * tokens:
                return ahead.astype(np.float32), bias
            at, before = ahead + 0.5 * (ahead - before), ahead
        else:
            speed /= 2
            at = before = top + np.clip(way * speed, -1, 1)


def held_out_ids(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id, as text, falls in the held-out fold; a null id doesn't."""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % folds == fold, F.lit(False))


def score_all(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    fold: int = 2,
    ridge: float = 8.0,
    frequent: int = FREQUENT,
    tolerance: float = 1e-3,
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    ``base_score`` is the log10 probability under counts plus one, ``score`` under the model; both
    learn from the rows that are not held out.
    """
    prepare(docs)
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).alias("id"),
        held_out_ids(id_col, folds, fold).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    training = docs.filter(~F.col("held_out")).select("text")
    found = counted(training)
    known = save(found.filter("blob is null").groupBy("token").agg(F.sum("count").alias("count")))
    kind = F.col("token").bitwiseAND(CLASSES - 1)
    mass = np.ones(CLASSES)
    for row in known.groupBy(kind.alias("k")).agg(F.sum("count"), F.count("*")).collect():
        mass[row[0]] += row[1] + row[2]
    total, distinct = known.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    whole = float(total + distinct + 1)
    zero = np.zeros(TEMPLATES * FEATURES * CLASSES, np.int64)
    table = tree_combine(found, "blob", np.int64, np.add, zero)
    weights, bias = train(training, table, ridge, tolerance)
    top = known.orderBy(F.desc("count"), "token").limit(frequent).toPandas()
    order = np.argsort(top["token"].to_numpy().view(np.uint64))
    names = top["token"].to_numpy().view(np.uint64)[order]
    counts = top["count"].to_numpy(np.float64)[order]
    sent = spark.sparkContext.broadcast((weights, bias, names, counts, mass, whole))

    def scores(batches):
        weights, bias, names, counts, mass, whole = sent.value
        number = TaskContext.get().partitionId() << 40
        per_class = np.log10(mass)
        for block in token_blocks(batches, ("id", "held_out")):
            kind = classes_of(block.tokens)
            slots = contexts(block)
            gain = np.empty(kind.size)
            for low in range(0, kind.size, PIECE):
                part = kind[low : low + PIECE]
                chance = log_chances(weights, bias, slots[:, low : low + PIECE])
                gain[low : low + PIECE] = chance[np.arange(part.size), part] / math.log(10)
            slot = np.searchsorted(names, block.tokens)
            slot[slot == names.size] = 0
            held = names[slot] == block.tokens if names.size else np.zeros(kind.size, bool)
            count = np.where(held, np.log10(counts[slot] + 1), 0.0) if names.size else np.zeros(kind.size)
            base = np.where(held, count - math.log10(whole), 0.0)
            inner = np.where(held, count - per_class[kind], 0.0)
            begins = np.concatenate([[0], block.ends[:-1]])
            sums = [np.add.reduceat(x, begins) for x in (base, gain + inner, held.astype(np.int64))]
            rest = np.flatnonzero(~held)
            edges = np.searchsorted(rest, np.append(begins, block.tokens.size))
            tail = pa.ListArray.from_arrays(
                pa.array(edges.astype(np.int32)), pa.array(W.signed(block.tokens[rest]), pa.int64())
            )
            ids, out = [pa.chunked_array([r[k] for r in block.rows]).combine_chunks() for k in (0, 1)]
            uid = pa.array(np.arange(len(block.ends)) + number, pa.int64())
            number += len(block.ends)
            sizes = pa.array(block.ends - begins, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [uid, ids, out, sizes, pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), tail],
                ["uid", "id", "held_out", "n_tokens", "n_top", "base_top", "score_top", "tail"],
            )

    kind_of_id = docs.schema["id"].dataType.simpleString()
    rows = save(
        docs.mapInArrow(
            scores,
            f"uid long, id {kind_of_id}, held_out boolean, n_tokens long, n_top long, "
            "base_top double, score_top double, tail array<long>",
        )
    )
    masses = F.array(*[F.lit(float(m)) for m in mass])
    count = F.coalesce("count", F.lit(0))
    tail = (
        rows.select("uid", F.explode("tail").alias("token"))
        .join(known, "token", "left")
        .groupBy("uid")
        .agg(
            F.sum((count > 0).cast("long")).alias("n_tail"),
            F.sum(F.log10((count + 1) / F.lit(whole))).alias("base_tail"),
            F.sum(F.log10((count + 1) / F.element_at(masses, (kind + 1).cast("int")))).alias("score_tail"),
        )
    )
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return rows.drop("tail").join(tail, "uid", "left").select(
        "id",
        "held_out",
        "n_tokens",
        plus("n_top", "n_tail", 0).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base_top", "base_tail", 0.0).alias("base_score"),
        plus("score_top", "score_tail", 0.0).alias("score"),
    )
