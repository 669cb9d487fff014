"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from hashed features (words, word beginnings, word shapes), whose
log-odds are shrunk towards zero by their own sampling error, and calibrated on labelled rows that
did not train them. It is combined with the posterior of the document's site: rates of bad
documents per host, shrunk towards the global rate, and per path of a host, shrunk towards the
host's. Strengths of shrinkage are estimated from how much the rates differ.

Two things are told: low quality (label 0) and toxic (label 1); a document is kept if neither has
the larger probability. A null or empty text has no features and is judged by its site alone. Null
hosts and paths are sites of their own. Labels of one id count once (the worse); labels with a null
only miss in the fit. Without labels of both kinds a verdict is never bad. Rows are never merged.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.llm import words as W
from cellquery.llm.scratch import pack, prepare, row_key, save, tree_combine, without

#: Features, as a power of two.
FEATURE_BITS = 18
#: Labelled rows the document classifier is fitted on, at most, of each kind (low or good, toxic or
#: not); half train the weights, half calibrate them. Site rates use all labels.
SAMPLE_PER_KIND = 8_000
#: Weights with less than so many standard errors go to zero.
ERRORS = 3.0
_SHAPE = np.array(
    [65 if chr(b).isupper() else 97 if b > 127 or chr(b).islower() else 48 if chr(b).isdigit() else b for b in range(128)]
    + [97] * 128,
    np.uint8,
)
TARGETS = ("low", "toxic")
SHARES = 5


def features(texts: W.Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct features of each text, and its shares: words equal to the one before, distinct
    words, words of marks only, words of capitals, and the logarithm of its length."""
    cut = W.split(texts, W.SPACES)
    shares = np.zeros((len(texts.starts), SHARES))
    if not cut.starts.size:
        return [np.empty(0, np.int64) for _ in texts.starts], shares
    data = W.LOWER[texts.data]
    shape = _SHAPE[texts.data]
    turn = np.concatenate([[True], shape[1:] != shape[:-1]])
    turn[cut.starts] = True
    place = np.cumsum(turn)
    hashed = [
        W.spans(data, cut.starts, cut.ends),
        W.spans(data, cut.starts, np.minimum(cut.starts + 4, cut.ends)) + np.uint64(1),
        W.spans(data, cut.starts, np.minimum(cut.starts + 5, cut.ends)) + np.uint64(2),
        W.spans(shape[turn], place[cut.starts] - 1, place[cut.ends - 1]) + np.uint64(3),
    ]
    slot = [(W.mix(h) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for h in hashed]
    letters = np.concatenate([[0], np.cumsum((shape == 97) | (shape == 65) | (shape == 48))])
    small = np.concatenate([[0], np.cumsum(shape == 97)])
    marks = letters[cut.ends] == letters[cut.starts]
    capitals = ~marks & (small[cut.ends] - small[cut.starts] <= (cut.ends - cut.starts) // 3)
    again = np.concatenate([[False], hashed[0][1:] == hashed[0][:-1]])
    found = []
    for k, (a, b) in enumerate(zip(cut.first, cut.last)):
        found.append(np.unique(np.concatenate([s[a:b] for s in slot])))
        if b > a:
            again[a] = False
            distinct = np.unique(slot[0][a:b]).size
            many = [again[a:b].sum(), distinct, marks[a:b].sum(), capitals[a:b].sum()]
            shares[k] = [*(np.array(many) / (b - a)), np.log1p(b - a)]
    return found, shares


class Model(NamedTuple):
    """``weights`` per target and feature, and per target the log-odds as a linear function of what
    ``inputs`` gives."""

    weights: np.ndarray
    slope: np.ndarray

    def log_odds(self, slots: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return (self.slope * inputs(self.weights, slots, shares)).sum(axis=1)


def inputs(weights: np.ndarray, slots: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Per target: the sum of a text's weights, its three strongest for and against, shares, and 1.

    A few strong words decide on toxicity however long the text is, so the sum alone won't do.
    """
    held = np.sort(weights[:, slots], axis=1)
    padded = np.concatenate([np.zeros((2, 3)), held, np.zeros((2, 3))], axis=1)
    strong = np.sort(padded, axis=1)
    columns = [held.sum(axis=1), strong[:, -3:].sum(axis=1), strong[:, :3].sum(axis=1)]
    rest = np.tile(np.append(shares, 1.0), (2, 1))
    return np.column_stack([*columns, rest]).astype(np.float64)


def tidy(labels: DataFrame) -> DataFrame:
    """``id, low, toxic``, one row per id."""
    flag = lambda c: F.when(c.isNotNull(), (c != 0).cast("int"))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        (1 - F.min(flag(F.col("quality")))).alias("low"), F.max(flag(F.col("toxic"))).alias("toxic")
    )


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> Model | None:
    """The document classifier; ``docs`` has ``id`` and ``text``, ``labels`` is from ``tidy``."""
    spark = docs.sparkSession
    kind = F.col("low") * 2 + F.col("toxic")
    known = labels.filter("low is not null and toxic is not null").select("id", kind.alias("kind"))
    totals = {r[0]: r[1] for r in known.groupBy("kind").count().collect()}
    everyone = sum(totals.values())
    picked = [
        known.filter(F.col("kind") == k).orderBy(F.xxhash64("id"), "id").limit(per_kind) for k in range(4)
    ]
    sample = picked[0]
    for part in picked[1:]:
        sample = sample.union(part)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(2)).cast("int")
    # at most 4 * per_kind rows
    rows = docs.join(F.broadcast(save(sample.withColumn("fold", fold))), "id").select("text", "kind", "fold")
    size = 1 << FEATURE_BITS

    def count(batches):
        counts = np.zeros((4, size + 1), np.int64)
        for texts in W.runs(batches, "text"):
            kinds = W.cell(texts, "kind").to_numpy()
            for slots, k in zip(features(texts)[0], kinds):
                counts[k, slots] += 1
                counts[k, size] += 1
        yield pa.RecordBatch.from_arrays([pa.array([pack(counts)], pa.binary())], ["blob"])

    blobs = rows.filter("fold = 0").select("text", "kind").mapInArrow(count, "blob binary")
    zero = np.zeros(4 * (size + 1), np.int64)
    counts = tree_combine(blobs, "blob", np.int64, np.add, zero).reshape(4, size + 1)
    weights = np.zeros((2, size), np.float32)
    for target, (bad, good) in enumerate((((2, 3), (0, 1)), ((1, 3), (0, 2)))):
        b, g = counts[list(bad)].sum(axis=0), counts[list(good)].sum(axis=0)
        if b[-1] and g[-1]:
            weight = np.log((b[:-1] + 0.5) / (b[-1] + 1)) - np.log((g[:-1] + 0.5) / (g[-1] + 1))
            error = 1 / (b[:-1] + 0.5) + 1 / (g[:-1] + 0.5)
            shrink = np.maximum(0, 1 - ERRORS**2 * error / np.maximum(weight**2, 1e-12))
            weights[target] = weight * shrink
    sent = spark.sparkContext.broadcast(weights)

    def values(batches):
        for texts in W.runs(batches, "text"):
            found = [inputs(sent.value, *x).ravel().tolist() for x in zip(*features(texts))]
            yield pa.RecordBatch.from_arrays(
                [W.cell(texts, "kind"), pa.array(found, pa.list_(pa.float64()))], ["kind", "x"]
            )

    held = rows.filter("fold = 1").select("text", "kind")
    held = held.mapInArrow(values, "kind int, x array<double>").collect()  # at most 4 * per_kind rows
    slope = np.zeros((2, SHARES + 4))
    slope[:, -1] = -20.0
    for target, bad in enumerate(((2, 3), (1, 3))):
        y = np.array([r.kind in bad for r in held], float)
        if y.any() and not y.all():
            x = np.array([r.x for r in held]).reshape(len(held), 2, -1)[:, target]
            slope[target] = calibrate(x, y)
            rate = sum(totals.get(k, 0) for k in bad) / everyone
            slope[target, -1] += logit(rate) - logit(y.mean())
    return Model(weights, slope) if everyone else None


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of a logistic fit (the last column of ``x`` is 1), by Newton steps with a little ridge."""
    mean, unit = x.mean(axis=0), x.std(axis=0)
    unit[unit == 0] = 1.0
    table = (x - mean) / unit
    table[:, -1] = 1.0
    theta = np.zeros(x.shape[1])
    theta[-1] = logit(y.mean())
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(table @ theta, -30, 30)))
        slope = table.T @ (y - p) - 0.1 * theta
        curve = (table * (p * (1 - p))[:, None]).T @ table + 0.1 * np.eye(len(theta))
        theta = theta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    out = theta / unit
    out[-1] = theta[-1] - (theta[:-1] * mean[:-1] / unit[:-1]).sum()
    return out


def shrunk(bad: Column, n: Column, towards: Column, strength: Column) -> Column:
    """Posterior mean of a rate with a Beta prior of mean ``towards``."""
    return (bad + strength * towards) / (n + strength)


def strength_of(sites: DataFrame, bad: str, n: str, towards: Column) -> float:
    """Prior strength by moments: how much rates differ beyond their sampling error."""
    expected = towards * (1 - towards)
    row = sites.filter(F.col(n) > 0).agg(
        F.sum((F.col(bad) - F.col(n) * towards) ** 2 - F.col(n) * expected).alias("excess"),
        F.sum(F.col(n) * (F.col(n) - 1)).alias("pairs"),
        F.avg(expected).alias("spread"),
    ).first()
    if not row.pairs or row.excess is None or row.excess <= 0 or not row.spread:
        return 1e6
    return float(min(max(row.spread / (row.excess / row.pairs) - 1, 1.0), 1e6))


def sites(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, path, low_shift, toxic_shift``: what a site adds to the log-odds of its documents.

    ``docs`` has ``id, host, path``; all labels count, summed by site before anything is joined.
    """
    seen = docs.select("id", "host", "path").join(labels, "id")
    paths = save(
        seen.groupBy("host", "path").agg(
            *[F.count(t).alias(f"{t}_n") for t in TARGETS],
            *[F.coalesce(F.sum(t), F.lit(0)).alias(f"{t}_bad") for t in TARGETS],
        )
    )
    sums = [F.sum(c).alias(c) for t in TARGETS for c in (f"{t}_n", f"{t}_bad")]
    hosts, world = paths.groupBy("host").agg(*sums), paths.agg(*sums).first()
    for t in TARGETS:
        rate = (world[f"{t}_bad"] or 0) / world[f"{t}_n"] if world[f"{t}_n"] else 0.5
        strength = strength_of(hosts, f"{t}_bad", f"{t}_n", F.lit(rate))
        mean = shrunk(F.col(f"{t}_bad"), F.col(f"{t}_n"), F.lit(rate), F.lit(strength))
        hosts = hosts.withColumn(f"{t}_host", mean)
    joined = save(paths.join(hosts.select("host", *[f"{t}_host" for t in TARGETS]), "host"))
    out = joined
    for t in TARGETS:
        rate = (world[f"{t}_bad"] or 0) / world[f"{t}_n"] if world[f"{t}_n"] else 0.5
        strength = strength_of(joined, f"{t}_bad", f"{t}_n", F.col(f"{t}_host"))
        mean = shrunk(F.col(f"{t}_bad"), F.col(f"{t}_n"), F.col(f"{t}_host"), F.lit(strength))
        mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn(f"{t}_shift", F.log(mean / (1 - mean)) - F.lit(logit(rate)))
    return save(out.select("host", "path", *[f"{t}_shift" for t in TARGETS]))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    per_kind: int = SAMPLE_PER_KIND,
) -> DataFrame:
    """``id, key, host, path, low_evidence, toxic_evidence, p_low, p_toxic, keep`` per row."""
    prepare(docs)
    named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))
    docs = docs.select(
        F.col(id_col).alias("id"),
        row_key(id_col, text_col).alias("key"),
        F.col(text_col).alias("text"),
        named(host_col).alias("host"),
        F.concat(named(host_col), F.lit("/"), named(path_col)).alias("path"),
    )
    labels = save(tidy(labels))
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_kind))
    places = sites(docs, labels)

    def score(batches):
        for texts in W.runs(batches, "text"):
            model = sent.value
            odds = np.full((len(texts.starts), 2), -20.0)
            if model is not None:
                odds = np.array([model.log_odds(*x) for x in zip(*features(texts))])
            kept = [W.cell(texts, c) for c in ("id", "key", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(odds[:, 0]), pa.array(odds[:, 1])],
                ["id", "key", "host", "path", "low_evidence", "toxic_evidence"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key long, host string, path string, low_evidence double, toxic_evidence double"
    scored = docs.mapInArrow(score, schema).join(places, ["host", "path"], "left")
    chance = lambda t: 1 / (
        1 + F.exp(-(F.col(f"{t}_evidence") + F.coalesce(f"{t}_shift", F.lit(0.0))))
    )
    return scored.select(
        "id",
        "key",
        F.expr("nullif(host, 'null')").substr(2, 1 << 30).alias("host"),
        "path",
        *[f"{t}_evidence" for t in TARGETS],
        *[chance(t).alias(f"p_{t}") for t in TARGETS],
    ).withColumn("keep", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier keeps."""
    gone = save(classify(docs, labels, **options).filter("not keep").select("key").distinct())
    return without(docs, row_key("doc_id", "text"), gone)
