"""Hard negatives, exact top-k search and clustering against brute force in plain Python."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellquery.llm import blocks, centroids, negatives, pivots
from conftest import SMALL

KIND = "vec_id long, embedding array<double>, label int, key string, score string, windows int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", 1, 2) for r in rows], KIND)


def odd_rows():
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).round(2).tolist(), int(i % 4)) for i in range(60)]
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (200, rows[4][1], 2)]  # repeated id, equal vectors
    rows += [(300, [0.0] * 8, 0), (301, [], 1), (302, [0.5, 0.25], 1), (400, [1.0] * 12, 3)]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [math.nan] * 8, 1), (600, [math.inf] * 8, 1)]
    rows += [(None, rows[5][1], 1), (None, rows[5][1], 2), (700, rows[6][1], None)]
    rows += [(800, [1e-170] * 8, 2), (801, [1e30] * 8, 2), (900, [-x for x in rows[7][1]], 3)]
    return rows


def tall_rows():
    """Several blocks, clustered, of very different lengths, a third of all rows of one label and vector."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(12, 16))
    made = centres[draw.integers(0, 12, 9000)] + 0.1 * draw.normal(size=(9000, 16))
    made *= draw.choice([0.1, 1, 1, 1, 30], size=(9000, 1))
    made[6000:] = made[6000]
    labels = np.where(np.arange(9000) >= 6000, 1, draw.integers(0, 6, 9000))
    return [(int(i), v.tolist(), int(label)) for i, (v, label) in enumerate(zip(made, labels))]


def whole(row, scale, limit=2**62):
    """Integer components of rows that take part."""
    if row[1] is None or any(x is None or not math.isfinite(x) for x in row[1]):
        return None
    made = [math.floor(scale * x) for x in row[1]]
    return made if sum(x * x for x in made) < limit else None


def scores_of(rows, scale):
    """Usable rows, and the inner products of one of them with all."""
    kept = [(r, whole(r, scale)) for r in rows]
    kept = [(r, v) for r, v in kept if v is not None]
    width = max((len(v) for _, v in kept), default=0)
    data = np.array([v + [0] * (width - len(v)) for _, v in kept], np.int64).reshape(len(kept), width)
    return [r for r, _ in kept], lambda at: (data @ data[at]).tolist()


def by_id(value):
    return (value is None, value or 0)


def top_products(rows, top=10):
    kept, products = scores_of(rows, 1024)
    found = collections.Counter()
    for at, row in enumerate(kept):
        if row[0] is not None and row[0] % 100 == 0:
            scores = products(at)
            order = sorted((k for k in range(len(kept)) if k != at), key=lambda k: (-scores[k], by_id(kept[k][0])))
            found.update((row[0], rank, kept[k][0], scores[k]) for rank, k in enumerate(order[:top], 1))
    return found


@pytest.mark.parametrize("rows", [odd_rows(), tall_rows(), odd_rows()[:3], []], ids=["odd", "tall", "few", "none"])
def test_largest_products(spark, rows):
    found = pivots.largest_products(frame(spark, rows), lambda i: F.pmod(i, F.lit(100)) == 0)
    got = collections.Counter(tuple(r) for r in found.select("query_id", "rank", "id", "score").collect())
    assert got == top_products(rows)


def hard_negatives(rows, positives=5, top=10):
    kept, products = scores_of([r for r in rows if r[2] is not None], 256)
    found = collections.Counter()
    for at, row in enumerate(kept):
        if row[0] is None or row[0] % 100:
            continue
        scores = products(at)
        order = sorted((k for k in range(len(kept)) if k != at), key=lambda k: (-scores[k], by_id(kept[k][0])))
        for good in [k for k in order if kept[k][2] == row[2]][:positives]:
            p = scores[good]
            inside = [k for k in order if kept[k][2] != row[2] and 30 * p <= 100 * scores[k] <= 90 * p]
            found.update((row[0], kept[good][0], rank, kept[k][0], p, scores[k]) for rank, k in enumerate(inside[:top], 1))
    return found


@pytest.mark.parametrize("rows", [odd_rows(), tall_rows(), odd_rows()[:3], []], ids=["odd", "tall", "few", "none"])
def test_hard_negatives(spark, rows):
    found = negatives.hard_negatives(frame(spark, rows), lambda i: F.pmod(i, F.lit(100)) == 0, F.col("label"))
    got = collections.Counter(
        tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    )
    assert got == hard_negatives(rows)


def test_postings_lose_no_pair():
    """Whatever the index omits and the walk prunes, every pair at the threshold comes out."""
    draw = np.random.default_rng(8)
    data, queries = draw.integers(-99, 99, (400, 30)), draw.integers(-99, 99, (50, 30))
    scores = queries @ data.T
    lengths = np.sqrt(blocks.squares(queries))
    for share in (0.2, 0.5, 0.9):
        least = share * scores.max(axis=1).astype(float)
        index = negatives.Postings(data, float((least / lengths).min()))
        assert index.first.max() > 0  # something is omitted
        q, x = index.pairs(queries, least, np.ones(scores.shape, bool))
        wanted = set(zip(*np.nonzero(scores >= least[:, None])))
        assert wanted <= set(zip(q.tolist(), x.tolist())) and len(q) < scores.size


def test_bounds_hold_for_all_rings():
    draw = np.random.default_rng(9)
    data = draw.integers(-3000, 3000, (500, 10))
    around = pivots.Pivots(pivots.spread(data[:40].tolist(), 7))
    distance = around.distances(data)
    for part in range(7):
        place = distance[:, part]
        order = np.argsort(place)
        low, high = place[order[::50]], place[order[49::50]]
        top = np.array([blocks.squares(data[order[k : k + 50]]).max() for k in range(0, 500, 50)])
        most = around.bounds(blocks.squares(data), distance, np.full(10, part), low, high, top)
        real = (data @ data[order].T).reshape(500, 10, 50).max(axis=2)
        assert (most >= real).all()


def clusters(rows, size, count=16, rounds=3):
    kept = [(r[0], v) for r, v in ((r, whole(r, 64)) for r in rows) if v is not None and len(v) == size and max(map(abs, v)) < 2**26]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    middle = [list(v) for _, v in sorted(kept, key=name)[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for k, members in groups.items():
            middle[k] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, square, k in found:
        inertia[k] += square
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return collections.Counter((i, k, square, inertia[k], sum(inertia.values()), sha[k]) for i, square, k in found)


@pytest.mark.parametrize(
    "rows, size", [(odd_rows(), 8), (tall_rows()[::9], 16), (odd_rows()[:3], 8), ([], 8), (odd_rows(), 64)], ids=["odd", "tall", "few", "none", "no size"]
)
def test_clusters(spark, rows, size):
    found, _ = centroids.cluster(frame(spark, rows), size=size)
    columns = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in found.select(*columns).collect()) == clusters(rows, size)


def test_tree_finds_ties():
    draw = np.random.default_rng(10)
    middle = draw.integers(-3, 3, (40, 3))  # many equal and equally near centroids
    vectors = draw.integers(-4, 4, (500, 3))
    chosen, square = centroids.Tree(middle).nearest(vectors)
    away = ((vectors[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (chosen == away.argmin(axis=1)).all() and (square == away.min(axis=1)).all()


def test_registered_vectors_against_brute_force(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in given.collect()]
    found = pivots.largest_products(given, lambda i: F.pmod(i, F.lit(100)) == 0)
    got = collections.Counter(tuple(r) for r in found.select("query_id", "rank", "id", "score").collect())
    assert got == top_products(rows)
