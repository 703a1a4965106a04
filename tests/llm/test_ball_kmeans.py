import hashlib
import math
import random

import numpy as np
import pytest

from codeloom.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def plain(rows, k, rounds, width):
    """The contract by all distances in whole numbers."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in named[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, q in kept:
            members.setdefault(near(q)[1], []).append(q)
        centroids = [tuple(sum(x) // len(members[j]) for x in zip(*members[j])) if j in members else c for j, c in enumerate(centroids)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    total = {}
    for _, j, d in out:
        total[j] = total.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for i, j, d in out), key=str)


def got(spark, rows, **how):
    found = ball_kmeans.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    return sorted(map(tuple, found), key=str)


def cloud(n, width, seed, spread=0.05):
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(12, width))
    return [(i, (centres[i % 12] + spread * gen.normal(size=width)).astype(np.float32).tolist(), "x", 1) for i in range(n)]


@pytest.mark.parametrize(("spread", "k"), [(0.05, 40), (1.5, 9)])
def test_equals_all_distances(spark, spread, k):
    rows = cloud(400, 64, 3, spread)
    assert got(spark, rows, k=k) == plain(rows, k, 5, 64)


def test_ties_copies_nulls_and_other_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-2, 3) / 256 for _ in range(4)], None, None) for i in range(300)]  # a small grid: many equal distances and copies
    rows += rows[:40] + [(None, [0.0] * 4, "n", 0), (900, None, "n", 0), (901, [1.0, None, 0.0, 0.0], "n", 0), (902, [float("nan")] * 4, "", 0), (903, [float("inf")] + [0.0] * 3, "", 0), (904, [1.0], "", 0), (905, [], "", 0)]
    for k in (7, 40, 1):
        assert got(spark, rows, k=k, width=4) == plain(rows, k, 5, 4)


def test_few_vectors_and_none(spark):
    rows = cloud(5, 64, 1)
    assert got(spark, rows) == plain(rows, 40, 5, 64)
    for none in ([], [(1, None, "", 0)], [(None, [0.5] * 64, "", 0)]):
        assert got(spark, none) == []


def test_core_and_annuli_spare_comparisons():
    """Of well parted clusters most members lie in the core, and none is compared with all centroids."""
    gen = np.random.default_rng(5)
    centres = gen.integers(-2000, 2000, (40, 64))
    member = np.repeat(np.arange(40), 50)
    vectors = centres[member] + gen.integers(-60, 60, (2000, 64))
    own = ((vectors - centres[member]) ** 2).sum(1)
    now = ball_kmeans.balls(centres, [math.isqrt(int(own[member == i].max())) + 1 for i in range(40)])
    assert sum(len(x) for x in now.neighbours) < 40
    best, least = ball_kmeans.reassign(vectors, member, now)
    assert (best == member).all() and (least == own).all()


def test_a_component_too_large_ends_the_query(spark):
    with pytest.raises(Exception, match="no exact distance"):
        got(spark, [(1, [1e9] + [0.0] * 63, "", 0)])
