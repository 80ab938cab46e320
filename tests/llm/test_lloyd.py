"""Clustering against plain whole-number Lloyd, and the trees' bounds."""

import hashlib
import math
import random

import numpy as np

from factloom.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia string"


def whole(x, scale):
    return math.floor(x * scale) if abs(x) < 1e290 else int(x) * scale


def plain(rows, k, rounds, scale, dims):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [whole(x, scale) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [[whole(x, scale) for x in v] for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in q:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in q]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    held = lambda x: x if x < 1 << 63 else None
    one = lambda c: None if any(held(d) is None for _, j, d in found if j == c) else held(inertia[c])
    every = None if any(held(d) is None for _, _, d in found) else held(sum(inertia.values()))
    return [(i, c, held(d), one(c), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def agree(spark, rows, k=7, rounds=4, scale=16, dims=3):
    docs = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in lloyd.clustered(docs, k, rounds, scale, dims).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, plain(rows, k, rounds, scale, dims)))
    return got


def test_agrees_with_plain_rounds(spark):
    rng = random.Random(3)
    near = lambda c: [x + rng.gauss(0, 0.3) for x in c]
    centres = [[rng.uniform(-9, 9) for _ in range(3)] for _ in range(9)]
    rows = [(i, near(rng.choice(centres))) for i in range(700)]
    rows += [(700, None), (701, []), (702, [1.0, 2.0]), (703, [1.0, None, 2.0]), (704, [math.nan, 0.0, 0.0]), (705, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (706, [-0.0, -1e-9, 1e-9])]
    rows += [rows[5], rows[5], (5, [9.0, 9.0, 9.0])]
    # ties: many vectors in the middle between others
    rows += [(1000 + i, [float(i % 3), float(i % 2), 0.0]) for i in range(60)]
    agree(spark, rows)


def test_all_equal_vectors_and_fewer_than_k(spark):
    agree(spark, [(i, [1.0, 2.0, 3.0]) for i in range(50)])
    agree(spark, [(i, [float(i), 0.0, 0.0]) for i in range(3)])
    agree(spark, [(1, None)])
    agree(spark, [])


def test_components_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-5, 5) for _ in range(3)]) for i in range(80)]
    agree(spark, rows + [(900, [3e306, 1.0, 1.0]), (901, [-3e306, 1.0, 1.0]), (902, [1e9, -1e9, 0.5]), (903, [2.0**40, 0.0, 0.0]), (904, [float(2**22) + 1, 0.0, 0.0])])
    agree(spark, [(i, [rng.uniform(1e8, 2e8), rng.uniform(-1e30, 1e30), 0.0]) for i in range(40)])
    # centroids in between: some beyond what longs hold when squared
    agree(spark, rows + [(1000 + i, [rng.uniform(0, 2**23), 0.0, 0.0]) for i in range(60)])


def test_trees_cover_and_prune():
    rng = np.random.default_rng(5)
    points = (rng.normal(0, 40, (12, 64))[rng.integers(0, 12, 1000)] * 10 + rng.normal(0, 9, (1000, 64))).astype(np.int64)
    tree = lloyd.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(1000))
    ordered = points[tree.order].astype(float)
    for (lo, hi, child, last), radius in zip(tree.nodes.tolist(), tree.radius.tolist(), strict=True):
        assert np.sqrt(((ordered[lo:hi] - ordered[lo]) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if child < last:
            parts = tree.nodes[child:last, :2].tolist()
            assert parts[0][0] == lo and parts[-1][1] == hi and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    centroids = lloyd.Centroids(points[:40].tolist())
    cluster, square, compared = centroids.nearest(points[tree.order], tree, True)
    every = ((points[tree.order][:, None] - points[None, :40]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    assert compared < 1000 * 40 / 3
