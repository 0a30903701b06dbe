"""Centroid clustering against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np

from forgelens.llm.centroids import Assigner, choose_pivots, cluster_vectors, distances, squared
from forgelens.llm.vectors import LARGEST

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, _v string, _d string, _id string"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            x = [max(-LARGEST, min(LARGEST, math.floor(scale * float(np.float32(c))))) for c in v]
            kept.append((vec_id, x))
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((gap(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == i]
            if members:
                centroids[i] = [sum(c) // len(members) for c in zip(*members)]
    found = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    fits = lambda n: n if n < 1 << 63 else None
    inertia = {i: fits(sum(d for _, c, d in found if c == i)) for i in range(k)}
    total = fits(sum(d for _, _, d in found))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], total, shas[c]) for i, c, d in found), key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, None, "c", "d", "v", "d", "i") for i, v in rows], SCHEMA).repartition(3)
    found = cluster_vectors(frame, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked"]
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


def near(rng, centre):
    return [c + rng.gauss(0, 0.05) for c in centre]


def test_against_plain_arithmetic_with_odd_rows(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, near(rng, centres[i % 9] if i % 3 else centres[0])) for i in range(400)]
    rows += [(400, None), (401, []), (402, [0.0] * 63), (403, [0.0] * 65), (404, [None] + [0.0] * 63),
             (405, [float("nan")] * 64), (406, [float("inf")] + [0.0] * 63), (407, [0.0] * 64), (408, [-0.0] * 64),
             (None, [0.1] * 64), (None, [0.2] * 64), (3, rows[5][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector in a third of all rows
    assert run(spark, rows) == plain(rows)


def test_ties_go_to_the_smaller_number_and_equal_starts_stay_empty(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(40)] + [(100 + i, [0.5] * 4) for i in range(6)]
    got = run(spark, rows, k=5, rounds=2, dims=4, scale=64)
    assert got == plain(rows, k=5, rounds=2, dims=4, scale=64)


def test_few_and_no_vectors_and_the_largest_numbers(spark):
    few = [(1, [1e30, -1e30] * 32), (2, [0.0] * 64), (3, [3e38] * 64)]
    assert run(spark, few) == plain(few)
    many = [(i, [1e30 if i % 2 else -1e30] * 64) for i in range(12)]
    assert run(spark, many, k=1) == plain(many, k=1)  # the sum is no long
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_bounds_are_below_the_distances_and_save_most_of_them(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (16, 64))
    rows = centres[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))
    pivots = choose_pivots(centres)
    assigner = Assigner(centres, pivots)
    cached = distances(rows, pivots)
    exact = np.stack([squared(rows, c) for c in centres], axis=1)
    assert (assigner.bounds(cached) <= np.sqrt(exact)).all()
    label, best, checked = assigner.nearest(rows, cached)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert checked.mean() < 4  # of 16
    # on a line the bound is the distance itself: rounding must not lose a tie
    line = np.arange(-50, 51)[:, None] * np.array([[3, 4]])
    ends = np.array([[-30, -40], [30, 40]])
    label, best, _ = Assigner(ends, ends).nearest(line, distances(line, ends))
    both = np.stack([squared(line, e) for e in ends], axis=1)
    assert (label == both.argmin(axis=1)).all() and label[50] == 0
    assert (best == both.min(axis=1)).all()


def test_pivots_of_equal_points():
    assert len(choose_pivots(np.zeros((5, 3), np.int64))) == 1
    assert len(choose_pivots(np.zeros((0, 3), np.int64))) == 0
