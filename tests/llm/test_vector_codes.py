"""Vector codes against plain whole-number arithmetic, and the tree against all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from forgelens.llm.centroids import squared
from forgelens.llm.vector_codes import Gnat, compress_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, _label string, _v string, _of string"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = []
    for vec_id, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(c))) for c in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((gap(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors: dict = {}
    for (_, _, label), f in zip(kept, found):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    return sorted(
        [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label], sha)
         for (i, _, label), f in zip(kept, found)], key=str,
    )


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "c", "e", "l", "v", "o") for r in rows], SCHEMA).repartition(3)
    found = compress_vectors(frame, **options)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_against_plain_arithmetic_with_odd_rows(spark):
    rng = random.Random(1)
    vector = lambda: [rng.gauss(0, 0.1) for _ in range(64)]
    rows = [(i, vector(), None if i % 3 == 0 else i % 5) for i in range(260)]
    rows += [(400, None, 1), (-1, [], 1), (402, [0.5] * 63, 1), (403, [0.5] * 32, 1), (404, [None] + [0.0] * 63, 2),
             (405, [float("nan")] * 64, 2), (406, [float("-inf")] + [0.0] * 63, 2), (407, [0.0] * 64, 7),
             (None, [0.1] * 64, 2), (None, [0.2] * 64, None), (3, rows[5][1], 1), (7, rows[7][1], 1)]
    rows += [(1000 + i, rows[0][1], 9) for i in range(140)]  # one vector and label in a third of all rows
    assert run(spark, rows) == plain(rows)


def test_ties_few_and_no_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0, 0.5], 1) for i in range(30)]
    assert run(spark, rows, parts=2, entries=7, scale=4) == plain(rows, parts=2, entries=7, scale=4)
    few = [(5, [0.25] * 16, 1), (4, [-0.26] * 16, None)]
    assert run(spark, few) == plain(few)
    assert run(spark, []) == [] and run(spark, [(1, None, 1), (2, [0.0] * 3, 1)]) == []
    huge = run(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], entries=1)
    assert huge[0][2] > 0 and huge[0][3] == 2 * huge[0][2]
    with pytest.raises(ValueError):
        run(spark, few, entries=257)


@pytest.mark.parametrize("spread", [2, 5, 1000])
def test_tree_finds_the_first_nearest_entry_and_skips_subtrees(spread):
    """With a small spread most distances are ties."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 12, 13, 64, 256):
        entries = rng.integers(-spread, spread + 1, (n, 4))
        rows = np.concatenate([rng.integers(-spread, spread + 1, (500, 4)), entries])
        label, best, compared = Gnat(entries).nearest(rows)
        exact = np.stack([squared(rows, e) for e in entries], axis=1)
        assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        if spread == 1000 and n == 256:
            assert compared < 0.7 * exact.size


def test_tree_of_equal_entries():
    entries = np.zeros((40, 4), np.int64)
    label, best, _ = Gnat(entries).nearest(np.ones((3, 4), np.int64))
    assert label.tolist() == [0, 0, 0] and best.tolist() == [4, 4, 4]
