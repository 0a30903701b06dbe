"""Scaled sketches and the fingerprints of edited texts."""

import hashlib
import random

import numpy as np
import pytest

from forgelens.llm.fingerprint import (
    LEAST, SCALE, SHINGLE, _kept, containment, edited_text, fingerprint_with_edits, from_text, merge, sketch, shingle_hashes, to_text,
)

SCHEMA = "doc_id bigint, text string, n_chars string, fingerprint string, _n string, _to string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_sketch_is_every_hash_below_the_bound():
    data = words(random.Random(0), 3000).encode()
    hashes = shingle_hashes(data)
    assert len(hashes) == len(data) - SHINGLE + 1
    assert sketch(data).tolist() == sorted({h for h in hashes.tolist() if h < 2**64 // SCALE})
    assert 0.8 < len(sketch(data)) * SCALE / len(set(hashes.tolist())) < 1.2
    again = shingle_hashes(data[100:])
    assert again.tolist() == hashes[100:].tolist()  # a shingle's hash is its own
    assert from_text(to_text(sketch(data))).tolist() == sketch(data).tolist()


def test_merge_and_containment_of_unequal_documents():
    rng = random.Random(1)
    small, large = words(rng, 800), words(rng, 20000)
    both = f"{large} {small}".encode()
    a, b = sketch(small.encode()), sketch(large.encode())
    union = merge(a, b)
    assert set(union.tolist()) <= set(sketch(both).tolist())
    assert containment(a, sketch(both)) > 0.97
    assert containment(b, a) < 0.02
    assert containment(np.zeros(0, np.uint64), a) is None


def expected(made, scale=SCALE):
    least = -(1 << 63)
    order = sorted(made, key=lambda r: (r[0] if r[0] is not None else least, (r[1] or "").encode()), reverse=True)
    out = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = edited_text(text, following)
        a, e, n = (sketch(t.encode(), scale) for t in (text, edited, following))
        like = lambda o, same: 1.0 if same else (containment(a, o) or 0.0)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(a), to_text(e),
                    like(e, edited == text), like(n, following == text)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    made = [(i * 3, words(rng, rng.randrange(1, 300))) for i in range(120)]
    made += [(1, None), (2, ""), (4, "ab"), (5, "é😀éx"), (7, "long " * 20000), (8, made[3][1]), (8, made[3][1])]
    made += [(2**62, "top"), (-5, "below"), (None, "none"), (None, None), (9, "x"), (9, "y")]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_edits_follow_the_order_of_ids(spark, partitions):
    made = rows()
    frame = spark.createDataFrame([(k, t, "n", "f", "m", "o") for k, t in made], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = fingerprint_with_edits(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == expected(made)


def test_likeness_is_near_exact_containment(spark):
    rng = random.Random(11)
    # standard deviation of the error that is allowed, by bytes of the text
    allowed = {20: 0.25, 44: 0.2, 100: 0.1, 400: 0.05, 1500: 0.03, 4000: 0.02}
    texts, size_of = [], {}
    for size in allowed:
        for _ in range(60):
            text = words(rng, size)[:size]
            for near in (text, text[: size * 3 // 4] + words(rng, size)[: size // 4]):
                size_of[len(texts)] = size
                texts.append(near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprint_with_edits(docs).collect()}
    errors: dict = {size: [] for size in allowed}
    for i, text in enumerate(texts):
        following = texts[i - 1]
        pairs = ((got[i].near_edited, edited_text(text, following)), (got[i].near_next, following))
        a = set(shingle_hashes(text.encode()).tolist())
        for near, other in pairs:
            exact = len(a & set(shingle_hashes(other.encode()).tolist())) / len(a)
            errors[size_of[i]].append(near - exact)
    # no text of any length shares its fingerprint with another, or with an empty one
    assert all(r.fingerprint for r in got.values())
    assert len({r.fingerprint for r in got.values()}) == len(set(texts))
    for size, bound in allowed.items():
        assert np.sqrt(np.mean(np.square(errors[size]))) < bound, size


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    (row,) = fingerprint_with_edits(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fingerprint_with_edits(one.limit(0)).count() == 0


def test_merge_is_the_sketch_of_the_union():
    rng = random.Random(21)
    for n in (1, 5, 9, 20, 300):
        for m in (1, 7, 40, 2000):
            a, b = (rng.randbytes(k + SHINGLE - 1) for k in (n, m))
            joined = np.union1d(shingle_hashes(a), shingle_hashes(b))
            assert merge(sketch(a), sketch(b)).tolist() == _kept(joined, SCALE).tolist()
            assert containment(sketch(a), sketch(a)) == 1.0 and len(sketch(a)) >= min(n, LEAST)


def test_scale_one_keeps_all():
    data = b"some text of some length"
    assert len(sketch(data, 1)) >= len(set(shingle_hashes(data).tolist())) - 1
