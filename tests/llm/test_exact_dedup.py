"""Exact duplicates: fingerprints, groups and the rows that stay."""

import hashlib
import random

import numpy as np
import pytest

from forgelens.llm import exact_dedup
from forgelens.llm.exact_dedup import BASES, CHUNK, PRIME, combine, exact_duplicates, fingerprint
from forgelens.llm.stages import keep_distinct

SCHEMA = "doc_id bigint, text string, n_bytes string, fp_a string, _row string, kept string"


def plain(data: bytes) -> tuple:
    out = [0] * len(BASES)
    for byte in data:
        out = [(h * b + byte) % PRIME for h, b in zip(out, BASES)]
    return tuple(out)


@pytest.mark.parametrize("n", [0, 1, 7, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 5])
def test_fingerprint_is_the_polynomial(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    assert fingerprint(data) == plain(data)
    at = n // 3
    assert combine(fingerprint(data[:at]), fingerprint(data[at:]), n - at) == plain(data)


def rows():
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(32, 900)) for _ in range(70000))
    texts = [None, "", "", " ", "a", "A", "a", "a ", long, long, long[:-1] + "~", "é", "é"] + ["copy"] * 300
    made = list(enumerate(texts)) + [(4, "a"), (4, "a"), (4, "other"), (None, "a"), (None, "null only"), (None, "null only")]
    rng.shuffle(made)
    return made


def frame(spark, made):
    return spark.createDataFrame([(k, t, "n", "f", "r", "k") for k, t in made], SCHEMA).repartition(4)


def check(found, made):
    groups: dict = {}
    for key, text in made:
        groups.setdefault(text or "", []).append(key)
    got = found.collect()
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert len(got) == len(made)
    by_sha: dict = {}
    for row in got:
        by_sha.setdefault(row.text_sha256, []).append(row)
    assert len(by_sha) == len(groups)
    for text, keys in groups.items():
        own = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        last = max((k for k in keys if k is not None), default=None)
        assert sorted(map(str, keys)) == sorted(str(r.doc_id) for r in own)
        assert all(r.keep_id == last and r.group_size == len(keys) for r in own)
        assert [r.doc_id for r in own if r.kept] == [last]


def test_groups(spark):
    check(exact_duplicates(frame(spark, rows())), rows())


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With one fingerprint for all texts of a length, their comparison decides."""
    monkeypatch.setattr(exact_dedup, "_key", lambda data: (1, 2, len(data)))
    check(exact_duplicates(frame(spark, rows())), rows())


def test_rows_that_stay_keep_their_columns(spark):
    made = rows()
    kept = keep_distinct(frame(spark, made))
    assert kept.columns == ["doc_id", "text", "n_bytes", "fp_a", "_row", "kept"]
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    groups: dict = {}
    for key, text in made:
        groups.setdefault(text or "", []).append(key)
    assert got == sorted((str(max((k for k in ks if k is not None), default=None)), t) for t, ks in groups.items())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_duplicates(empty).count() == 0
    assert keep_distinct(empty).count() == 0
