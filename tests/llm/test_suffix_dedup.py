"""Removal of repeated strings against a table of all of them."""

import hashlib
import os
import random

import pytest

from forgelens.llm.queries import QUERIES
from forgelens.llm.suffix_dedup import remove_repeats

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, pos bigint, g string, runs string, _doc string"


def expected(rows, length=100):
    """[(id, n_bytes, n_removed, n_spans, sha)], rows in the order that counts."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(found):
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def words(rng, n, k=10**6):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def made():
    rng = random.Random(11)
    passage, line = words(rng, 60), words(rng, 15)
    long = words(rng, 400)
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 1000, "ab" * 300, "abc" * 200 + "é" * 150,
             long, long, long[:500] + "!" + long[501:], long[37:900], "é" + long[:-3], passage]
    for i in range(60):
        cut = rng.randrange(0, 150)
        texts.append(f"{words(rng, rng.randrange(60))} {passage[cut : cut + rng.randrange(90, 400)]}{words(rng, 5)}")
        texts.append(f"{words(rng, 8, 40)}\n{line}\n{words(rng, 30, 12)}\n{line}")
    for _ in range(40):  # lengths around the threshold
        at, n = rng.randrange(len(long) - 110), rng.randrange(96, 106)
        texts.append(f"{words(rng, 3)}#{long[at : at + n]}#{words(rng, 3)}")
    rng.shuffle(texts)
    return [(7 * i - 50, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "g", "r", "d") for k, t in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("batch", [10000, 7])
def test_equals_table_of_all_strings(spark, batch):
    rows = made()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert got(remove_repeats(frame(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_and_null_ids(spark):
    rows = made()[:40]
    mixed = [(k % 5 if k % 7 else None, t) for k, t in rows] + rows[:3] + rows[:3]
    order = sorted(mixed, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    assert got(remove_repeats(frame(spark, mixed))) == expected(order)


def test_other_length_and_spans(spark):
    rows = made()
    found = remove_repeats(frame(spark, rows), 64)
    assert got(found) == expected(rows, 64)
    for row in found.collect():
        assert row.n_removed == sum(s.end - s.begin for s in row.spans)


def test_empty_table(spark):
    assert got(remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"))) == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_equals_table_of_all_strings(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").select("doc_id", "text")
    assert got(QUERIES["op3_suffix_dedup"](spark, SF_DIR)) == expected(map(tuple, docs.collect()))


def test_ids_that_are_no_numbers(spark):
    passage = "a passage that stands in two documents " * 4
    docs = spark.createDataFrame([("b", f"x{passage}"), ("a", f"{passage}y"), ("c", "short"), (None, passage)], "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
    assert got["a"] < len(passage) and got["b"] >= len(passage) and got["c"] == 0 and got[None] == len(passage)
