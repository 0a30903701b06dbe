"""The pipeline: each stage against a plain version, and all of them in a row."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from forgelens.llm import stages
from forgelens.llm.lang_id import fit_dictionaries, held_out
from forgelens.llm.packing import binary_pieces

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, row bigint, _sha string"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def rows():
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("em", "um", "or", "et")]
    made = []
    for i in range(80):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(20, 60)))
        made.append((i, text, "la", rng.choice(["a", "a", "a", "b", None])))
    made += [(100 + i, made[i][1], "la", "c") for i in range(10)]  # exact copies
    made += [(200 + i, made[i][1] + " extra", "la", "b") for i in range(20, 30)]  # near copies
    made += [(300, None, "la", "a"), (301, "", "la", "a"), (302, "123 456", None, "a"), (None, made[0][1], "la", None)]
    made += [made[3]] * 3 + [(3, "another text with the same number " * 5, "la", "a")]
    return [(k, t, lang, s, len(t or ""), "x", 1, "y") for k, t, lang, s in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_stages_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixing", "packing"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    out = stage(spark, docs, SF_DIR)
    if name != "packing":
        assert out.schema.names == docs.schema.names
        assert not Counter(map(str, out.distinct().collect())) - Counter(map(str, set(docs.collect())))
    assert out.count() > 0


def kept(frame):
    return Counter((str(r.doc_id), r.text) for r in frame.collect())


def test_language_stage_keeps_texts_with_letters(spark, docs):
    got = kept(stages.keep_identified(docs))
    assert got == Counter((str(r[0]), r[1]) for r in rows() if r[1] and any(map(str.isalpha, r[1])))


def test_exact_stage_keeps_the_largest_id(spark, docs):
    best: dict = {}
    for r in rows():
        own = best.setdefault(r[1] or "", r)
        if own[0] is None or (r[0] is not None and r[0] > own[0]):
            best[r[1] or ""] = r
    got = kept(stages.keep_distinct(docs))
    assert sorted((k, t or "") for k, t in got) == sorted((str(r[0]), t) for t, r in best.items())
    assert set(got.values()) == {1}


def test_near_stage_keeps_one_of_each_group(spark, docs):
    got = kept(stages.keep_one_of_group(docs))
    texts = Counter(t for _, t in got.elements())
    for i in range(20, 30):
        assert (str(i), rows()[i][1]) in got and (str(200 + i), rows()[i][1] + " extra") not in got
    assert all(n == 1 for t, n in texts.items() if t and t.strip())
    assert got[("300", None)] == 1 and got[("301", "")] == 1


def test_mixing_stage_reads_by_weight(spark, docs):
    got = stages.read_in_mixture(docs)
    mixed = stages.temperature_mix(docs)
    assert got.count() == mixed.count()
    assert Counter(str(r.doc_id) for r in got.collect()) == Counter(str(r.doc_id) for r in mixed.collect())


def test_packing_stage(spark, docs):
    library = Tokenizer.from_file(stages.BYTE_BPE)
    expected: Counter = Counter()
    for r in rows():
        ids, at = library.encode(r[1] or "", add_special_tokens=False).ids + [0], 0
        for n in binary_pieces(len(ids), 1024):
            crc = zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            expected[(str(r[0]), at, n, crc, len(ids))] += 1
            at += n
    got = stages.packed(docs).collect()
    assert Counter((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected


@needs_tables
def test_run_is_the_stages_in_a_row(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frame = table
    counts = [frame.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, SF_DIR).collect(), table.schema)
        counts.append(frame.count())
    assert counts[1] >= 0.95 * counts[0] and counts[3] <= counts[2] <= counts[1]
    assert fit_dictionaries(table.where(~held_out()))
    want = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages.packed(frame).collect())
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_map_columns(spark, docs, name, stage):
    mapped = docs.selectExpr("*", "map('k', doc_id, 'n', null) as meta", "map(struct(1, 2), array(map(1, 2))) as odd")
    out = stage(spark, mapped.limit(60), SF_DIR)
    assert out.count() > 0 and (name == "packing" or out.schema == mapped.schema)
