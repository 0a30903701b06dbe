"""The n-gram Jaccard join against all pairs."""

import os
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from forgelens.llm import jaccard
from forgelens.llm.components import components
from forgelens.llm.jaccard import near_duplicates
from forgelens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, n bigint, row bigint, component string, key string, keys string"


def shingles(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def expected(rows):
    """[(id, n, component id)] by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common: dict = {}
        for x in s:
            for j in lists[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    groups: dict = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def result(frame):
    found = near_duplicates(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "first"]
    rows = found.collect()
    firsts = [(r.component_id, r.n_shingles) for r in rows if r["first"]]
    assert all(r["first"] for r in rows if r.n_shingles == 0)
    alive = [c for c, n in firsts if n]
    assert len(alive) == len(set(alive))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words)


def made_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "É é"), (8, "é É"),
            (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "alone"), (10, "x\x1cy \x85 z")]
    passage = " ".join(f"p{i}" for i in range(60))
    key = 100
    for size in (5, 6, 9, 10, 14, 20, 30, 40, 64, 70, 90, 300):
        words = [f"w{size}_{i}" for i in range(size)]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1):
            rows.append((key, edited(rng, words, share)))
            key += 1
        for cut in range(1, 4):  # overlaps near the threshold
            rows.append((key, " ".join(words[:-cut])))
            rows.append((key + 1, " ".join(words[cut:] + [f"t{i}" for i in range(cut)])))
            key += 2
    for i in range(60):  # a shared passage in otherwise different texts
        own = " ".join(f"o{i}_{j}" for j in range(rng.choice([4, 6, 10, 40])))
        rows.append((key, f"{own} {passage}"))
        key += 1
    base = [f"g{i}" for i in range(120)]
    for _ in range(80):  # a group of near copies, some of which link only by way of others
        rows.append((key, edited(rng, base, rng.choice([0.005, 0.01, 0.02]))))
        key += 1
    rows.append((key, " ".join(f"long{i % 977}" for i in range(20000))))
    for i, (a, b) in enumerate([("x" * 300, "y"), ("X" * 300, "y"), ("x" * 299 + "z", "y"), ("xz" + "x" * 298, "y")]):
        rows.append((key + 1 + i, f"{a} {b} " * 3 + "\t" * 400 + "end"))  # words that are hashed alone
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 64])
def test_links_equal_all_pairs(spark, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sets: boundary)
    rows = made_rows()
    frame = spark.createDataFrame([(k, t, 0, 0, "c", "k", "ks") for k, t in rows], SCHEMA).repartition(5)
    assert result(frame) == expected(rows)


@pytest.mark.parametrize("boundary", [4, 9, 14, 63, 64])
def test_links_across_the_boundary(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sets: boundary)
    rows = []
    for n, m in [(4, 5), (8, 10), (12, 15), (52, 65)]:  # the smaller set lies in the larger one, Jaccard 0.8
        for cut in range(m - n + 1):
            words = [f"w{n}_{cut}_{i}" for i in range(m + 4)]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(words[cut : cut + n + 4])))
    found = result(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found == expected(rows)
    assert all(component == key - key % 2 for key, _, component in found)


def test_cost_counts_the_sets_in_both_kinds_of_list(spark):
    # sets of 3 stand in pair lists alone from boundary 3 on
    assert jaccard.choose_boundary(spark.createDataFrame([(3, 1000)], "n bigint, weight bigint")) == 3


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    rng = random.Random(5)
    names = list(range(2000))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in chain + star]
    got = dict(components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    one, two = min(names[:301]), min(names[1000:1500])
    assert got == {names[i]: one for i in range(301)} | {names[i]: two for i in range(1000, 1500)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op8_ngram_jaccard"](spark, SF_DIR).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected(docs)


def test_levels_grow_with_counts_at_every_size():
    for chance in (8, 300, 10**6):
        counts = chance + np.array([0, 1, 4, 100, 10**4, 10**6, 10**9], np.uint64)
        levels = jaccard.slot_levels(counts, chance)
        assert levels[0] == 0 and all(np.diff(levels.astype(int)) > 0)
    assert jaccard.slot_levels(np.array([2**63], np.uint64), 8)[0] == 255


def test_frequent_shingles_are_told_apart_where_every_slot_is_full(spark, monkeypatch):
    """Slots hold thousands of shingles each; passages of 400 and 4,000 texts still differ."""
    monkeypatch.setattr(jaccard, "SLOTS_BITS", 8)
    rng = random.Random(3)
    often, more = "one two three four five", "six seven eight nine ten"
    texts = [" ".join(str(rng.random()) for _ in range(100)) for _ in range(5000)]
    texts += [often] * 400 + [more] * 4000 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    levels, frequency = jaccard.frequency_sketch(docs, "text")
    slots = [int(next(jaccard.shingle_hashes([t]))[0] >> np.uint64(56)) for t in (often, more)]
    assert np.median(levels) == 0 and 0 < levels[slots[0]] < levels[slots[1]]
    assert frequency[levels[slots[1]]] > frequency[levels[slots[0]]] > frequency[0] > 1500
    monkeypatch.setattr(jaccard, "TEXTS", 100)  # counters handed on in between
    assert (jaccard.frequency_sketch(docs, "text")[0] == levels).all()


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(400):
        pool = rng.integers(0, 1 << 64, 900, np.uint64, endpoint=False)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 700))) for _ in range(2))
        assert jaccard.apart(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.parity(a), jaccard.parity(a)) == 0


def test_last_join_makes_every_pair_and_few_of_them_twice(spark):
    """Random sets in lists: with and without the look at earlier lists the same pairs meet."""
    rng = np.random.default_rng(5)
    rows = []
    for row in range(60):
        keys = rng.choice(40, 12, replace=False).tolist() if row % 3 else list(range(row % 2, 12 + row % 2))
        rows += [(k, row, 100, 100 - i // 2) for i, k in enumerate(sorted(keys))]
    postings = jaccard._with_earlier(spark.createDataFrame(rows, "key bigint, row bigint, n bigint, rest bigint"))
    x, y = postings.alias("x"), postings.alias("y")
    met = x.join(y, "key").where("x.row < y.row").where(jaccard._possible("x", "y"))
    pairs = [tuple(r) for r in met.select("x.row", "y.row").collect()]
    fewer = [tuple(r) for r in met.where(~jaccard._met_earlier("x", "y")).select("x.row", "y.row").collect()]
    assert set(fewer) == set(pairs)
    assert len(fewer) < len(pairs) / 2


def test_short_parities_lose_no_link_and_leave_out_most_pairs(spark):
    """Near copies of one text that are not linked are left out before their pair is made."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    sets = []
    for i in range(60):
        kept = rng.choice(base, 150 - int(rng.integers(0, 60)), replace=False)
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, 150 - len(kept), dtype=np.uint64)])))
    words = [np.frombuffer(jaccard.parity(h, 64 * jaccard.WORDS), np.int64).tolist() for h in sets]
    names = ", ".join(f"word_{i} bigint" for i in range(jaccard.WORDS))
    frame = spark.createDataFrame([(i, len(h), *w) for i, (h, w) in enumerate(zip(sets, words))], f"row int, n int, {names}")
    x, y = frame.alias("x"), frame.alias("y")
    pairs = x.join(y, (F.col("x.row") < F.col("y.row")) & jaccard._close("x", "y")).select("x.row", "y.row").collect()
    close = {tuple(p) for p in pairs}
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard.similar(sets[i], sets[j])}
    assert linked and linked <= close
    assert len(close) < 2 * len(linked) < 60 * 59 / 2
