import itertools
import random

import pytest
from pyspark.sql import functions as F

from forgelens.operators import duplication, selection


def _lines(text):
    return {line.strip() for line in text.splitlines() if line.strip()}


def _brute_force(rows, above):
    """All pairs of files above the similarity, one by one."""
    found = {}
    for (r1, p1, a), (r2, p2, b) in itertools.combinations(rows, 2):
        left, right = _lines(a), _lines(b)
        if r1 != r2 or not left or not right:
            continue
        common = len(left & right)
        percent = round(common / min(len(left), len(right)) * 100, 1)
        if percent > above:
            found[(r1, *sorted((p1, p2)))] = (common, percent)
    return found


def _expanded(pairs, files):
    """File pairs that the rows on line sets stand for."""
    members = {}
    for r in duplication.set_members(files).collect():
        members.setdefault((r.repo, r.set_file), []).append(r.path)
    set_of = {(repo, p): ps for (repo, _), ps in members.items() for p in ps}
    found, n_pairs = {}, 0
    for r in pairs.collect():
        left, right = set_of[(r.repo, r.file_a)], set_of[(r.repo, r.file_b)]
        combos = (
            itertools.combinations(left, 2) if left is right else itertools.product(left, right)
        )
        expanded = {(r.repo, *sorted(c)): (r.common_lines, r.similarity_percent) for c in combos}
        assert r.n_pairs == len(expanded)
        assert not expanded.keys() & found.keys()
        found |= expanded
        n_pairs += r.n_pairs
    return found


def _corpus(seed):
    """Random files: a hot repository, hot lines, copies, near copies, tiny and empty files."""
    rng = random.Random(seed)
    rows = []
    base = [f"line {i}" for i in range(60)]
    for n in range(90):
        repo = "hot" if n % 3 else rng.choice(["a", "b"])
        kind = rng.random()
        if kind < 0.3:
            lines = base[:20]  # a group of copies
        elif kind < 0.5:
            lines = base[:20] + [f"own {n}"]  # near copies
        elif kind < 0.6:
            lines = ["line 0"]  # one hot line only
        elif kind < 0.65:
            lines = ["  ", ""]
        elif kind < 0.75:  # copies of several sets that share one line and are not linked
            lines = ["line 0"] + [f"group {n % 4} {i}" for i in range(9)]
        else:
            lines = ["line 0"] + rng.sample(base, rng.randint(1, 30)) + [f"own {n} {i}" for i in range(rng.randint(0, 9))]
        rng.shuffle(lines)
        rows.append((repo, f"f{n:03d}", "\n".join("  " + line for line in lines)))
    return rows


@pytest.mark.parametrize("seed, above", [(1, 60), (2, 80), (3, 30), (4, 99)])
def test_all_pairs_above_the_similarity_and_no_others(make_files, seed, above):
    rows = _corpus(seed)
    files = make_files(rows)
    found = _expanded(duplication.similar_pairs(files, above), files)
    assert found == _brute_force(rows, above)


def _classes(pairs, paths):
    """{first path: its class} of linked files, by following the pairs."""
    near = {}
    for repo, a, b in pairs:
        near.setdefault((repo, a), set()).add((repo, b))
        near.setdefault((repo, b), set()).add((repo, a))
    found, seen = {}, set()
    for start in sorted(near):
        members, todo = set(), [start]
        while todo:
            file = todo.pop()
            if file not in members:
                members.add(file)
                todo += near[file]
        if not seen & members:
            found[start] = members
        seen |= members
    return found, near


@pytest.mark.parametrize("seed, above, deal", [(1, 60, 4096), (2, 80, 1), (3, 30, 2), (4, 99, 3)])
def test_classes_count_all_links(make_files, monkeypatch, seed, above, deal):
    monkeypatch.setattr(duplication, "DEAL", deal)  # lines of more sets are dealt out
    rows = _corpus(seed)
    pairs = _brute_force(rows, above)
    expected, near = _classes(pairs, rows)
    found = duplication.Duplication(make_files(rows), above)
    classes = {(r.repo, r.class_id): r for r in found.classes().collect()}
    assert classes.keys() == expected.keys()
    for key, row in classes.items():
        own = {(repo, *p): v for (repo, *p), v in pairs.items() if (repo, p[0]) in expected[key]}
        assert (row.n_files, row.n_links) == (len(expected[key]), len(own))
        assert own[(row.repo, row.file_a, row.file_b)] == (row.common_lines, row.similarity_percent)
        assert row.similarity_percent == max(percent for _, percent in own.values())
    members = {(r.repo, r.path): r for r in found.members().collect()}
    assert members.keys() == near.keys()
    for key, row in members.items():
        assert row.n_links == len(near[key]) and key in expected[(row.repo, row.class_id)]
        percents = [v[1] for (repo, *p), v in pairs.items() if repo == row.repo and row.path in p]
        assert row.closest_percent == max(percents)
    counted = found.by_family().groupBy("repo", "similarity_percent").agg(F.sum("n_pairs").alias("n")).collect()
    by_percent = {}
    for (repo, *_), (_, percent) in pairs.items():
        by_percent[(repo, percent)] = by_percent.get((repo, percent), 0) + 1
    assert {(r.repo, r.similarity_percent): r.n for r in counted} == by_percent


def test_files_with_one_header_make_no_pairs(make_files):
    """2,000 files of one header and a few lines of their own, all linked with each other."""
    header = "\n".join(f"# header {i}" for i in range(10))
    rows = [(f"f{i:04d}", f"{header}\n" + "\n".join(f"own {i} {k}" for k in range(i % 3 + 1))) for i in range(2000)]
    found = duplication.Duplication(make_files(rows))
    assert found.families.count() == 3 and found.links.count() == 3
    (row,) = found.classes().collect()
    assert (row.class_id, row.n_files, row.n_links) == ("f0000", 2000, 2000 * 1999 // 2)
    assert (row.file_a, row.file_b, row.similarity_percent) == ("f0000", "f0001", 90.9)
    members = found.members()
    assert members.count() == 2000 and members.where("n_links <> 1999").count() == 0
    assert found.by_family().count() <= 6


def test_no_array_moves_before_the_candidates_are_final(make_files):
    found = duplication.Duplication(make_files(_corpus(5)))
    plan = found._candidates()._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and "shared" not in "".join(exchanged)
    schema = found._candidates().schema
    assert {f.dataType.typeName() for f in schema} == {"long"}


def test_no_files_and_files_without_lines(make_files):
    found = duplication.Duplication(make_files([("a", ""), ("b", None), ("c", " \n "), ("d", "x")]))
    assert found.classes().count() == found.members().count() == found.pairs().count() == 0
    assert found.by_family().count() == 0


def test_a_large_group_of_copies_is_one_row(make_files):
    files = make_files([(f"f{i:04d}", "a\nb\nc") for i in range(500)])
    rows = duplication.similar_pairs(files).collect()
    assert [(r.file_a, r.file_b, r.n_pairs) for r in rows] == [("f0000", "f0499", 500 * 499 // 2)]


def test_pair_matrix_keeps_pairs_without_overlap(make_files):
    files = make_files([("a", "x\ny\nz\nw"), ("b", "x\ny\nz\nq"), ("c", "other"), ("d", "")])
    chosen = files.select("repo", "path").withColumn(
        "rn", F.expr("CASE path WHEN 'b' THEN 1 WHEN 'a' THEN 2 WHEN 'c' THEN 3 ELSE 4 END")
    )
    rows = {(r.file_a, r.file_b): (r.similarity_percent, r.common_lines)
            for r in duplication.pair_matrix(files, chosen).collect()}
    assert rows == {
        ("b", "a"): (75.0, 3), ("b", "c"): (0.0, 0), ("a", "c"): (0.0, 0),
        ("b", "d"): (0.0, None), ("a", "d"): (0.0, None), ("c", "d"): (0.0, None),
    }


def test_analyst_selection(make_files):
    rows = [(f"m{i}.py", "x" * i) for i in range(1, 7)]
    rows += [("pkg/__init__.py", "x" * 99), ("tests/a.py", "x" * 99), ("latest.py", "x" * 99),
             ("src/config.py", "x" * 99), ("big.java", "x" * 99), ("config/run.py", "x" * 50)]
    found = selection.analyst_selection(make_files(rows)).orderBy("rn").collect()
    assert [r.path for r in found] == ["config/run.py", "m6.py", "m5.py", "m4.py"]


@pytest.mark.parametrize("seed, above", [(1, 60), (2, 60), (3, 30), (4, 80)])
@pytest.mark.parametrize("common", [2, 6, 512])
def test_numbers_by_similarity_count_all_links(make_files, monkeypatch, seed, above, common):
    monkeypatch.setattr(duplication, "COMMON", common, raising=False)  # lines of more sets make classes
    rows = _corpus(seed)
    expected = {}
    for (repo, *_), (_, percent) in _brute_force(rows, above).items():
        expected[(repo, percent)] = expected.get((repo, percent), 0) + 1
    found = duplication.Duplication(make_files(rows), above).by_similarity().collect()
    assert {(r.repo, r.similarity_percent): r.n_pairs for r in found} == expected


def test_files_linked_by_a_header_are_counted_without_pairs(make_files, monkeypatch):
    monkeypatch.setattr(duplication, "COMMON", 10, raising=False)
    header = [f"line {i}" for i in range(9)]  # any two are linked; two and two share one more line
    rows = [(f"{n}.py", "\n".join([*header, f"pair {n // 2}", f"own {n}"])) for n in range(200)]
    found = duplication.Duplication(make_files(rows))
    assert [(r.similarity_percent, r.n_pairs) for r in found.by_similarity().orderBy("similarity_percent").collect()] == [
        (81.8, 200 * 199 // 2 - 100), (90.9, 100),
    ]
    assert found._candidates().count() == 4950  # pairs of families
    assert found._candidates(most=10).count() == 0  # what is listed now


@pytest.mark.parametrize("seed, above, common", [(1, 60, 3), (2, 80, 8), (3, 30, 0), (4, 60, 10_000)])
def test_pairs_by_file_are_those_of_families_and_listed_for_rarer_lines_only(make_files, monkeypatch, seed, above, common):
    monkeypatch.setattr(duplication, "COMMON", common)
    made = duplication.Duplication(make_files(_corpus(seed)), above)
    listed = made.by_family().groupBy("repo", "file").agg(F.max("similarity_percent"), F.sum("n_pairs"))
    found = made.by_file()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, listed.collect()))
    assert found.count() > 0


def test_pairs_by_file_do_not_list_families_of_common_lines(make_files, monkeypatch):
    """Families of one header, each with a rarer line of its own and a copy of it, are not met in pairs."""
    monkeypatch.setattr(duplication, "COMMON", 4)
    header = [f"header {i}" for i in range(20)]
    rows = [("r", f"f{i:02d}", "\n".join([*header, f"rare {i // 2}", f"own {i}"])) for i in range(40)]
    made = duplication.Duplication(make_files(rows), 80)
    assert made.by_family().agg(F.sum("n_pairs")).first()[0] == made.by_file().agg(F.sum("n_pairs")).first()[0] == 780
    assert made.links.count() == 190 and made._by_rarer().count() == 0 and made._by_class_and_file().count() == 19


@pytest.mark.parametrize("seed, above, common", [(1, 60, 3), (4, 30, 0)])
def test_pairs_of_classes_are_all_links(make_files, monkeypatch, seed, above, common):
    """Families that share common lines only are linked by classes, whatever is dealt out; no pair is lost or doubled."""
    monkeypatch.setattr(duplication, "COMMON", common)
    monkeypatch.setattr(duplication, "MEMBERS", 2)
    rows = _corpus(seed)
    expected = {}
    for (repo, *_), (_, percent) in _brute_force(rows, above).items():
        expected[(repo, percent)] = expected.get((repo, percent), 0) + 1
    made = duplication.Duplication(make_files(rows), above)
    assert made._class_links().count() > 0
    found = made.pairs().groupBy("repo", "similarity_percent").agg(F.sum("n_pairs").alias("n"))
    assert {(r.repo, r.similarity_percent): r.n for r in found.collect()} == expected
    assert made.links.count() == made.links.select("family_a", "family_b").distinct().count()


def test_links_of_common_lines_need_no_candidates(make_files, monkeypatch):
    monkeypatch.setattr(duplication, "COMMON", 10)
    header = [f"line {i}" for i in range(9)]
    rows = [("r", f"{n}.py", "\n".join([*header, f"pair {n // 2}", f"own {n}"])) for n in range(60)]
    made = duplication.Duplication(make_files(rows))
    tried, candidates = [], made._candidates

    def counted(*args, **kwargs):
        tried.append(candidates(*args, **kwargs).count())
        return candidates(*args, **kwargs)

    monkeypatch.setattr(made, "_candidates", counted)
    assert made.links.count() == 30 * 29 // 2  # families of two files
    assert sum(tried) == 0


@pytest.mark.parametrize("seed, above, common, members", [(1, 60, 3, 2), (2, 80, 0, 512), (3, 30, 6, 3), (4, 30, 1, 1)])
def test_pairs_of_sets_by_classes_are_all_pairs(make_files, monkeypatch, seed, above, common, members):
    """Each pair once, whether of a family, of a class, by a rarer line or by common ones."""
    monkeypatch.setattr(duplication, "COMMON", common)
    monkeypatch.setattr(duplication, "MEMBERS", members)
    rows = _corpus(seed)
    files = make_files(rows)
    listed = [(r.repo, r.file_a, r.file_b) for r in duplication.similar_pairs(files, above).collect()]
    assert len(listed) == len(set(listed))
    assert _expanded(duplication.similar_pairs(files, above), files) == _brute_force(rows, above)


def test_listed_pairs_are_not_moved(make_files, monkeypatch):
    """Families that share common lines only: their pairs are neither written nor shuffled, only members are."""
    monkeypatch.setattr(duplication, "COMMON", 10)
    header = [f"line {i}" for i in range(9)]
    rows = [("r", f"{n}.py", "\n".join([*header, f"pair {n // 2}", f"own {n}"])) for n in range(60)]
    rows += [("r", f"plain {n}.py", "\n".join([*header, f"alone {n}"])) for n in range(20)]
    written, write = {}, duplication.materialize

    def counted(frame, name):
        written[name] = write(frame, name)
        return written[name]

    monkeypatch.setattr(duplication, "materialize", counted)
    made = duplication.Duplication(make_files(rows))
    pairs = made.pairs()
    assert "family-links" not in written and all(frame.count() <= 200 * 11 for frame in written.values())
    assert pairs.count() == 80 * 79 // 2
    # above the join that makes them there is no exchange
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    last = next(n for n, line in enumerate(plan.splitlines()) if "Join" in line and "class_b" in line)
    assert not any("Exchange" in line or "Repartition" in line for line in plan.splitlines()[:last])
