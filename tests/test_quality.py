import pytest
from pyspark.sql import functions as F

from forgelens.functions.pyblocks import blocks_of
from forgelens.operators import hotspots, quality
from harness import snippets as S


def test_blocks_of_all_snippets():
    for number, source in enumerate(S.PYTHON):
        expected = [row[1:] for row in S.PYTHON_BLOCKS if row[0] == number]
        if number in S.PYTHON_ERRORS:
            with pytest.raises(SyntaxError):
                blocks_of(source)
            continue
        found = [
            (b["name"], b["kind"], b["block_pos"], b["lineno"], b["length"], b["complexity"],
             b["has_docstring"])
            for b in blocks_of(source)
        ]
        assert found == expected, source


def test_blocks_inside_statements_and_classes():
    source = (
        "if x:\n    def a(): pass\nclass C:\n    y = [i for i in z if i]\n"
        "    class D:\n        def inner(self): pass\n    def m(self):\n        def k(): pass\n"
    )
    assert [(b["name"], b["kind"], b["complexity"]) for b in blocks_of(source)] == [
        ("a", "function", 1), ("C", "class", 4), ("m", "method", 1), ("k", "nested", 1),
        ("inner", "nested", 1),
    ]


def test_errors_and_metrics(make_files):
    files = make_files(
        [("bad.py", "def broken(:"), ("nul.py", "x = 1\x00"), ("none.py", "x = 1"),
         ("docs.py", 'def a():\n    "d"\ndef b():\n    "d"\ndef c(): pass'),
         ("tie.py", "def p(x):\n    if x: pass\ndef q(x):\n    if x: pass")]
    )
    parsed = quality.parse_files(files)
    docs = {r.path: r for r in quality.documentation_ratio(parsed).collect()}
    assert docs["bad.py"].has_error and docs["nul.py"].has_error
    assert docs["bad.py"].total_functions is None
    assert (docs["none.py"].total_functions, docs["none.py"].documentation_ratio) == (0, None)
    assert docs["docs.py"].documentation_ratio == 66.7
    top = {r.path: r for r in quality.max_complexity(parsed).collect()}
    assert (top["bad.py"].max_complexity, top["bad.py"].function_name) == (1, None)
    assert (top["tie.py"].function_name, top["tie.py"].max_complexity) == ("p", 2)


def test_long_function_threshold(make_files):
    source = "def long_one():\n" + "    x = 1\n" * 55
    parsed = quality.parse_files(make_files([("a.py", source)]))
    assert [r.lines for r in quality.long_functions(parsed).collect()] == [55]
    assert quality.long_functions(parsed, 55).count() == 0
    assert quality.long_functions(parsed, 100).count() == 0


def test_markers_do_not_overlap(make_files):
    row = quality.todo_counts(make_files([("a.py", "TODO todo XXXXXXX FIXMETODO")])).first()
    assert (row.todo, row.fixme, row.xxx, row.total) == (2, 1, 2, 5)


@pytest.mark.parametrize(
    "complexity, commits, score, level",
    [(5, 8, 40, "STABLE"), (5, 9, 45, "MODERATE HOTSPOT"), (10, 11, 110, "CRITICAL HOTSPOT"),
     (101, 1, 101, "CRITICAL HOTSPOT"), (100, 1, 100, "MODERATE HOTSPOT"), (18, 0, 0, "STABLE")],
)
def test_hotspot_levels(spark, complexity, commits, score, level):
    assert complexity * commits == score
    assert spark.range(1).select(hotspots.risk_level(F.lit(score))).first()[0] == level


def test_hotspot_without_commits(make_files, spark):
    parsed = quality.parse_files(make_files([("a.py", "x = 1"), ("b.py", "x = 1")]))
    churn = spark.createDataFrame(
        [("r", "a.py", 7, None)],
        "repo string, path string, commit_count bigint, last_modified timestamp",
    )
    rows = {r.path: r for r in hotspots.hotspots(parsed, churn).collect()}
    assert (rows["a.py"].hotspot_score, rows["b.py"].hotspot_score) == (7, 0)
    assert rows["b.py"].interpretation == (
        "'b.py' has a hotspot score of 0 (complexity=1 × 0 commits in 90 days). "
        "Risk level: STABLE."
    )
    assert hotspots.file_hotspot_analysis(parsed, churn).count() == 2


def _findings(spark, make_files, ruleset):
    source = S.PYTHON[6] + "\n" + "def u():\n" + "    x = 1\n" * 110
    parsed = quality.parse_files(make_files([("a.py", source)]))
    pairs = spark.createDataFrame(
        [("r", "a.py", 70.0, 1), ("r", "a.py", 75.0, 1), ("r", "a.py", 90.0, 1)],
        "repo string, file string, similarity_percent double, n_pairs bigint",
    )
    tests = spark.createDataFrame([("r", False)], "repo string, has_tests_folder boolean")
    return quality.quality_findings(parsed, pairs, tests, ruleset)


def test_two_severity_grids(spark, make_files):
    rows = _findings(spark, make_files, "readme").collect()
    assert sorted((r.smell_type, r.severity) for r in rows) == [
        ("cyclomatic_complexity", "CRITICAL"), ("duplication", "CRITICAL"),
        ("duplication", "MAJOR"), ("long_function", "MAJOR"), ("low_documentation", "MINOR"),
    ]
    rows = _findings(spark, make_files, "skill").collect()
    assert sorted((r.smell_type, r.severity) for r in rows) == [
        ("cyclomatic_complexity", "MAJEUR"), ("duplication", "MAJEUR"),
        ("long_function", "MAJEUR"), ("low_documentation", "MINEUR"), ("no_tests", "CRITIQUE"),
    ]


def test_debt_score_counts_occurrences(spark, make_files, repos_of):
    findings = _findings(spark, make_files, "readme")
    rows = {r.repo: r for r in quality.debt_score(repos_of("r", "s"), findings).collect()}
    assert (rows["r"].n_critical, rows["r"].n_major, rows["r"].n_minor) == (2, 3, 1)
    assert (rows["r"].score, rows["s"].score) == (100 - 30 - 24 - 3, 100)
    seven = findings.withColumn("n_occurrences", F.lit(7).cast("bigint"))
    assert quality.debt_score(repos_of("r"), seven).first().score == 0


def test_every_pair_is_a_finding_of_its_own(spark, make_files):
    """Each pair counts, also where two are under one file and severity."""
    parsed = quality.parse_files(make_files([("a.py", "x = 1")]))
    pairs = spark.createDataFrame(
        [("r", "a.py", 70.0, 1), ("r", "a.py", 75.0, 2), ("r", "a.py", 90.0, 1), ("r", "a.py", 60.0, 1)],
        "repo string, file string, similarity_percent double, n_pairs bigint",
    )
    rows = quality.quality_findings(parsed, pairs, each=True).where("smell_type = 'duplication'").collect()
    assert sorted((r.severity, r.measured_value, r.n_occurrences) for r in rows) == [
        ("CRITICAL", 90.0, 1), ("MAJOR", 70.0, 1), ("MAJOR", 75.0, 2),
    ]


def test_quality_findings_of_the_test_tables_list_every_pair(spark):
    from harness import queries, tables

    folder = "/root/testdata/sf0.001"
    pairs = queries.duplication.similar_pairs(tables.py_files(spark, folder))
    found = queries.QUERIES["quality_findings"](spark, folder).where("smell_type = 'duplication'")
    assert found.count() == pairs.count() > 0


def test_a_consistency_report_parses_its_sources_once(spark):
    from harness import queries

    plan = queries.QUERIES["report_consistency"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    # parsed before, into a table that hotspots and quality findings read
    assert "python_blocks" not in plan.optimizedPlan().toString()


def test_the_second_grid_compares_no_pairs_below_its_bound(spark, monkeypatch):
    from harness import queries

    made, real = [], queries.duplication.Duplication
    monkeypatch.setattr(queries.duplication, "Duplication", lambda *args: made.append(real(*args)) or made[-1])
    queries.QUERIES["quality_findings_skill"](spark, "/root/testdata/sf0.001")
    assert [d.min_similarity for d in made] == [80]
