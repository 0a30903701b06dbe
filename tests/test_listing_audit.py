import datetime as dt

from pyspark.sql import functions as F

from forgelens.operators import listing, selection
from forgelens.plans.audit import AuditOptions, SecurityAudit
from forgelens.schemas import ADVISORIES


def test_structure_and_tests(spark, make_files, repos_of):
    files = make_files([("a", "x.py", "1"), ("a", "y/z.py", "2"), ("b", "latest.py", "3")])
    files = files.unionByName(
        files.limit(1).withColumns({"path": F.lit("Tests"), "kind": F.lit("tree")})
    )
    rows = {r.repo: r for r in listing.repo_structure(repos_of("a", "b", "c"), files).collect()}
    assert (rows["a"].total_files, rows["a"].has_tests_folder) == (2, False)
    assert (rows["b"].total_files, rows["b"].has_tests_folder) == (1, True)
    assert (rows["c"].total_files, rows["c"].has_tests_folder) == (0, False)
    tests = {r.repo: (r.has_tests_folder, r.has_test_entries)
             for r in listing.has_tests(files).collect()}
    assert tests == {"a": (False, True), "b": (True, True)}


def _commits(spark, n, path="a.py"):
    start = dt.datetime(2024, 1, 31)
    rows = [("r", path, f"{i:04d}", start - dt.timedelta(days=i), f"m{i}") for i in range(n)]
    return spark.createDataFrame(
        rows, "repo string, path string, sha string, author_date timestamp, message string"
    )


def test_commit_activity_and_churn(spark):
    commits = _commits(spark, 200)
    row = listing.commit_activity(commits).first()
    assert (row.last_commit_message, row.sample_size) == ("m0", 200)
    assert listing.commit_activity(commits, 50).first().sample_size == 50
    as_of = "2024-01-31 00:00:00"
    assert listing.file_churn(commits, as_of).first().commit_count == 91
    assert listing.file_churn(commits, as_of, days=150).first().commit_count == 151
    assert listing.file_churn(commits, as_of, days=150, commit_cap=100).first().commit_count == 100
    assert listing.file_churn(commits, as_of, days=7).first().commit_count == 8
    # what comes after the reference date does not count
    assert listing.file_churn(commits, "2024-01-21 00:00:00", days=1).first().commit_count == 2


def test_dependency_file_order(make_files):
    files = make_files(
        [("a", "pom.xml", ""), ("a", "package.json", ""), ("b", "pyproject.toml", ""),
         ("b", "package.json", ""), ("c", "x/requirements.txt", "")]
    )
    scan = {r.repo: r.filename for r in listing.dependency_file(files).collect()}
    assert scan == {"a": "package.json", "b": "package.json"}
    security = listing.dependency_file(files, ["requirements.txt", "pyproject.toml", "package.json"])
    assert {r.repo: r.filename for r in security.collect()} == {
        "a": "package.json", "b": "pyproject.toml",
    }


def test_candidates_are_limited_per_repository(make_files):
    rows = [("hot", f"d/f{i:03d}.py", "x") for i in range(300)] + [("hot", "z.py", "x")]
    rows += [("b", p, "x") for p in ("vendor/a.py", "latest.py", ".venv/x.py", "k.kt", "ok.py")]
    files = make_files(rows)
    assert selection.secret_candidates(files).count() == 302
    found = selection.secret_candidates(files, 10).orderBy("repo", "rn").collect()
    assert [r.path for r in found if r.repo == "hot"][:2] == ["z.py", "d/f000.py"]
    assert len(found) == 11 and [r.path for r in found if r.repo == "b"] == ["ok.py"]
    assert {r.path for r in selection.deep_candidates(files).where("repo='b'").collect()} == {
        "k.kt", "ok.py",
    }
    plan = files._sc._jvm.PythonSQLUtils.explainString(
        selection.secret_candidates(files, 10)._jdf.queryExecution(), "simple"
    )
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _audit(spark, files, repos, options=AuditOptions(), paths=None):
    advisories = spark.createDataFrame(
        [("A", "PyPI", "x", [("0", None)], [], None, None, None, None, '{"score":9.9}')],
        ADVISORIES,
    )
    return SecurityAudit(repos, files, advisories, options, paths=paths)


ROWS = [
    ("r", "a.py", "eval(x)\npassword = 'secret99'"),
    ("r", "b/c.py", "eval(x)\npassword = 'secret99'"),
    ("r", "node_modules/d.py", "eval(x)\npassword = 'secret99'"),
    ("r", "k.java", "new Random()\npassword = 'secret99'"),
    ("r", "tests/t.py", "eval(x)"),
    ("r", "requirements.txt", "x\ny==1\nx==2"),
]


def test_report_of_a_repository(spark, make_files, repos_of):
    audit = _audit(spark, make_files(ROWS), repos_of("r", "empty"))
    rows = {r.repo: r for r in audit.report().collect()}
    row = rows["r"]
    assert (row.total_secret_findings, row.n_dangerous) == (3, 3)
    assert (row.total_vulnerabilities, row.critical_vulnerabilities) == (2, 2)
    assert (row.n_vulnerable_packages, row.packages_checked) == (2, 3)
    assert (row.files_analyzed, row.has_tests) == (3, True)
    # 30 - 2 Critical CVEs * 5 - 3 secrets * 3 - 2 Critical patterns * 4 - 1 Medium
    assert (row.score, row.risk) == (2, "CRITICAL")
    assert rows["empty"].score == 30 and rows["empty"].dependency_file_scanned == "none"
    basic = audit.basic_report().where("repo = 'r'").first()
    assert basic.summary == (
        "Security analysis for r: 2 OSV vulnerability(ies) found in 2 package(s), "
        "3 potential secret(s) detected in 3 file(s)."
    )


def test_limits_and_explicit_paths(spark, make_files, repos_of):
    files = make_files(ROWS + [("s", f"f{i}.py", "eval(x)") for i in range(5)])
    limited = _audit(
        spark, files, repos_of("r", "s"),
        AuditOptions(max_secret_files=1, max_deep_files=2, max_deps=1),
    )
    rows = {r.repo: r for r in limited.report().collect()}
    assert (rows["r"].total_secret_findings, rows["r"].n_dangerous) == (1, 2)
    assert (rows["r"].packages_checked, rows["s"].n_dangerous) == (1, 2)
    assert (rows["r"].files_analyzed, rows["s"].files_analyzed) == (2, 2)

    paths = spark.createDataFrame(
        [("r", "tests/t.py", 0), ("r", "a.py", 1)], "repo string, path string, pos int"
    )
    listed = _audit(spark, files, repos_of("r", "s"), AuditOptions(max_secret_files=1), paths)
    rows = {r.repo: r for r in listed.report().collect()}
    assert (rows["r"].n_dangerous, rows["r"].total_secret_findings) == (2, 0)
    assert (rows["r"].files_analyzed, rows["s"].n_dangerous) == (2, 5)
    chosen = selection.select_files(
        files, selection.secret_candidate(F.col("path")), max_files=1, paths=paths
    )
    assert {(r.repo, r.path) for r in chosen.collect()} == {("r", "tests/t.py"), ("s", "f0.py")}
