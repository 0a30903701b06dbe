"""Audits kept up to date by changed files, against audits of all files."""

import random

import pytest
from pyspark.sql import functions as F

from forgelens.operators import scans
from forgelens.plans.audit import AuditOptions, SecurityAudit
from forgelens.plans.incremental import AuditState
from forgelens.schemas import ADVISORIES

TEXTS = ["eval(x)", "password = 'secret99'", "import hashlib\nhashlib.md5(x)", "@app.route('/x')\ndef f(): pass", "x = 1", ""]


def _files(rng, n=40):
    made = {("r" if i % 3 else "s", f"{rng.choice(['', 'src/', 'tests/'])}f{i}.{rng.choice(['py', 'java', 'md'])}"):
            "\n".join(rng.sample(TEXTS, rng.randrange(1, 4))) for i in range(n)}
    made["r", "requirements.txt"] = "x==1.0\ny\n"
    made["s", "pyproject.toml"] = '[project]\ndependencies = ["x==1.0"]\n'
    return made


def _changed(files, rng):
    """Some files edited, moved, deleted and added; a whole repository gone, another new."""
    made = dict(files)
    for key in rng.sample(sorted(made), 6):
        made[key] += "\nexec(y)"
    for repo, path in rng.sample(sorted(made), 4):
        made[repo, f"moved/{path}"] = made.pop((repo, path))
    for key in rng.sample(sorted(made), 4):
        del made[key]
    made = {k: v for k, v in made.items() if k[0] != "s"}
    made |= {("r", "new.py"): "pickle.loads(x)", ("t", "a.py"): "eval(x)", ("t", "requirements.txt"): "x==1.0"}
    return made


def _frame(spark, files):
    return spark.createDataFrame(
        [(repo, path, "blob", len(c), c) for (repo, path), c in files.items()],
        "repo string, path string, kind string, size_bytes bigint, content string",
    )


def test_updates_equal_full_audits_and_ask_for_changed_content_only(spark, repos_of, tmp_path):
    rng = random.Random(3)
    first = _files(rng)
    second = _changed(first, rng)
    advisories = spark.createDataFrame(
        [("A", "PyPI", "x", [("0", "2.0")], [], None, None, None, None, '{"score":9.9}')], ADVISORIES
    )
    repos = repos_of("r", "s", "t")
    state, before = AuditState(spark), {}
    for files in (first, second, second):
        frame, asked_for = _frame(spark, files), []

        def contents(asked, frame=frame, asked_for=asked_for):
            asked_for += [(r.repo, r.path) for r in asked.collect()]
            return frame.join(asked, ["repo", "path"], "left_semi")

        listing = frame.withColumn("content_hash", F.sha2("content", 256)).drop("content")
        state = state.update(listing, contents, str(tmp_path))
        assert sorted(asked_for) == sorted(k for k, v in files.items() if before.get(k) != v)
        kept, full = state.audit(repos, advisories), SecurityAudit(repos, frame, advisories).with_hits_written()
        rows = lambda f: sorted(map(str, f.collect()))
        assert rows(kept.report()) == rows(full.report())
        assert rows(kept.hits.select(full.hits.columns)) == rows(full.hits)
        assert rows(kept.owasp_findings()) == rows(full.owasp_findings())
        before = files


def test_limits_are_refused_and_content_is_read_once(spark, make_files, repos_of, tmp_path):
    with pytest.raises(ValueError):
        AuditState(spark, options=AuditOptions(max_deep_files=3))
    make_files([("a.py", "eval(x)"), ("requirements.txt", "x==1\ny")]).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    advisories = spark.createDataFrame([], ADVISORIES)
    audit = SecurityAudit(repos_of("r"), files, advisories)
    plan = audit.scanned._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # hits and dependency lines in one pass
    written = audit.with_hits_written()
    plan = written.report()._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "SortAggregate" not in plan
    assert {r.kind for r in written.scanned.collect()} == {scans.DANGEROUS, scans.DEPENDENCY}
    assert written.report().first().packages_checked == 2


def test_only_advisories_of_listed_packages_are_rated(spark, make_files, repos_of):
    """An audit rates what its lists can meet, and not before a result asks for counts."""
    files = make_files([("requirements.txt", "My.Pkg==1.0\ny"), ("a.py", "eval(x)")])
    names = ["my-pkg", "MY_pkg", "y", *[f"other{i}" for i in range(200)]]
    rows = [(f"A{i}", "PyPI", n, [("0", None)], [], None, None, None, None, '{"score":9.9}') for i, n in enumerate(names)]
    rows.append(("N", "npm", "y", [("0", None)], [], None, None, None, None, '{"score":9.9}'))
    audit = SecurityAudit(repos_of("r"), files, spark.createDataFrame(rows, ADVISORIES))
    assert "counts" not in vars(audit)
    every = audit.report().collect()
    written = audit.with_hits_written()
    assert "counts" not in vars(written)
    assert {r.id for r in written.rated_advisories.collect()} == {"A0", "A1", "A2"}
    assert written.report().collect() == every
    assert (every[0].total_vulnerabilities, every[0].critical_vulnerabilities) == (3, 3)
