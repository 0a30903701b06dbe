from forgelens.functions import registries as R
from forgelens.operators import owasp, scans, score, tallies


def _counts(spark, **values):
    """One repository with the given counts, everything else zero."""
    names = [r.column for r in tallies.RULES]
    row = {n: values.pop(n, 0) for n in names}
    frame = spark.createDataFrame(
        [("r", *row.values())], "repo string, " + ", ".join(f"{n} bigint" for n in names)
    )
    frame = tallies.with_totals(frame)
    extra = {"n_cves": 0, "n_critical_cves": 0} | {
        k: v for k, v in values.items() if k.startswith("n_")
    }
    flags = {"has_tests": False, "active_maintenance": False} | {
        k: v for k, v in values.items() if not k.startswith("n_")
    }
    return frame.selectExpr(
        "*",
        *[f"{v}L AS {k}" for k, v in extra.items()],
        *[f"{str(v).lower()} AS {k}" for k, v in flags.items()],
    )


def _score(spark, **values):
    return score.security_score(_counts(spark, **values)).first()


def test_clean_repository(spark):
    row = _score(spark, has_tests=True, active_maintenance=True)
    assert (row.score, row.max_score, row.risk) == (30, 30, "LOW")
    assert len(row.positive_factors) == 5 and row.negative_factors == []
    assert "No significant security findings" in row.explanation


def test_each_deduction_and_its_cap(spark):
    cases = [
        (dict(n_cves=1, n_critical_cves=1), 25), (dict(n_cves=9, n_critical_cves=9), 15),
        (dict(n_cves=1), 28), (dict(n_cves=9), 24),
        (dict(secret_1=1), 27), (dict(secret_1=5), 21),
        (dict(PY_001=1), 26), (dict(PY_001=5), 18),
        (dict(PY_004=1), 28), (dict(PY_004=5), 24),
        (dict(JV_006=1), 29), (dict(JV_006=5), 27),
        (dict(PY_009=5), 30),
        (dict(smell_sql=1), 28), (dict(smell_sql=5), 26),
        (dict(smell_god=1), 29), (dict(smell_god=5), 28),
        (dict(rest_endpoints=12), 27), (dict(rest_endpoints=3), 29),
    ]
    for values, expected in cases:
        assert _score(spark, **values).score == expected, values


def test_risk_bands_and_clamp(spark):
    assert _score(spark, PY_001=5).risk == "MEDIUM"
    worst = _score(
        spark, n_cves=10, n_critical_cves=10, secret_1=5, PY_001=20, smell_sql=10,
        rest_endpoints=12,
    )
    assert (worst.score, worst.risk) == (0, "CRITICAL")
    # a single Critical pattern still rates LOW
    assert (_score(spark, PY_001=1).score, _score(spark, PY_001=1).risk) == (26, "LOW")
    assert _score(spark, PY_001=3, secret_1=2).risk == "HIGH"


def test_factor_texts_and_top_factors(spark):
    counts = _counts(spark, n_cves=3, n_critical_cves=1, secret_1=1, PY_001=1, rest_endpoints=3)
    row = score.security_score(counts).first()
    assert row.negative_factors == [
        "1 Critical CVE(s) in dependencies (−5 pts)",
        "2 non-critical CVE(s) in dependencies (−4 pts)",
        "1 potential secrets exposed (−3 pts)",
        "1 Critical API pattern(s) detected (−4 pts)",
        "Moderate attack surface exposure (−1 pt)",
    ]
    top = score.top_negative_factors(score.security_score(counts)).orderBy("rank").collect()
    assert [(r.rank, r.points) for r in top] == [(1, 5), (2, 4), (3, 4)]
    assert "non-critical" in top[1].factor and "Critical API" in top[2].factor


def test_coverage_statuses(spark):
    rows = {
        r.category[:3]: r
        for r in owasp.owasp_coverage(
            _counts(spark, n_cves=3, secret_1=2, PY_001=2, JV_007=3, smell_access=1)
        ).collect()
    }
    assert len(rows) == 10
    assert rows["A03"].status == "2 dangerous pattern(s) detected — review recommended."
    assert rows["A06"].status == "1 confirmed finding(s)."
    # detected outranks suspicious
    assert (rows["A02"].n_findings, rows["A02"].status[:1]) == (4, "3")
    assert rows["A04"].status == "Manual review recommended."  # density of weak crypto
    assert rows["A05"].status == "Manual review recommended."
    assert rows["A07"].status == "No evidence found."
    assert rows["A09"].n_findings == rows["A10"].n_findings == 1


def test_findings_match_the_coverage(spark, make_files, repos_of):
    files = make_files(
        [("r", f"c{i}.py", "hashlib.md5(x)\npassword = 'secret99'") for i in range(3)]
        + [("r", "p.java", ".permitAll()"), ("r", "q.java", ".permitAll()")]
    )
    hits = scans.scan_files(files)
    cves = spark.createDataFrame([("r", 2)], "repo string, n_cves bigint")
    found = owasp.owasp_findings(hits, repos_of("r", "s"), cves)
    counts = tallies.complete(repos_of("r", "s"), tallies.tally_hits(hits)).selectExpr(
        "*", "IF(repo = 'r', 2L, 0L) AS n_cves"
    )
    by_category = {
        (r.repo, r.category): r.n_findings
        for r in owasp.owasp_coverage(counts).where("n_findings > 0").collect()
    }
    listed = {(r.repo, r.category): r["count"] for r in found.groupBy("repo", "category").count().collect()}
    assert listed == by_category
    sources = {r.source for r in found.collect()}
    assert "3 potential secrets exposed in source files." in sources
    assert "[PY-006] hashlib.md5() — Weak Cryptographic Hash — c0.py:1" in sources
    assert "Security Smell: Density of Weak Cryptography" in sources
    assert R.LOGGING_NOTE in sources
