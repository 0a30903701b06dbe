"""The prioritised action plan of each repository."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import quoted
from ..operators import scans
from ..operators.tallies import REPO_SMELLS, RULES

# Priority of a severity, for security and for quality findings.
SECURITY_PRIORITY = [("Critical", 1), ("High", 2), ("Medium", 3)]
QUALITY_PRIORITY = [(["CRITICAL", "CRITIQUE"], 1), (["MAJOR", "MAJEUR"], 2)]
SECRET_SEVERITY = "High"
SECURITY, QUALITY = "security", "quality"


def _security_priority(severity: Column) -> Column:
    priority = F
    for name, value in SECURITY_PRIORITY:
        priority = priority.when(severity == name, value)
    return priority.otherwise(4)


def _quality_priority(severity: Column) -> Column:
    priority = F
    for names, value in QUALITY_PRIORITY:
        priority = priority.when(severity.isin(names), value)
    return priority.otherwise(3)


def content_issues(counts: DataFrame) -> DataFrame:
    """Kinds of security issues in the content, from the per-rule counts."""
    rows = []
    for rule in [*RULES, *REPO_SMELLS]:
        if rule.kind == scans.SURFACE:
            continue
        secret = rule.kind == scans.SECRET
        title = f"Potential secret: {rule.title}" if secret else rule.title
        severity = SECRET_SEVERITY if secret else rule.severity
        rows.append(
            f"named_struct('severity', '{severity}', 'title', {quoted(title)}, 'n', {rule.column})"
        )
    return counts.select("repo", F.expr(f"inline(array({', '.join(rows)}))")).where("n > 0")


def package_issues(package_rollup: DataFrame) -> DataFrame:
    """One issue per vulnerable package."""
    return package_rollup.select(
        "repo",
        F.col("max_severity").alias("severity"),
        F.concat(F.lit("Vulnerable dependency: "), F.col("package")).alias("title"),
        F.col("n_cve").alias("n"),
    )


def quality_issues(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo",
        "severity",
        F.concat(F.lit("Code quality: "), F.col("smell_type")).alias("title"),
        F.col("n_occurrences").alias("n"),
    )


def action_plan(counts: DataFrame, package_rollup: DataFrame, quality: DataFrame) -> DataFrame:
    """Repo, priority, source, severity, title, n_findings, order_rank.

    One row per kind of issue.  Sorting by repo and ``order_rank`` gives the
    plan: P1 first, and at equal priority security before code quality.
    """
    security = (
        content_issues(counts)
        .unionByName(package_issues(package_rollup))
        .withColumns(
            {"source": F.lit(SECURITY), "priority": _security_priority(F.col("severity"))}
        )
    )
    code = quality_issues(quality).withColumns(
        {"source": F.lit(QUALITY), "priority": _quality_priority(F.col("severity"))}
    )
    behind = (F.col("source") == QUALITY).cast("int")
    rank = F.col("priority") * 100 + behind * 10 + severity_rank(F.col("severity"))
    return (
        security.unionByName(code)
        .groupBy("repo", "priority", "source", "severity", "title")
        .agg(F.sum("n").alias("n_findings"))
        .withColumn("order_rank", rank)
    )
