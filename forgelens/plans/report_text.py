"""The security report of each repository as lines of Markdown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import score
from .audit import SecurityAudit

SECTIONS = ("Summary", "Security Score", "Heaviest Factors", "OWASP Top 10")
SECTION_LINES = 1000  # places kept for the lines of a section


def report_lines(audit: SecurityAudit) -> DataFrame:
    """Repo, place, text; in the order of ``place`` the lines are the report.

    Sections without lines are left out.  The audit's counts, which all sections come
    from, are written once.
    """
    audit = audit.with_counts_written()
    report = audit.report()
    points = score.top_negative_factors(audit.security_score())
    coverage = audit.owasp_coverage()
    bodies = [
        report.select("repo", F.lit(1).alias("nth"), F.col("summary").alias("text")),
        report.select(
            "repo",
            F.posexplode(
                F.array(F.format_string("**%d/30** — risk level **%s**", "score", "risk"), F.col("explanation"))
            ).alias("nth", "text"),
        ).withColumn("nth", F.col("nth") + 1),
        points.select(
            "repo", F.col("rank").alias("nth"), F.format_string("%d. %s", "rank", "factor").alias("text")
        ),
        coverage.select(
            "repo",
            F.regexp_extract("category", "([0-9]+)", 1).cast("int").alias("nth"),
            F.format_string("- %s: %s", "category", "status").alias("text"),
        ),
    ]
    heading = [report.select("repo", F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("# Security report: "), "repo").alias("text"))]
    for number, (title, body) in enumerate(zip(SECTIONS, bodies), 1):
        first = number * SECTION_LINES
        heading.append(
            body.select("repo").distinct().select("repo", F.lit(first).cast("bigint").alias("place"), F.lit(f"## {title}").alias("text"))
        )
        heading.append(body.select("repo", (F.lit(first) + F.col("nth")).cast("bigint").alias("place"), "text"))
    lines = heading[0]
    for more in heading[1:]:
        lines = lines.unionByName(more)
    return lines
