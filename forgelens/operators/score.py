"""The explained security score of a repository, 0 to 30."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tallies import surface_rating

MAX_SCORE = 30

# Deductions (count column, points each, cap, factor text).
DEDUCTIONS = [
    ("n_critical_cves", 5, 15, "%d Critical CVE(s) in dependencies (−%d pts)"),
    ("n_other_cves", 2, 6, "%d non-critical CVE(s) in dependencies (−%d pts)"),
    ("n_secrets", 3, 9, "%d potential secrets exposed (−%d pts)"),
    ("dangerous_critical", 4, 12, "%d Critical API pattern(s) detected (−%d pts)"),
    ("dangerous_high", 2, 6, "%d High-risk API pattern(s) detected (−%d pts)"),
    ("dangerous_medium", 1, 3, "%d Medium-risk API pattern(s) detected (−%d pts)"),
    ("smells_high", 2, 4, "%d High-severity security smell(s) (−%d pts)"),
    ("smells_medium", 1, 2, "%d Medium-severity security smell(s) (−%d pts)"),
]
# Deduction per attack-surface rating.
SURFACE_DEDUCTIONS = [
    ("HIGH", 3, "Significant attack surface exposure (−3 pts)"),
    ("MEDIUM", 1, "Moderate attack surface exposure (−1 pt)"),
]
# Lower bound of a score and its risk.
RISK_BANDS = [(25, "LOW"), (17, "MEDIUM"), (10, "HIGH")]


def _negative_factors() -> Column:
    """Array of (points, factor) in rule order; at most one entry per rule."""
    entry = lambda points, text: F.struct(
        points.cast("int").alias("points"), text.alias("factor")
    )
    factors = []
    for name, each, cap, text in DEDUCTIONS:
        count = F.col(name)
        points = F.least(count * each, F.lit(cap))
        factors.append(F.when(count > 0, entry(points, F.format_string(text, count, points))))
    for rating, points, text in SURFACE_DEDUCTIONS:
        factors.append(
            F.when(F.col("surface_rating") == rating, entry(F.lit(points), F.lit(text)))
        )
    return F.filter(F.array(*factors), lambda f: f.isNotNull())


def _positive_factors() -> Column:
    cves, secrets = F.col("n_cves"), F.col("n_secrets")
    factors = [
        (F.col("active_maintenance"), "Active maintenance (recent commits)"),
        (F.col("has_tests"), "Tests present (reduces regression risk)"),
        (
            (cves == 0) & (secrets == 0) & (F.col("n_dangerous") == 0),
            "No vulnerabilities, secrets, or dangerous patterns detected",
        ),
        (cves == 0, "No known CVEs in dependencies"),
        (secrets == 0, "No exposed secrets in source code"),
    ]
    return F.filter(
        F.array(*[F.when(condition, text) for condition, text in factors]),
        lambda f: f.isNotNull(),
    )


def scored(counts: DataFrame) -> DataFrame:
    """One projection that adds the score to the per-repository counts.

    Expects the counts plus ``n_cves``, ``n_critical_cves``, ``has_tests`` and
    ``active_maintenance``.
    """
    rated = counts.withColumns(
        {
            "surface_rating": surface_rating(),
            "n_other_cves": F.col("n_cves") - F.col("n_critical_cves"),
        }
    )
    factored = rated.withColumns(
        {"_negative": _negative_factors(), "positive_factors": _positive_factors()}
    )
    deducted = F.aggregate("_negative", F.lit(0), lambda total, f: total + f["points"])
    with_score = factored.withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(MAX_SCORE), MAX_SCORE - deducted))
    )
    risk = F
    for bound, name in RISK_BANDS:
        risk = risk.when(F.col("score") >= bound, name)
    with_risk = with_score.withColumn("risk", risk.otherwise("CRITICAL"))
    head = F.format_string(
        "Final Score: %d/30 — Risk level: %s. ", F.col("score"), F.col("risk")
    )
    explanation = F.when(
        F.size("_negative") > 0,
        F.concat(
            head,
            F.format_string(
                "%d positive factor(s) and %d negative factor(s) identified. "
                "Prioritize remediation of Critical severity findings.",
                F.size("positive_factors"), F.size("_negative"),
            ),
        ),
    ).otherwise(
        F.concat(
            head,
            F.lit(
                "No significant security findings detected via static analysis. "
                "Manual verification remains recommended."
            ),
        )
    )
    return with_risk.withColumns(
        {
            "max_score": F.lit(MAX_SCORE),
            "negative_factors": F.col("_negative.factor"),
            "negative_points": F.col("_negative.points"),
            "explanation": explanation,
        }
    ).drop("_negative")


def security_score(counts: DataFrame) -> DataFrame:
    return scored(counts).select(
        "repo",
        "score",
        "max_score",
        "risk",
        "positive_factors",
        "negative_factors",
        "negative_points",
        "explanation",
    )


def top_negative_factors(scores: DataFrame, n: int = 3) -> DataFrame:
    """The heaviest deductions of a repository, rule order among equals.

    A repository has one factor per rule at most, so the ranking happens inside
    its row.
    """
    ranked = F.transform(
        F.arrays_zip("negative_points", "negative_factors"),
        lambda f, position: F.struct(
            (-f["negative_points"]).alias("order"),
            position.alias("rule"),
            f["negative_factors"].alias("factor"),
            f["negative_points"].alias("points"),
        ),
    )
    top = F.slice(F.sort_array(ranked), 1, n)
    return scores.select("repo", F.posexplode(top).alias("_pos", "_top")).select(
        "repo",
        (F.col("_pos") + 1).alias("rank"),
        F.col("_top.factor").alias("factor"),
        F.col("_top.points").alias("points"),
    )
