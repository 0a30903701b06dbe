"""Hotspots: complexity of a file times how often it changes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import file_metrics, max_complexity

# Exclusive lower bound of a score and its level.
LEVELS = [(100, "CRITICAL HOTSPOT"), (40, "MODERATE HOTSPOT")]
STABLE = "STABLE"


def risk_level(score: Column) -> Column:
    level = F
    for bound, name in LEVELS:
        level = level.when(score > bound, name)
    return level.otherwise(STABLE)


def hotspots(parsed: DataFrame, churn: DataFrame, days: int = 90) -> DataFrame:
    """Join on (repo, path), two columns wide on the churn side.

    A file without commits in the window has a churn of 0.
    """
    return _scored(max_complexity(parsed), churn, days)


def _scored(files: DataFrame, churn: DataFrame, days: int) -> DataFrame:
    joined = files.join(churn, ["repo", "path"], "left")
    commits = F.coalesce("commit_count", F.lit(0)).cast("bigint")
    score = F.col("max_complexity") * F.col("commit_count")
    return (
        joined.withColumn("commit_count", commits)
        .withColumn("hotspot_score", score)
        .withColumn("risk_level", risk_level(F.col("hotspot_score")))
        .withColumn(
            "interpretation",
            F.format_string(
                "'%s' has a hotspot score of %d (complexity=%d × %d commits in "
                f"{days} days). Risk level: %s.",
                F.col("path"), F.col("hotspot_score"), F.col("max_complexity"),
                F.col("commit_count"), F.col("risk_level"),
            ),
        )
    )


def file_hotspot_analysis(parsed: DataFrame, churn: DataFrame, days: int = 90) -> DataFrame:
    """All-in-one file view: quality metrics next to the hotspot columns, in one parse."""
    return _scored(file_metrics(parsed), churn, days)
