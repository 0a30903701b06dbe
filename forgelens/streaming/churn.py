"""Churn of files over sliding windows, as commits arrive.

The same plan runs over a table and over a stream of commits.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def commit_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet parts of a ``commits`` table as a stream."""
    reader = spark.readStream.schema(schemas.COMMITS)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def churn_windows(commits: DataFrame, days: int = 90, slide_days: int = 1, lateness: str = "1 day") -> DataFrame:
    """repo, path, as_of, commit_count, last_modified per file and window that has commits.

    A window is the ``days`` before ``as_of``, its start included and its end not; ends
    stand ``slide_days`` apart, counted from 1970, and ``days`` is a multiple of that.  A
    commit listed again (same repo, path, sha and date) counts once.  Rows without a date
    do not count.

    In a stream a commit may arrive up to ``lateness`` after later ones, what comes later
    still is left out, and a window is given out once, when no commit of it can arrive any
    more.  State is what that leaves open: the commits of the last day or so, one number
    per file and day, one per file and window; a commit is spread over the windows only as
    part of its day's number.
    """
    if days % slide_days:
        raise ValueError("days must be a multiple of slide_days")
    dated = commits.select("repo", "path", "sha", F.col("author_date").cast("timestamp").alias("author_date"))
    # the date is part of the key, so that the watermark clears what is remembered
    fresh = dated.where("author_date IS NOT NULL").withWatermark("author_date", lateness)
    fresh = fresh.dropDuplicates(["repo", "path", "sha", "author_date"])
    per_day = fresh.groupBy(F.window("author_date", f"{slide_days} days").alias("day"), "repo", "path").agg(
        F.count("*").alias("n"), F.max("author_date").alias("last")
    )
    sliding = F.window(F.window_time("day"), f"{days} days", f"{slide_days} days").alias("span")
    return (
        per_day.groupBy(sliding, "repo", "path")
        .agg(F.sum("n").alias("commit_count"), F.max("last").alias("last_modified"))
        .select("repo", "path", F.col("span.end").alias("as_of"), "commit_count", "last_modified")
    )


def write_churn(windows: DataFrame, out_path: str, checkpoint: str):
    """Appends the windows of a stream to a Parquet table, exactly once; ends when caught up."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out_path)
    )
